"""Aggregation rules over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.basic import micros_to_ntz
from ..operators.alerts import create_alerts, create_group_alerts, deduplicate
from ..operators.correlation import (
    aggregate_rule, aggregate_rules, aggregate_value, expiring_counters, first_group, group_key, having_column,
    rolling_rule, run_rules, trailing_window, tumbling_fires, tumbling_rule, v2_keyed)
from ..operators.fields import EventFields
from ..operators.rules import compile_rule, compile_rules
from .bindings import Tables, with_views
from .catalog import query

BRUTE_FORCE = {
    "id": "brute-force", "name": "Brute force", "severity": "high",
    "triggers": [{"type": "event", "eventType": "authentication_failure"}],
    "conditions": [{"field": "username", "operator": "not_equals", "value": ""}],
    "aggregation": {"type": "count", "size": 1, "unit": "days", "groupBy": ["username", "source_ip"],
                    "having": {"field": "count", "operator": "greater_than_or_equal", "value": 2}},
}
ANSWERS = {
    "id": "bulk-answers", "name": "Bulk answers", "severity": "medium",
    "triggers": [{"type": "event", "eventType": "network_traffic"}],
    "conditions": [{"field": "bytes_received", "operator": "greater_than_or_equal", "value": 30000}],
    "aggregation": {"type": "sum", "size": 3, "unit": "days", "groupBy": ["source_ip"],
                    "having": {"field": "bytes_received", "operator": "greater_than", "value": 300000}},
}
_AUTH = "event_type = 'authentication_attempt' AND username <> ''"
_NET = "event_type = 'network_traffic' AND bytes_received >= 30000"


def _rule(t: Tables, rule: dict):
    fields = EventFields(t.sec_events.schema)
    return compile_rule(rule, fields), fields


@query("agg_trailing_window", with_views(f"""
    SELECT event_id, ts FROM sec_events WHERE {_AUTH}
      AND ts >= (SELECT max(ts) FROM sec_events WHERE {_AUTH}) - INTERVAL 1 DAY""", "sec_events"))
def trailing(t: Tables):
    rule, fields = _rule(t, BRUTE_FORCE)
    return trailing_window(t.sec_events.filter(rule.match), fields.ts, 86400).select("event_id", "ts")


@query("agg_group_key", with_views("""
    SELECT event_id, concat(username, '|', coalesce(m_failure_reason, 'null'), '|', destination_port) AS group_key,
           'all' AS whole FROM sec_events""", "sec_events"))
def group_keys(t: Tables):
    fields = EventFields(t.rich_events.schema)
    return t.rich_events.select(
        "event_id", group_key(fields, ["username", "failure_reason", "destination_port"]).alias("group_key"),
        group_key(fields, None).alias("whole"))


# Points read loosely; missing or unreadable points count as zero.
_POINTS = ("coalesce(TRY_CAST(CASE WHEN regexp_matches(trim(replace(m_points, ',', '')), '^[0-9]+$') "
           "THEN trim(replace(m_points, ',', '')) END AS DOUBLE), 0.0)")


def _aggregate(name: str, kind: str, sql: str):
    @query(name, with_views(f"""
        SELECT source_ip, round({sql}, 6) AS aggregated_value FROM sec_events GROUP BY source_ip""", "sec_events"))
    def build(t: Tables):
        fields = EventFields(t.rich_events.schema)
        spec = {"type": kind, "having": {"field": "risk_points"}}
        return t.rich_events.groupBy("source_ip").agg(
            F.round(aggregate_value(fields, spec), 6).alias("aggregated_value"))


_aggregate("agg_count", "count", "CAST(count(*) AS DOUBLE)")
_aggregate("agg_sum", "sum", f"sum({_POINTS})")
_aggregate("agg_average", "average", f"avg({_POINTS})")
_aggregate("agg_min", "min", f"min({_POINTS})")
_aggregate("agg_max", "max", f"max({_POINTS})")


@query("agg_having", with_views("""
    SELECT source_ip, v > 60 AS gt, v >= 67 AS gte, v < 60 AS lt, v <= 67 AS lte, v = 67 AS eq, v <> 67 AS ne,
           v IN (66, 67) AS is_in, v NOT IN (66, 67) AS not_in, v > 0 AS present, v <= 0 AS absent, v > 0 AS no_clause
    FROM (SELECT source_ip, count(*) AS v FROM sec_events GROUP BY source_ip)""", "sec_events"))
def having(t: Tables):
    counted = t.sec_events.groupBy("source_ip").agg(F.count("*").cast("double").alias("v"))
    clause = lambda operator, value=None: having_column({"operator": operator, "value": value}, F.col("v"))
    return counted.select(
        "source_ip", clause("greater_than", 60).alias("gt"), clause("greater_than_or_equal", 67).alias("gte"),
        clause("less_than", "60").alias("lt"), clause("less_than_or_equal", 67).alias("lte"),
        clause("equals", 67).alias("eq"), clause("not_equals", 67).alias("ne"), clause("in", [66, 67]).alias("is_in"),
        clause("not_in", [66, 67]).alias("not_in"), clause("exists").alias("present"),
        clause("not_exists").alias("absent"), having_column(None, F.col("v")).alias("no_clause"))


_BRUTE_SQL = f"""
    inside AS (SELECT * FROM sec_events WHERE {_AUTH}
      AND ts >= (SELECT max(ts) FROM sec_events WHERE {_AUTH}) - INTERVAL 1 DAY),
    groups AS (SELECT concat(username, '|', source_ip) AS group_key, count(*) AS event_count,
        CAST(count(*) AS DOUBLE) AS aggregated_value, min(ts) AS first_seen, max(ts) AS last_seen,
        arg_min(event_id, ts) AS first_event_id FROM inside GROUP BY username, source_ip HAVING count(*) >= 2)"""


@query("agg_rule_batch", with_views("SELECT * FROM groups", "sec_events", ctes=_BRUTE_SQL))
def brute_force_groups(t: Tables):
    return aggregate_rule(t.sec_events, *_rule(t, BRUTE_FORCE)).select(
        "group_key", "event_count", "aggregated_value", "first_seen", "last_seen", "first_event_id")


@query("agg_rule_first", with_views(
    "SELECT group_key, event_count FROM groups ORDER BY first_seen, first_event_id LIMIT 1", "sec_events",
    ctes=_BRUTE_SQL))
def brute_force_first(t: Tables):
    return first_group(aggregate_rule(t.sec_events, *_rule(t, BRUTE_FORCE))).select("group_key", "event_count")


@query("agg_rule_rolling", with_views(f"""
    SELECT DISTINCT group_key, "at", event_count, aggregated_value FROM (
      SELECT source_ip AS group_key, ts AS "at",
        count(*) OVER w AS event_count, CAST(sum(bytes_received) OVER w AS DOUBLE) AS aggregated_value
      FROM sec_events WHERE {_NET}
      WINDOW w AS (PARTITION BY source_ip ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW))
    WHERE aggregated_value > 300000""", "sec_events"))
def rolling(t: Tables):
    found = rolling_rule(t.sec_events, *_rule(t, ANSWERS))
    return found.select("group_key", micros_to_ntz(F.unix_micros("at")).alias("at"), "event_count", "aggregated_value")


V2_LOGINS = {
    "id": "v2-logins", "name": "Logins per source", "severity": "high", "enabled": True,
    "trigger": {"source_types": ["authentication_attempt"]},
    "condition": {"operator": "gte", "value": 3, "aggregation": {
        "function": "count", "field": "Normalized.username", "group_by": "Normalized.source_ip",
        "window_seconds": 86400}},
}
V2_BYTES = V2_LOGINS | {"id": "v2-bytes", "condition": {"operator": "gt", "value": 2000000, "aggregation": {
    "function": "sum", "field": "bytes_sent", "group_by": "failure_reason", "window_seconds": 3600 * 6}}}
_WINDOWED = """windowed AS (SELECT *, source_ip AS group_value, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS window_id
    FROM sec_events WHERE event_type = 'authentication_attempt')"""


@query("agg_tumbling_count", with_views("""
    SELECT group_value, window_id, count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen
    FROM windowed GROUP BY ALL HAVING count(*) >= 3""", "sec_events", ctes=_WINDOWED))
def tumbling(t: Tables):
    return tumbling_rule(t.sec_events, V2_LOGINS, EventFields(t.sec_events.schema)).select(
        "group_value", "window_id", "event_count", "first_seen", "last_seen")


@query("agg_tumbling_value", with_views("""
    SELECT coalesce(m_failure_reason, 'unknown') AS group_value,
      CAST(floor(epoch(ts)) AS BIGINT) // 21600 AS window_id, CAST(sum(bytes_sent) AS DOUBLE) AS aggregated_value
    FROM sec_events WHERE event_type = 'authentication_attempt' GROUP BY ALL
    HAVING sum(bytes_sent) > 2000000""", "sec_events"))
def tumbling_value(t: Tables):
    return tumbling_rule(t.rich_events, V2_BYTES, EventFields(t.rich_events.schema)).select(
        "group_value", "window_id", "aggregated_value")


@query("agg_tumbling_fires", with_views("""
    SELECT event_id, group_value, window_id FROM (
      SELECT *, row_number() OVER (PARTITION BY group_value, window_id ORDER BY ts, event_id) AS n FROM windowed)
    WHERE n >= 3""", "sec_events", ctes=_WINDOWED))
def fires(t: Tables):
    return tumbling_fires(t.sec_events, V2_LOGINS, EventFields(t.sec_events.schema)) \
        .select("event_id", "group_value", "window_id")


@query("agg_group_extract", with_views("""
    SELECT event_id, coalesce(m_failure_reason, 'unknown') AS group_value,
      CAST(floor(epoch(ts)) AS BIGINT) // 21600 AS window_id
    FROM sec_events WHERE event_type = 'authentication_attempt'""", "sec_events"))
def group_extract(t: Tables):
    return v2_keyed(t.rich_events, V2_BYTES, EventFields(t.rich_events.schema)) \
        .select("event_id", "group_value", "window_id")


def periods_sql(source: str, key: str, ts: str, ttl: int) -> str:
    """Fixed periods as a recursive walk from opening to opening."""
    return f"""
    seconds /*recursive*/ AS (SELECT {key} AS k, CAST(floor(epoch({ts})) AS BIGINT) AS sec, count(*) AS n,
        min({ts}) AS lo, max({ts}) AS hi FROM {source} GROUP BY ALL),
    openings AS (
      SELECT k, min(sec) AS opened FROM seconds GROUP BY k
      UNION ALL
      SELECT o.k, (SELECT min(s.sec) FROM seconds s WHERE s.k = o.k AND s.sec >= o.opened + {ttl}) AS opened
      FROM openings o WHERE EXISTS (SELECT 1 FROM seconds s WHERE s.k = o.k AND s.sec >= o.opened + {ttl})),
    periods AS (SELECT s.k, o.opened, CAST(sum(s.n) AS BIGINT) AS n, min(s.lo) AS first_seen, max(s.hi) AS last_seen
      FROM seconds s JOIN openings o ON s.k = o.k AND s.sec >= o.opened AND s.sec < o.opened + {ttl}
      GROUP BY ALL)"""


_COUNTED = _WINDOWED + """,
    counted AS (SELECT *, concat('v2-logins:', group_value, ':', window_id) AS counter FROM windowed),"""


@query("agg_state_expiry", with_views(
    "SELECT k AS counter, n AS event_count, first_seen, last_seen FROM periods", "sec_events",
    ctes=_COUNTED + periods_sql("counted", "counter", "ts", 3600)))
def state_expiry(t: Tables):
    return expiring_counters(t.sec_events, V2_LOGINS, EventFields(t.sec_events.schema)) \
        .select("counter", "event_count", "first_seen", "last_seen")


DAILY_BRUTE_FORCE = BRUTE_FORCE | {"id": "brute-force-daily"}


@query("brute_force_alerts", with_views("""
    SELECT k AS dedup_key, n AS alert_count, first_seen, last_seen FROM periods""", "sec_events", ctes=f"""
    matched AS (SELECT *, concat('dedup:', sha256(concat('brute-force-daily:', source_ip, ':', destination_ip)))
        AS dedup_key FROM sec_events WHERE {_AUTH}),
    days AS (SELECT username, source_ip, CAST(ts AS DATE) AS d FROM matched GROUP BY ALL HAVING count(*) >= 2),
    firing AS (SELECT m.* FROM matched m JOIN days USING (username, source_ip) WHERE CAST(m.ts AS DATE) = days.d),"""
    + periods_sql("firing", "dedup_key", "ts", 3600)))
def brute_force_alerts(t: Tables):
    """Flagship: events of (user, source) days with two or more failures become
    alerts, deduplicated by rule, source and destination."""
    rule, fields = _rule(t, DAILY_BRUTE_FORCE)
    day = F.to_date(fields.ts)
    matched = t.sec_events.filter(rule.match).withColumn("_day", day)
    busy = matched.groupBy("username", "source_ip", "_day").agg(F.count("*").alias("n")) \
        .filter(having_column(rule.aggregation["having"], F.col("n").cast("double"))).drop("n")
    firing = matched.join(busy, ["username", "source_ip", "_day"], "left_semi").withColumns({
        "rule_id": F.lit(rule.id), "rule_name": F.lit(rule.name), "rule_severity": F.lit(rule.severity)})
    return deduplicate(create_alerts(firing)).select("dedup_key", "alert_count", "first_seen", "last_seen")


# A folder of a hundred rules: forty on single events, forty that aggregate over a trailing
# window, twenty of the second format. Each is built beside its SQL.
_TYPES = ["authentication_attempt", "http_request", "dns_query", "network_traffic", "process_execution"]
_FUNCTIONS = {"count": "count(*)", "sum": "sum(bytes_sent)", "average": "avg(bytes_sent)", "min": "min(bytes_sent)",
              "max": "max(bytes_sent)", "distinct": "count(DISTINCT destination_port)"}
_BOUNDS = {"count": 3, "sum": 4000000, "average": 2000000, "min": 300000, "max": 4500000, "distinct": 2}
_SIGNS = {"greater_than": ">", "greater_than_or_equal": ">=", "less_than": "<", "not_equals": "<>"}


def _conditions(number: int) -> tuple[list[dict], str]:
    port, sent = number % 60, 400000 + 90000 * (number % 40)
    return ([{"field": "destination_port", "operator": "greater_than", "value": port},
             {"field": "bytes_sent", "operator": "greater_than_or_equal", "value": sent},
             {"field": "username", "operator": "not_equals", "value": ""}],
            f"event_type = '{_TYPES[number % 5]}' AND destination_port > {port} AND bytes_sent >= {sent} AND username <> ''")


def _event_rule(number: int) -> tuple[dict, str]:
    conditions, where = _conditions(3 * number)
    rule = {"id": f"event-{number}", "name": f"Event {number}", "severity": "low", "conditions": conditions,
            "triggers": [{"type": "event", "eventType": _TYPES[3 * number % 5]}]}
    return rule, f"""SELECT 'event-{number}' AS rule_id, 'low' AS severity, CAST(event_id AS VARCHAR) AS event_id,
        NULL AS group_key, ts AS first_seen, ts AS last_seen, 1 AS event_count, NULL AS aggregated_value,
        NULL AS first_event_id FROM sec_events WHERE {where}"""


def _grouped(rule_id: str, severity: str, kind: str, key: str, source: str, having: str, window: str = "") -> str:
    return f"""SELECT '{rule_id}', '{severity}', NULL, {key}, min(ts), max(ts), count(*), CAST({_FUNCTIONS[kind]} AS DOUBLE),
        arg_min(event_id, struct_pack(ts := ts, id := event_id)) FROM {source} GROUP BY {key}{window}
        HAVING {_FUNCTIONS[kind]} {having}"""


def _trailing_rule(number: int) -> tuple[dict, str]:
    conditions, where = _conditions(number)
    kind = ("count", "sum", "average", "min", "max")[number % 5]
    operator = list(_SIGNS)[number // 5 % 4]
    keys = (["source_ip"], ["username", "source_ip"], ["hostname"], [])[number // 10]
    days, bound = number % 3 * 9, _BOUNDS[kind]
    aggregation = {"type": kind, "groupBy": keys, "having": {"field": "bytes_sent", "operator": operator, "value": bound}}
    if days:
        aggregation |= {"size": days, "unit": "days"}
        where += f" AND ts >= (SELECT max(ts) FROM sec_events WHERE {where}) - INTERVAL {days} DAY"
    rule = {"id": f"trailing-{number}", "name": f"Trailing {number}", "severity": "high", "conditions": conditions,
            "triggers": [{"type": "event", "eventType": _TYPES[number % 5]}], "aggregation": aggregation}
    key = "concat_ws('|', " + ", ".join(f"coalesce({k}, 'null')" for k in keys) + ")" if keys else "'all'"
    return rule, _grouped(rule["id"], "high", kind, key, f"(SELECT * FROM sec_events WHERE {where})",
                          f"{_SIGNS[operator]} {bound}", "" if keys else ", event_type")


def _tumbling_rule(number: int) -> tuple[dict, str]:
    kind = ("count", "sum", "average", "distinct")[number % 4]
    field = "destination_port" if kind == "distinct" else "bytes_sent"
    key, seconds = ("username", "source_ip")[number % 2], (6, 24, 240)[number % 3] * 3600
    rule = {"id": f"tumbling-{number}", "name": f"Tumbling {number}", "severity": "medium", "enabled": number != 13,
            "trigger": {"source_types": [_TYPES[number % 5]]},
            "condition": {"operator": "gte", "value": _BOUNDS[kind], "aggregation": {
                "function": kind, "field": field, "group_by": key, "window_seconds": seconds}}}
    source = f"(SELECT * FROM sec_events WHERE event_type = '{_TYPES[number % 5]}' AND {str(number != 13).lower()})"
    return rule, _grouped(rule["id"], "medium", kind, f"coalesce({key}, 'unknown')", source, f">= {_BOUNDS[kind]}",
                          f", CAST(floor(epoch(ts)) AS BIGINT) // {seconds}")


_RULE_SET = [_event_rule(n) for n in range(40)] + [_trailing_rule(n) for n in range(40)] + [_tumbling_rule(n) for n in range(20)]
_ALL_FOUND = " UNION ALL ".join(sql for _, sql in _RULE_SET)
_GROUPS_FOUND = " UNION ALL ".join(sql for _, sql in [_RULE_SET[0], *_RULE_SET[40:]])


def _compiled_set(t: Tables):
    fields = EventFields(t.sec_events.schema)
    rules, refused = compile_rules([rule for rule, _ in _RULE_SET], fields)
    assert not refused
    return rules, fields


@query("run_rule_set", with_views(f"""
    SELECT rule_id, severity, event_id, group_key, first_seen, last_seen, CAST(event_count AS BIGINT) AS event_count,
      round(aggregated_value, 4) AS aggregated_value FROM ({_ALL_FOUND})""", "sec_events"))
def run_rule_set(t: Tables):
    """A hundred rules of both formats and all kinds over one table."""
    rules, fields = _compiled_set(t)
    return run_rules(t.sec_events, rules, fields).withColumn("aggregated_value", F.round("aggregated_value", 4)).drop("rule_name")


@query("rule_set_alerts", with_views("""
    SELECT k AS dedup_key, n AS alert_count, first_seen, last_seen FROM periods""", "sec_events", ctes=f"""
    found AS ({_GROUPS_FOUND}),
    raised AS (SELECT concat('dedup:', sha256(concat(rule_id, ':', CASE WHEN group_key = '' THEN 'unknown' ELSE group_key END,
        ':unknown'))) AS dedup_key, last_seen AS ts FROM found WHERE group_key IS NOT NULL),"""
    + periods_sql("raised", "dedup_key", "ts", 24 * 3600)))
def rule_set_alerts(t: Tables):
    """The groups that the set finds, as alerts: at most one a day for a rule and group."""
    rules, fields = _compiled_set(t)
    alerts = create_group_alerts(aggregate_rules(t.sec_events, rules, fields))
    return deduplicate(alerts, 24 * 3600).select("dedup_key", "alert_count", "first_seen", "last_seen")
