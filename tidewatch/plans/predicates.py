"""Rule predicates and stateless rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fields import EventFields
from ..operators.predicates import predicate
from ..operators.rules import (
    compile_rule, compile_rules, match_context, match_rule, match_rules, matched_conditions, v2_match)
from .bindings import Tables, with_views
from .catalog import query

# Loose number reading in SQL, for the comparison only.
_NUM = "CASE WHEN regexp_matches(trim(replace({0}, ',', '')), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') " \
       "THEN TRY_CAST(trim(replace({0}, ',', '')) AS DOUBLE) END"
_POINTS = _NUM.format("m_points")

# name -> list of (output, field, operator, value, options, SQL condition that is never null)
CASES = {
    "cond_equals": [
        ("severity_hit", "severity", "equals", "high", {}, "severity = 'high'"),
        ("case_hit", "failure_reason", "equals", "ACCOUNT_disabled", {"case_sensitive": False},
         "coalesce(lower(m_failure_reason) = 'account_disabled', false)"),
        ("number_hit", "risk_points", "equals", "1,105", {}, f"coalesce({_POINTS} = 1105, false)"),
        ("null_hit", "failure_reason", "equals", None, {}, "m_failure_reason IS NULL"),
        ("port_hit", "destination_port", "equals", "22", {}, "coalesce(destination_port = 22, false)"),
    ],
    "cond_not_equals": [
        ("severity_hit", "severity", "not_equals", "high", {}, "severity <> 'high'"),
        ("missing_hit", "failure_reason", "not_equals", "invalid_password", {},
         "coalesce(m_failure_reason <> 'invalid_password', true)"),
    ],
    "cond_contains": [
        ("plain_hit", "query_name", "contains", "evil", {}, "coalesce(contains(m_query_name, 'evil'), false)"),
        ("case_hit", "query_name", "contains", "EVIL", {"case_sensitive": False},
         "coalesce(contains(lower(m_query_name), 'evil'), false)"),
    ],
    "cond_not_contains": [
        ("hit", "query_name", "not_contains", "botnet", {}, "NOT coalesce(contains(m_query_name, 'botnet'), false)"),
    ],
    "cond_starts_with": [
        ("hit", "source_ip", "starts_with", "203.0.113.1", {}, "starts_with(source_ip, '203.0.113.1')"),
        ("case_hit", "query_name", "starts_with", "EVIL", {"case_sensitive": False},
         "coalesce(starts_with(lower(m_query_name), 'evil'), false)"),
    ],
    "cond_ends_with": [
        ("hit", "process_name", "ends_with", ".ps1", {"case_sensitive": False},
         "coalesce(ends_with(lower(m_process_name), '.ps1'), false)"),
    ],
    "cond_greater_than": [
        ("hit", "bytes_sent", "greater_than", 1000000, {}, "bytes_sent > 1000000"),
        ("text_hit", "risk_points", "greater_than", 300, {}, f"coalesce({_POINTS} > 300, false)"),
    ],
    "cond_greater_than_or_equal": [
        ("hit", "hour_of_day", "greater_than_or_equal", 22, {}, "hour(ts) >= 22"),
        ("text_hit", "risk_points", "greater_than_or_equal", "1,150", {}, f"coalesce({_POINTS} >= 1150, false)"),
    ],
    "cond_less_than": [
        ("hit", "destination_port", "less_than", 10, {}, "destination_port < 10"),
        ("text_hit", "risk_points", "less_than", 20, {}, f"coalesce({_POINTS} < 20, false)"),
    ],
    "cond_less_than_or_equal": [
        ("hit", "bytes_sent", "less_than_or_equal", 50000, {}, "bytes_sent <= 50000"),
    ],
    "cond_in": [
        ("hit", "failure_reason", "in", ["account_locked", "timeout"], {},
         "coalesce(m_failure_reason IN ('account_locked', 'timeout'), false)"),
        ("hour_hit", "hour_of_day", "in", [3, 9, 15, 21], {}, "hour(ts) IN (3, 9, 15, 21)"),
        ("mixed_hit", "risk_points", "in", [12, "n/a"], {},
         f"coalesce({_POINTS} = 12, false) OR coalesce(m_points = 'n/a', false)"),
    ],
    "cond_not_in": [
        ("hit", "failure_reason", "not_in", ["invalid_password"], {},
         "NOT coalesce(m_failure_reason IN ('invalid_password'), false)"),
        ("day_hit", "day_of_week", "not_in", ["Monday", "Friday"], {}, "dayname(ts) NOT IN ('Monday', 'Friday')"),
    ],
    "cond_regex": [
        ("hit", "metadata.queryName", "regex", "^[A-Z]*[05][.]example[.]com$", {},
         "coalesce(regexp_matches(m_query_name, '(?i)^[a-z]*[05][.]example[.]com$'), false)"),
        ("broken_hit", "query_name", "regex", "(unclosed", {}, "false"),
    ],
    "cond_exists": [("hit", "process_name", "exists", None, {}, "m_process_name IS NOT NULL"),
                    ("ip_hit", "source_ip", "exists", None, {}, "source_ip IS NOT NULL")],
    "cond_not_exists": [("hit", "build_number", "not_exists", None, {}, "true"),
                        ("reason_hit", "failure_reason", "not_exists", None, {}, "m_failure_reason IS NULL")],
    "cond_negate": [
        ("hit", "query_name", "contains", "www", {"negate": True}, "NOT coalesce(contains(m_query_name, 'www'), false)"),
        ("not_in_hit", "failure_reason", "not_in", ["account_locked"], {"negate": True},
         "coalesce(m_failure_reason IN ('account_locked'), false)"),
    ],
}


def _predicate_query(cases):
    def build(t: Tables):
        fields = EventFields(t.rich_events.schema)
        return t.rich_events.select("event_id", *[
            predicate(fields.resolve(field), operator, value, **options).alias(output)
            for output, field, operator, value, options, _ in cases])
    return build


for _name, _cases in CASES.items():
    _columns = ", ".join(f"({condition}) AS {output}" for output, *_, condition in _cases)
    query(_name, with_views(f"SELECT event_id, {_columns} FROM sec_events", "sec_events"))(_predicate_query(_cases))


@query("resolve_field", with_views("""
    SELECT event_id, source_ip AS by_alias, m_failure_reason AS by_camel, m_query_name AS by_path,
           m_points AS by_variant, CAST(hour(ts) AS INT) AS hour_value, dayname(ts) AS day_value,
           CAST(NULL AS VARCHAR) AS absent FROM sec_events""", "sec_events"))
def resolve_field(t: Tables):
    f = EventFields(t.rich_events.schema)
    return t.rich_events.select(
        "event_id", f.resolve("SourceIp").text.alias("by_alias"), f.resolve("failure_reason").text.alias("by_camel"),
        f.resolve("metadata.query_name").text.alias("by_path"), f.resolve("risk points").text.alias("by_variant"),
        f.resolve("hourOfDay").column.alias("hour_value"), f.resolve("day_of_week").text.alias("day_value"),
        f.resolve("metadata.nothing").text.alias("absent"))


# ------------------------------------------------------------------------ rules
RULES = [
    {"id": "barred-inside", "name": "Barred account inside", "severity": "medium",
     "triggers": [{"type": "event", "eventType": "authentication_failure", "filters": {"severity": "LOW"}}],
     "conditions": [{"field": "failure_reason", "operator": "starts_with", "value": "ACCOUNT", "caseSensitive": False},
                    {"field": "destination_ip", "operator": "contains", "value": "192.168."}]},
    {"id": "numbered-zone", "name": "Lookup of a numbered zone", "severity": "high",
     "triggers": [{"type": "event", "eventType": "dns_query"}],
     "conditions": [{"field": "query_name", "operator": "exists"},
                    {"field": "query_name", "operator": "regex", "value": "^[a-z]+2[0-9][.].*$"}]},
    {"id": "shell-script", "name": "Shell script off the build host", "severity": "critical",
     "triggers": [{"type": "event", "eventType": "process_execution"}],
     "conditions": [{"field": "process_name", "operator": "ends_with", "value": ".sh"},
                    {"field": "hostname", "operator": "equals", "value": "host_3", "negate": True},
                    {"field": "build_number", "operator": "not_exists"}]},
    {"id": "midweek-noon", "name": "Wednesday noon", "severity": "low", "triggers": [],
     "conditions": [{"field": "hour_of_day", "operator": "greater_than_or_equal", "value": 11},
                    {"field": "hour_of_day", "operator": "less_than", "value": 13},
                    {"field": "day_of_week", "operator": "in", "value": ["Wednesday"]}]},
    {"id": "thin-answer", "name": "Little received on a high port", "severity": "critical",
     "triggers": [{"type": "event", "eventType": "network_traffic"}],
     "conditions": [{"field": "bytes_received", "operator": "less_than_or_equal", "value": 60000},
                    {"field": "destination_port", "operator": "greater_than", "value": 40}]},
]
_RULE_SQL = {
    "barred-inside": "event_type = 'authentication_attempt' AND severity = 'low' AND "
                     "coalesce(starts_with(lower(m_failure_reason), 'account'), false) AND contains(destination_ip, '192.168.')",
    "numbered-zone": "event_type = 'dns_query' AND coalesce(regexp_matches(m_query_name, '(?i)^[a-z]+2[0-9][.]'), false)",
    "shell-script": "event_type = 'process_execution' AND coalesce(ends_with(m_process_name, '.sh'), false) "
                    "AND hostname <> 'host_3'",
    "midweek-noon": "hour(ts) IN (11, 12) AND dayname(ts) = 'Wednesday'",
    "thin-answer": "event_type = 'network_traffic' AND bytes_received <= 60000 AND destination_port > 40",
}
RULE_MATCH_CTE = "rule_matches AS (" + " UNION ALL ".join(
    f"SELECT *, '{rule['id']}' AS rule_id, '{rule['name']}' AS rule_name, '{rule['severity']}' AS rule_severity "
    f"FROM sec_events WHERE {_RULE_SQL[rule['id']]}" for rule in RULES) + ")"


def compiled_rules(events, rules=None):
    return compile_rules(rules or RULES, EventFields(events.schema))[0]


@query("match_trigger", with_views("""
    SELECT event_id, event_type = 'authentication_attempt' AND severity = 'low' AS filtered,
           event_type = 'authentication_attempt' OR (event_type = 'dns_query' AND username = 'user_7') AS either,
           true AS without_triggers, false AS unknown_type FROM sec_events""", "sec_events"))
def match_trigger(t: Tables):
    from ..operators.rules import trigger_column
    fields = EventFields(t.rich_events.schema)
    trigger = lambda *triggers: trigger_column(list(triggers), fields)
    return t.rich_events.select(
        "event_id",
        trigger({"type": "event", "eventType": "authentication_failure", "filters": {"severity": "LOW"}})
        .alias("filtered"),
        trigger({"type": "event", "eventType": "AuthenticationAttempt"},
                {"type": "event", "eventType": "dns_query", "filters": {"username": "USER_7"}}).alias("either"),
        trigger().alias("without_triggers"),
        trigger({"type": "event", "eventType": "no_such_type"}).alias("unknown_type"))


@query("match_rule", with_views(
    f"SELECT event_id, source_ip FROM sec_events WHERE {_RULE_SQL['numbered-zone']}", "sec_events"))
def match_one_rule(t: Tables):
    rule = compile_rule(RULES[1], EventFields(t.rich_events.schema))
    return match_rule(t.rich_events, rule).select("event_id", "source_ip")


@query("match_all_rules", with_views(
    "SELECT event_id, rule_id, rule_name, rule_severity FROM rule_matches", "sec_events", ctes=RULE_MATCH_CTE))
def match_all_rules(t: Tables):
    return match_rules(t.rich_events, compiled_rules(t.rich_events)) \
        .select("event_id", "rule_id", "rule_name", "rule_severity")


@query("matched_conditions", with_views("""
    SELECT event_id,
      CASE WHEN m_query_name IS NULL THEN ''
           WHEN regexp_matches(m_query_name, '(?i)^[a-z]+2[0-9][.]')
             THEN 'query_name exists|query_name regex ^[a-z]+2[0-9][.].*$'
           ELSE 'query_name exists' END AS matched FROM sec_events""", "sec_events"))
def explain_match(t: Tables):
    rule = compile_rule(RULES[1], EventFields(t.rich_events.schema))
    return t.rich_events.select("event_id", F.array_join(matched_conditions(rule), "|").alias("matched"))


@query("match_context", with_views("""
    SELECT event_id, source_ip AS "sourceIp", destination_ip AS "destinationIp", event_type AS "eventType",
           m_failure_reason AS "failureReason", CAST(4 + (m_failure_reason IS NOT NULL)::INT
             + (m_process_name IS NOT NULL)::INT + (m_query_name IS NOT NULL)::INT + (m_points IS NOT NULL)::INT
             + (m_artifact IS NOT NULL)::INT AS INT) AS entries FROM sec_events""", "sec_events"))
def context_of_match(t: Tables):
    context = t.rich_events.select("event_id", match_context(EventFields(t.rich_events.schema)).alias("c"))
    return context.select("event_id", "c.sourceIp", "c.destinationIp", "c.eventType", "c.failureReason",
                          F.size("c").alias("entries"))


V2_RULES = [
    {"id": "v2-reason", "name": "V2 reason", "severity": "HIGH", "enabled": True,
     "trigger": {"source_types": ["authentication_attempt"], "match": {"severity": "Low"}},
     "condition": {"field": "failure_reason", "operator": "not_equals", "value": "ACCOUNT_LOCKED"}},
    {"id": "v2-points", "name": "V2 points", "severity": "odd", "enabled": True, "trigger": {},
     "condition": {"field": "risk_points", "operator": "greater_than", "value": 1150}},
    {"id": "v2-ports", "name": "V2 ports", "severity": "low", "enabled": True,
     "trigger": {"source_types": ["dns_query", "http_request"]},
     "condition": {"field": "destination_port", "operator": "in", "value": ["22", "80", "99"]}},
    {"id": "v2-alias", "name": "V2 alias", "severity": "low", "enabled": True, "trigger": {},
     "condition": {"field": "bytes_sent", "operator": "greater_than_or_equal", "value": 2000000}},
]


@query("match_rule_v2", with_views(f"""
    SELECT event_id,
      event_type = 'authentication_attempt' AND severity = 'low'
        AND coalesce(upper(m_failure_reason), '') <> 'ACCOUNT_LOCKED' AS reason,
      CASE WHEN ({_POINTS}) IS NOT NULL THEN ({_POINTS}) > 1150 ELSE coalesce(upper(m_points), '') > '1150' END AS points,
      event_type IN ('dns_query', 'http_request') AND destination_port IN (22, 80, 99) AS ports
    FROM sec_events""", "sec_events"))
def second_format(t: Tables):
    fields = EventFields(t.rich_events.schema)
    return t.rich_events.select("event_id", *[
        v2_match(rule, fields).alias(name) for rule, name in zip(V2_RULES, ["reason", "points", "ports"])])


@query("convert_v2_rules", with_views(f"""
    SELECT event_id, 'v2-reason' AS rule_id, 'high' AS rule_severity FROM sec_events
    WHERE event_type = 'authentication_attempt' AND severity = 'low'
      AND coalesce(upper(m_failure_reason), '') <> 'ACCOUNT_LOCKED'
    UNION ALL SELECT event_id, 'v2-points', 'medium' FROM sec_events
    WHERE CASE WHEN ({_POINTS}) IS NOT NULL THEN ({_POINTS}) > 1150 ELSE coalesce(upper(m_points), '') > '1150' END
    UNION ALL SELECT event_id, 'v2-ports', 'low' FROM sec_events
    WHERE event_type IN ('dns_query', 'http_request') AND destination_port IN (22, 80, 99)
    UNION ALL SELECT event_id, 'v2-alias', 'low' FROM sec_events WHERE bytes_sent >= 2000000""", "sec_events"))
def converted(t: Tables):
    """The severities and names of converted rules; the second format's own evaluator says what matches."""
    rules = compiled_rules(t.rich_events, V2_RULES)
    return match_rules(t.rich_events, rules).select("event_id", "rule_id", "rule_severity")
