"""Alert, asset and audit reads, roll-ups, top lists, health and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ANALYTIC_TABLES
from ..operators import alerts as A
from ..operators import records as R
from ..operators import rollups as K
from .bindings import AS_OF, ORDERS_AS_OF, Tables, as_of, with_views
from .catalog import query

_SINCE = "2001-07-01 00:00:00"
_AUDIT_COLUMNS = '"timestamp", id, user_name, action'
_ALERT = "alert_id, rule_id, severity, status, triggered_at, created_at, risk_score"


def _alert_columns(rows):
    return rows.select(*_ALERT.split(", "))


# ---------------------------------------------------------------- alert reads
@query("alert_recent", with_views(f"""
    SELECT {_ALERT} FROM alerts WHERE triggered_at >= TIMESTAMP '{_SINCE}' AND severity = 'high'""", "alerts"))
def alert_recent(t: Tables):
    return _alert_columns(A.recent_alerts(t.alerts, as_of(_SINCE), "High"))


@query("alert_by_rule", with_views(f"""
    SELECT {_ALERT} FROM alerts WHERE rule_id = 'rule-3'
    ORDER BY triggered_at DESC, created_at DESC, alert_id LIMIT 100""", "alerts"))
def alert_by_rule(t: Tables):
    return _alert_columns(A.alerts_by_rule(t.alerts, "rule-3", 0))


@query("alert_page", with_views(f"""
    SELECT {_ALERT}, (SELECT count(*) FROM alerts WHERE severity = 'critical') AS total_count,
      CAST(ceil((SELECT count(*) FROM alerts WHERE severity = 'critical') / 25.0) AS BIGINT) AS total_pages
    FROM alerts WHERE severity = 'critical' ORDER BY triggered_at DESC, created_at DESC, alert_id
    LIMIT 25 OFFSET 50""", "alerts"))
def alert_page(t: Tables):
    page = A.alert_page(t.alerts, 3, 25, "critical")
    return page.select(*_ALERT.split(", "), "total_count", "total_pages")


@query("alert_page_deep", with_views(f"""
    SELECT {_ALERT}, (SELECT count(*) FROM alerts) AS total_count,
      CAST(ceil((SELECT count(*) FROM alerts) / 100.0) AS BIGINT) AS total_pages
    FROM alerts ORDER BY triggered_at DESC, created_at DESC, alert_id LIMIT 100 OFFSET 14000""", "alerts"))
def alert_page_deep(t: Tables):
    """Page 141: found by counts, not by ordering all rows before it."""
    page = A.alert_page(t.alerts, 141, 100)
    return page.select(*_ALERT.split(", "), "total_count", "total_pages")


@query("audit_search_deep", with_views(f"""
    SELECT {_AUDIT_COLUMNS} FROM audit ORDER BY "timestamp" DESC, id LIMIT 250 OFFSET 12000""", "audit"))
def audit_search_deep(t: Tables):
    return R.search_audit(t.audit, limit=250, offset=12000).select("timestamp", "id", "user_name", "action")


@query("alert_page_after", with_views(f"""
    SELECT {_ALERT} FROM alerts WHERE severity = 'critical' AND (triggered_at < TIMESTAMP '{_SINCE}'
      OR triggered_at = TIMESTAMP '{_SINCE}' AND alert_id > 100)
    ORDER BY triggered_at DESC, alert_id LIMIT 25""", "alerts"))
def alert_page_after(t: Tables):
    return _alert_columns(A.alerts_after(t.alerts, 25, (as_of(_SINCE), 100), "critical"))


@query("alert_get", with_views(f"""
    SELECT {_ALERT}, 'id' AS found_by FROM alerts WHERE alert_id = 777
    UNION ALL SELECT * FROM (SELECT {_ALERT}, 'key' AS found_by FROM alerts WHERE dedup_key = 'dedup:77'
      ORDER BY triggered_at DESC, alert_id LIMIT 1)""", "alerts"))
def alert_get(t: Tables):
    by_id = _alert_columns(A.get_alert(t.alerts, alert_id=777)).withColumn("found_by", F.lit("id"))
    by_key = _alert_columns(A.get_alert(t.alerts, dedup_key="dedup:77")).withColumn("found_by", F.lit("key"))
    return by_id.unionByName(by_key)


@query("alert_stale", with_views(f"""
    SELECT alert_id, last_seen FROM alerts WHERE status = 'new' AND last_seen < TIMESTAMP '{_SINCE}'""", "alerts"))
def alert_stale(t: Tables):
    return A.stale_alerts(t.alerts, as_of(_SINCE)).select("alert_id", "last_seen")


@query("alert_update_status", with_views("""
    SELECT alert_id, CASE WHEN wanted IS NULL OR lower(wanted) = status THEN status ELSE wanted END AS status,
      coalesce(lower(wanted) <> status, false) AS changed
    FROM (SELECT *, CASE risk_score % 3 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'NEW' END AS wanted FROM alerts)""",
    "alerts"))
def alert_update_status(t: Tables):
    wanted = F.when(F.col("risk_score") % 3 == 0, F.lit("Resolved")).when(F.col("risk_score") % 3 == 1, F.lit("NEW"))
    updates = t.alerts.select("alert_id", wanted.alias("new_status")).filter("new_status is not null")
    return A.update_status(t.alerts, updates).select("alert_id", "status", "changed")


def _updates(t: Tables):
    """Two updates for a part of the alerts, and some for ids that do not exist."""
    base = t.alerts.filter("risk_score > 60").select("alert_id", "risk_score", "triggered_at", "severity")
    first = base.select("alert_id", F.lit("acknowledged").alias("status"), "severity",
                        F.col("triggered_at").alias("updated_at"))
    second = base.select(
        F.when(F.col("risk_score") % 10 == 0, -F.col("alert_id") - 1).otherwise(F.col("alert_id")).alias("alert_id"),
        F.lit("closed").alias("status"), F.lit("low").alias("severity"),
        (F.col("triggered_at") + F.make_interval(hours=F.lit(1))).alias("updated_at"))
    return first.unionByName(second)


_UPDATES_CTE = """updates AS (
    SELECT alert_id, 'acknowledged' AS status, severity, triggered_at AS updated_at FROM alerts WHERE risk_score > 60
    UNION ALL SELECT CASE WHEN risk_score % 10 = 0 THEN -alert_id - 1 ELSE alert_id END, 'closed', 'low',
      triggered_at + INTERVAL 1 HOUR FROM alerts WHERE risk_score > 60)"""


@query("alert_upsert", with_views("""
    SELECT a.alert_id, coalesce(u.status, a.status) AS status, coalesce(u.severity, a.severity) AS severity
    FROM alerts a LEFT JOIN (SELECT * FROM updates QUALIFY row_number() OVER
      (PARTITION BY alert_id ORDER BY updated_at DESC) = 1) u USING (alert_id)""", "alerts", ctes=_UPDATES_CTE))
def alert_upsert(t: Tables):
    return A.upsert_alerts(t.alerts, _updates(t))[0].select("alert_id", "status", "severity")


@query("alert_upsert_unknown", with_views("""
    SELECT alert_id, status FROM updates WHERE alert_id NOT IN (SELECT alert_id FROM alerts)""", "alerts",
    ctes=_UPDATES_CTE))
def alert_upsert_unknown(t: Tables):
    return A.upsert_alerts(t.alerts, _updates(t))[1].select("alert_id", "status")


@query("alert_auto_resolve", with_views(f"""
    SELECT alert_id, CASE WHEN stale THEN 'resolved' ELSE status END AS status,
      CASE WHEN stale THEN 'Auto-resolved due to inactivity' END AS resolution_comment
    FROM (SELECT *, status = 'new' AND last_seen < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 24 HOUR AS stale
          FROM alerts)""", "alerts"))
def alert_auto_resolve(t: Tables):
    return A.auto_resolve(t.alerts, as_of(ORDERS_AS_OF)).select("alert_id", "status", "resolution_comment")


# ------------------------------------------------------------- assets and audit
@query("asset_list", with_views("""
    SELECT id, name, ip_address, criticality FROM assets
    WHERE (name ILIKE '%00001%' OR ip_address ILIKE '%00001%' OR hostname ILIKE '%00001%')
      AND criticality = 'high' AND owner ILIKE '%USER_1%' AND list_contains(string_split(tag_text, ','), 'zone_1')
    ORDER BY created_at DESC, id LIMIT 20""", "assets"))
def asset_list(t: Tables):
    return R.list_assets(t.assets, search="00001", criticality="HIGH", owner="USER_1", tag="zone_1", size=20) \
        .select("id", "name", "ip_address", "criticality")


@query("asset_lookup", with_views("""
    SELECT 'id' AS found_by, id FROM assets WHERE id = 77
    UNION ALL SELECT 'ip', id FROM assets WHERE ip_address = '10.0.1.25'
    UNION ALL SELECT 'host', id FROM assets WHERE lower(hostname) = 'host_33'""", "assets"))
def asset_lookup(t: Tables):
    found = [("id", {"asset_id": 77}), ("ip", {"ip": "10.0.1.25"}), ("host", {"hostname": "HOST_33"})]
    parts = [R.lookup_asset(t.assets, **how).select(F.lit(by).alias("found_by"), "id") for by, how in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("audit_search", with_views(f"""
    SELECT {_AUDIT_COLUMNS} FROM audit WHERE user_name = 'user_7' AND action = 'login'
      AND "timestamp" >= TIMESTAMP '1997-01-01' AND "timestamp" <= TIMESTAMP '2000-01-01'
    ORDER BY "timestamp" DESC, id LIMIT 5000 OFFSET 5""", "audit"))
def audit_search(t: Tables):
    return R.search_audit(t.audit, user="user_7", action="login", since=as_of("1997-01-01 00:00:00"),
                          until=as_of("2000-01-01 00:00:00"), limit=5000, offset=5) \
        .select("timestamp", "id", "user_name", "action")


@query("audit_summary", with_views("""
    SELECT user_name, action, resource_type, status, CAST("timestamp" AS DATE) AS event_date, count(*) AS event_count
    FROM audit GROUP BY ALL""", "audit"))
def audit_summary(t: Tables):
    return R.audit_summary(t.audit)


@query("audit_decode_json", with_views("""
    SELECT id, old_state ->> '$.status' AS old_status, old_state ->> '$.owner' AS old_owner,
      new_state ->> '$.status' AS new_status, metadata ->> '$.key' AS meta_key FROM audit""", "audit"))
def audit_decode(t: Tables):
    return R.decode_audit(t.audit).select(
        "id", F.col("old_state.status").alias("old_status"), F.col("old_state.owner").alias("old_owner"),
        F.col("new_state.status").alias("new_status"), F.col("metadata.key").alias("meta_key"))


# -------------------------------------------------------------------- roll-ups
@query("top_talkers", with_views(f"""
    SELECT CAST(ts AS DATE) AS event_date, source_ip, destination_ip, count(*) AS connection_count,
      CAST(sum(bytes_sent) AS BIGINT) AS total_bytes_sent, CAST(sum(bytes_received) AS BIGINT) AS total_bytes_received
    FROM sec_events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts < TIMESTAMP '{AS_OF}'
    GROUP BY ALL""", "sec_events"))
def top_talkers(t: Tables):
    return K.top_talkers(t.sec_events, as_of())


@query("alert_stats_hourly", with_views("""
    SELECT CAST(triggered_at AS DATE) AS alert_date, date_trunc('hour', triggered_at) AS alert_hour, severity,
      count(*) AS alert_count, round(avg(risk_score), 6) AS avg_risk_score FROM alerts GROUP BY ALL""", "alerts"))
def alert_stats_hourly(t: Tables):
    return K.read_alert_stats(K.alert_stats(t.alerts)) \
        .withColumn("avg_risk_score", F.round("avg_risk_score", 6))


@query("user_hourly_activity", with_views("""
    SELECT CAST(ts AS DATE) AS event_date, username, CAST(hour(ts) AS INT) AS hour_of_day, count(*) AS event_count
    FROM sec_events WHERE username <> '' GROUP BY ALL""", "sec_events"))
def user_hourly_activity(t: Tables):
    return K.user_hourly_activity(t.sec_events)


@query("user_host_connections", with_views("""
    SELECT CAST(ts AS DATE) AS event_date, username, hostname, count(*) AS connection_count,
      count(DISTINCT destination_port) FILTER (destination_port > 0) AS unique_ports
    FROM sec_events WHERE username <> '' AND hostname <> '' GROUP BY ALL""", "sec_events"))
def user_host_connections(t: Tables):
    return K.user_host_connections(t.sec_events)


_CLOSE = "abs(unique_ports - exact) <= 0.05 * exact"


@query("user_host_port_sketches", with_views("""
    SELECT username, hostname, count(*) AS connection_count, true AS is_close FROM sec_events
    WHERE username <> '' AND hostname <> '' GROUP BY ALL""", "sec_events"))
def user_host_port_sketches(t: Tables):
    """Daily sketches merged to one estimate per user and host, held against the exact number."""
    keys = ["username", "hostname"]
    exact = t.sec_events.groupBy(*keys).agg(F.count_distinct("destination_port").alias("exact"))
    merged = K.merge_port_sketches(K.port_sketches(t.sec_events), keys).join(exact, keys)
    return merged.select(*keys, "connection_count", F.expr(_CLOSE).alias("is_close"))


# ------------------------------------------------------------------- top lists
_SEVERITY_RANK = ("CASE severity WHEN 'unknown' THEN 0 WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 "
                  "WHEN 'high' THEN 4 WHEN 'critical' THEN 5 END")


@query("top_source_ips", with_views(f"""
    SELECT source_ip, count(*) AS alert_count, arg_max(severity, {_SEVERITY_RANK}) AS max_severity,
      round(avg(bytes_sent), 4) AS avg_bytes
    FROM sec_events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts < TIMESTAMP '{AS_OF}'
    GROUP BY source_ip ORDER BY alert_count DESC, source_ip LIMIT 10""", "sec_events"))
def top_source_ips(t: Tables):
    return K.top_sources(t.sec_events, as_of()).withColumn("avg_bytes", F.round("avg_bytes", 4))


@query("severity_distribution", with_views(f"""
    SELECT severity, count(*) AS event_count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage
    FROM sec_events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{AS_OF}'
    GROUP BY severity""", "sec_events"))
def severity_distribution(t: Tables):
    return K.severity_distribution(t.sec_events, as_of()).withColumn("percentage", F.round("percentage", 6))


@query("user_activity", with_views(f"""
    SELECT username, hostname, CAST(hour(ts) AS INT) AS hour, count(*) AS event_count,
      CAST(sum(bytes_sent) AS BIGINT) AS data_transferred
    FROM sec_events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR AND ts < TIMESTAMP '{AS_OF}'
    GROUP BY username, hostname, hour(ts) HAVING count(*) > 4
    ORDER BY event_count DESC, username, hostname, hour LIMIT 100""", "sec_events"))
def user_activity(t: Tables):
    return K.user_activity(t.sec_events, as_of(), more_than=4, hours=720)


@query("exfil_top_pairs", with_views(f"""
    SELECT source_ip, destination_ip, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, count(*) AS connection_count
    FROM sec_events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR AND ts < TIMESTAMP '{AS_OF}'
      AND event_type = 'network_traffic'
    GROUP BY ALL ORDER BY total_bytes DESC, source_ip, destination_ip LIMIT 50""", "sec_events"))
def exfil_top_pairs(t: Tables):
    return K.top_pairs(t.sec_events, as_of(), "network_traffic", hours=240)


@query("alert_list_filtered", with_views(f"""
    SELECT {_ALERT} FROM alerts WHERE severity IN ('high', 'critical') AND rule_id = 'rule-3'
      AND created_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 4800 HOUR AND created_at < TIMESTAMP '{ORDERS_AS_OF}'
    ORDER BY created_at DESC, alert_id LIMIT 100""", "alerts"))
def alert_list_filtered(t: Tables):
    return _alert_columns(K.filtered_alerts(t.alerts, as_of(ORDERS_AS_OF), "high", "rule-3", hours=4800))


@query("risk_summary", with_views(f"""
    SELECT CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40
      THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS alert_count, round(avg(risk_score), 6) AS avg_risk
    FROM alerts WHERE triggered_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 70 DAY
      AND triggered_at < TIMESTAMP '{ORDERS_AS_OF}' GROUP BY ALL""", "alerts"))
def risk_summary(t: Tables):
    from ..operators.risk import risk_level
    levels = t.alerts.withColumn("risk_level", risk_level(F.col("risk_score")))
    return K.risk_summary(levels, as_of(ORDERS_AS_OF), days=70) \
        .select("risk_level", "alert_count", F.round("avg_risk", 6).alias("avg_risk"))


# ---------------------------------------------------------------------- health
@query("health_rates", with_views("""
    SELECT step_start, coalesce(events, 0) AS events, round(coalesce(events, 0) / 300.0, 6) AS rate,
      round(errors / events, 6) AS error_share
    FROM (SELECT unnest(generate_series(min(s), max(s), INTERVAL 5 MINUTE)) AS step_start FROM counted)
    LEFT JOIN (SELECT s AS step_start, events, errors FROM counted) USING (step_start)""", "sec_events", ctes="""
    counted AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS s, count(*) AS events,
      count(*) FILTER (severity IN ('high', 'critical')) AS errors FROM sec_events GROUP BY ALL)"""))
def health_rates(t: Tables):
    rates = K.event_rates(t.sec_events, errors=F.col("severity").isin("high", "critical"))
    return rates.withColumns({"rate": F.round("rate", 6), "error_share": F.round("error_share", 6)})


@query("health_trailing", with_views("""
    SELECT step_start, round(sum(events) OVER w / 900.0, 6) AS trailing_rate,
      round(CASE WHEN sum(events) OVER w > 0 THEN sum(errors) OVER w / sum(events) OVER w END, 6) AS trailing_error_share
    FROM (SELECT step_start, coalesce(events, 0) AS events, coalesce(errors, 0) AS errors FROM
      (SELECT unnest(generate_series(min(s), max(s), INTERVAL 5 MINUTE)) AS step_start FROM counted)
      LEFT JOIN (SELECT s AS step_start, events, errors FROM counted) USING (step_start))
    WINDOW w AS (ORDER BY step_start ROWS 2 PRECEDING)""", "sec_events", ctes="""
    counted AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS s, count(*) AS events,
      count(*) FILTER (severity IN ('high', 'critical')) AS errors FROM sec_events GROUP BY ALL)"""))
def health_trailing(t: Tables):
    rates = K.trailing_rates(K.event_rates(t.sec_events, errors=F.col("severity").isin("high", "critical")))
    return rates.select("step_start", F.round("trailing_rate", 6).alias("trailing_rate"),
                        F.round("trailing_error_share", 6).alias("trailing_error_share"))


@query("health_ceiling", with_views("""
    SELECT min(h) AS held_from, max(h) + INTERVAL 1 HOUR AS held_until FROM
      (SELECT h, h - to_hours(CAST(row_number() OVER (ORDER BY h) AS INT)) AS run FROM
        (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, count(*) AS n FROM sec_events GROUP BY 1) WHERE n / 3600.0 > 0.004)
    GROUP BY run HAVING count(*) >= 2""", "sec_events"))
def health_ceiling(t: Tables):
    """Times of two hours or more in which the rate stays above a ceiling."""
    rates = K.event_rates(t.sec_events, step="1 hour", seconds=3600, empty=False)
    return K.held_above(rates, "rate", 0.004, 7200, seconds=3600)


@query("health_silence", with_views("""
    SELECT s + INTERVAL 5 MINUTE AS silent_from, nxt AS silent_until,
      CAST((epoch(nxt) - epoch(s) - 300) // 300 AS BIGINT) AS steps
    FROM (SELECT s, lead(s) OVER (ORDER BY s) AS nxt FROM
      (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS s FROM sec_events))
    WHERE epoch(nxt) - epoch(s) - 300 >= 600""", "sec_events"))
def health_silence(t: Tables):
    return K.silent_stretches(t.sec_events)


@query("health_percentiles", with_views("""
    SELECT hostname AS service, time_bucket(INTERVAL 1 DAY, ts) AS step_start,
      round(quantile_cont(bytes_sent, 0.5), 4) AS p50, round(quantile_cont(bytes_sent, 0.95), 4) AS p95,
      round(quantile_cont(bytes_sent, 0.99), 4) AS p99 FROM sec_events GROUP BY ALL""", "sec_events"))
def health_percentiles(t: Tables):
    found = K.latency_percentiles(t.sec_events, "hostname", "bytes_sent", step="1 day")
    return found.withColumns({name: F.round(name, 4) for name in ("p50", "p95", "p99")})


# ------------------------------------------------------------------- retention
# The nine stored tables, bound to the given ones: rows of the view, a filter, their time.
_STORED = {
    "events": ("sec_events", "true", "ts"), "network_events": ("sec_events", "event_type = 'network_traffic'", "ts"),
    "security_alerts": ("alerts", "severity <> 'low'", "triggered_at"),
    "dns_queries": ("sec_events", "event_type = 'dns_query'", "ts"),
    "tls_sessions": ("sec_events", "destination_port = 443", "ts"),
    "application_metrics": ("sec_events", "bytes_sent > 0", "ts"),
    "baseline_features": ("sec_events", "username <> ''", "ts"),
    "audit_events": ("audit", "true", "timestamp"), "alerts": ("alerts", "true", "created_at"),
}


@query("retention", with_views(" UNION ALL ".join(f"""
    SELECT '{name}' AS table_name, {ANALYTIC_TABLES[name][2]} AS days,
      count(*) FILTER ("{ts}" >= TIMESTAMP '2024-02-10' - INTERVAL {ANALYTIC_TABLES[name][2]} DAY) AS kept,
      count(*) FILTER ("{ts}" < TIMESTAMP '2024-02-10' - INTERVAL {ANALYTIC_TABLES[name][2]} DAY) AS dropped
    FROM {view} WHERE {rows}""" for name, (view, rows, ts) in _STORED.items()), "sec_events", "alerts", "audit"))
def retention(t: Tables):
    return K.retention_report({name: (getattr(t, view).filter(rows), ts) for name, (view, rows, ts) in _STORED.items()},
                              as_of("2024-02-10 00:00:00"))


@query("retention_keep", with_views("""
    SELECT event_id FROM sec_events WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY""", "sec_events"))
def retention_keep(t: Tables):
    return K.retained(t.sec_events, as_of("2024-02-10 00:00:00"), 30, "ts").select("event_id")
