"""Alert creation, deduplication, lifecycle, risk and playbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import enrichment as E
from ..operators import history as HI
from ..operators import playbooks as P
from ..operators import risk as H
from ..operators import rollups as K
from ..operators import threat_intel as TI
from ..operators.rules import match_rules
from ..session import work_dir
from .baselining import BASELINES_CTE, COMBINED_CTE, combined_verdicts
from .bindings import AS_OF, Tables, as_of, with_views
from .catalog import query
from .correlating import periods_sql
from .enriching import _ASSET_KEYS, _INDICATORS, _SCORES, _scores
from .predicates import RULE_MATCH_CTE, compiled_rules

# ------------------------------------------------------------------- creation
_RANK = "CASE {0} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END"
_BOOSTED = ("CASE WHEN coalesce(greatest({s}, {d}) >= 2, false) THEN CASE {v} WHEN 'low' THEN 'medium' "
            "WHEN 'medium' THEN 'high' WHEN 'high' THEN 'critical' ELSE {v} END ELSE {v} END")
_CREATED = RULE_MATCH_CTE + ", " + _ASSET_KEYS + f""",
    created AS (SELECT sha256(concat(rule_id, '|', event_id)) AS alert_id, rule_id, rule_name,
      {_BOOSTED.format(s=_RANK.format('s.criticality'), d=_RANK.format('d.criticality'), v='rule_severity')} AS severity,
      'new' AS status, ts AS triggered_at, source_ip AS source, destination_ip AS destination, event_id,
      concat('dedup:', sha256(concat(rule_id, ':', source_ip, ':', destination_ip))) AS dedup_key
    FROM rule_matches LEFT JOIN asset_keys s ON s.k = lower(source_ip) LEFT JOIN asset_keys d ON d.k = lower(destination_ip))"""


def created_alerts(t: Tables):
    matches = match_rules(t.rich_events, compiled_rules(t.rich_events))
    tagged = E.join_assets(matches, E.asset_lookup(t.assets))
    return A.create_alerts(tagged, source_rank=E.criticality_rank(F.col("source_asset")),
                           destination_rank=E.criticality_rank(F.col("destination_asset")))


@query("alert_create", with_views("""
    SELECT alert_id, rule_id, rule_name, severity, status, triggered_at, source, destination, event_id,
      triggered_at AS created_at, triggered_at AS updated_at FROM created""",
    "sec_events", "assets", ctes=_CREATED))
def alert_create(t: Tables):
    return created_alerts(t).drop("dedup_key", "context", "aggregation_count", "aggregated_value")


@query("alert_severity_boost", with_views("""
    SELECT rule_id, severity, count(*) AS alerts FROM created GROUP BY ALL""", "sec_events", "assets", ctes=_CREATED))
def alert_severity_boost(t: Tables):
    return created_alerts(t).groupBy("rule_id", "severity").agg(F.count("*").alias("alerts"))


@query("alert_context", with_views("""
    SELECT event_id, source_ip AS ctx_source, m_failure_reason AS ctx_reason, username AS ctx_user,
      CASE WHEN m_failure_reason IS NULL AND m_process_name IS NULL AND m_query_name IS NULL AND m_points IS NULL
        AND m_artifact IS NULL THEN false ELSE true END AS has_metadata FROM sec_events""", "sec_events"))
def alert_context(t: Tables):
    context = A.alert_context(["event_id", "ts"], ["event_type", "severity", "source_ip", "username"], "metadata")
    read = lambda path: F.get_json_object("context", path)
    return t.rich_events.withColumn("context", context).select(
        "event_id", read("$.normalized.source_ip").alias("ctx_source"),
        read("$.normalized.metadata.failureReason").alias("ctx_reason"),
        read("$.normalized.username").alias("ctx_user"), read("$.normalized.metadata").isNotNull().alias("has_metadata"))


@query("alert_dedup_key", with_views(
    "SELECT alert_id, dedup_key FROM created", "sec_events", "assets", ctes=_CREATED))
def alert_dedup_key(t: Tables):
    return created_alerts(t).select("alert_id", "dedup_key")


@query("alert_dedup", with_views("""
    SELECT k AS dedup_key, n AS alert_count, p.first_seen, p.last_seen, c.alert_id, c.severity
    FROM periods p JOIN created c ON c.dedup_key = p.k AND c.triggered_at = p.first_seen
    QUALIFY row_number() OVER (PARTITION BY k, first_seen ORDER BY c.alert_id) = 1""",
    "sec_events", "assets", ctes=_CREATED + ", " + periods_sql("created", "dedup_key", "triggered_at", 3600)))
def alert_dedup(t: Tables):
    return A.deduplicate(created_alerts(t)).select(
        "dedup_key", "alert_count", "first_seen", "last_seen", "alert_id", "severity")


@query("alert_dedup_week", with_views("""
    SELECT k AS dedup_key, n AS alert_count, first_seen, last_seen FROM periods""",
    "sec_events", "assets", ctes=_CREATED + ", " + periods_sql("created", "dedup_key", "triggered_at", 7 * 86400)))
def alert_dedup_week(t: Tables):
    """A week-long period, in which many alerts of a key fall together."""
    return A.deduplicate(created_alerts(t), 7 * 86400).select("dedup_key", "alert_count", "first_seen", "last_seen")


# ------------------------------------------------------------------- lifecycle
# Commands come from the order lines: each line of an order is one command to
# the alert of that order. Line numbers repeat, so they are put in order by
# part as well; ``seq`` makes the order total.
_COMMAND_STATUS = ("CASE CAST(floor(l_quantity) AS INT) % 7 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'under_investigation' "
                   "WHEN 2 THEN 'resolved' WHEN 3 THEN 'closed' WHEN 4 THEN 'false_positive' WHEN 5 THEN 'acknowledged' "
                   "ELSE 'pending_score' END")
_LINE_NO = ("CAST(l_partkey AS BIGINT) * 100000000 + CAST(round(l_extendedprice) AS BIGINT) * 10 + l_linenumber")
_FORCED = "CAST(floor(l_quantity) AS INT) % 7 IN (2, 4) AND l_returnflag = 'R'"


def _command_view(force: str) -> list[str]:
    return ["l_orderkey AS alert_id", f"{_COMMAND_STATUS} AS new_status", f"{_LINE_NO} AS seq", f"{force} AS force",
            "concat('part ', l_partkey) AS comment", "concat('flag ', l_returnflag) AS reason"]


def commands(t: Tables, force: str = "false"):
    lines = t.raw("lineitem")
    return lines.selectExpr("l_shipdate AS at", *_command_view(force))


def lifecycle_sql(force: str = "false") -> str:
    """Sequential walk over each alert's commands."""
    moves = [("new", "acknowledged"), ("new", "pending_score"), ("new", "false_positive"), ("pending_score", "new"),
             ("pending_score", "acknowledged"), ("pending_score", "false_positive"),
             ("acknowledged", "under_investigation"), ("acknowledged", "resolved"), ("acknowledged", "false_positive"),
             ("under_investigation", "resolved"), ("under_investigation", "closed"),
             ("under_investigation", "false_positive"), ("resolved", "closed"), ("resolved", "acknowledged"),
             ("closed", "acknowledged"), ("false_positive", "closed")]
    allowed = " OR ".join(f"({{old}} = '{a}' AND c.new_status = '{b}')" for a, b in moves)

    def step(old: str) -> str:
        ok = f"(c.force OR {old} = c.new_status OR {allowed.format(old=old)})"
        return f"{old} AS old_status, {ok} AS accepted, CASE WHEN {ok} THEN c.new_status ELSE {old} END AS status"

    return f"""
    commands /*recursive*/ AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY "at", seq) AS n FROM
      (SELECT l_shipdate AS "at", {', '.join(_command_view(force))} FROM lineitem)),
    walk AS (
      SELECT c.alert_id, c.n, c.seq, c."at", c.new_status, c.comment, c.reason, c.force, {step('a.status')}
      FROM commands c JOIN alerts a ON a.alert_id = c.alert_id WHERE c.n = 1
      UNION ALL
      SELECT c.alert_id, c.n, c.seq, c."at", c.new_status, c.comment, c.reason, c.force, {step('w.status')}
      FROM walk w JOIN commands c ON c.alert_id = w.alert_id AND c.n = w.n + 1)"""


@query("alert_transition", with_views("""
    SELECT alert_id, seq, old_status, new_status, accepted, status FROM walk""", "alerts", ctes=lifecycle_sql()))
def alert_transition(t: Tables):
    return A.apply_transitions(t.alerts, commands(t)) \
        .select("alert_id", "seq", "old_status", "new_status", "accepted", "status")


# Commands before and after this day come as two batches.
_SECOND_BATCH = "1998-07-01"
_histories: dict[tuple[str, str], str] = {}


def stored_history(t: Tables) -> str:
    """The folder of the stored history of the given commands, written when it is first asked for."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _histories:
        root, given = work_dir(t.spark, "alert-history"), commands(t).drop("reason", "force")
        for number, part in enumerate((F.col("at") < _SECOND_BATCH, F.col("at") >= _SECOND_BATCH)):
            HI.append_batch(root, t.alerts, given.where(part), number)
        _histories[key] = root
    return _histories[key]


@query("alert_status_history", with_views("""
    SELECT alert_id, "at", seq, old_status, new_status, comment FROM walk WHERE accepted""", "alerts",
    ctes=lifecycle_sql()))
def alert_status_history(t: Tables):
    return HI.read_history(t.spark, stored_history(t)) \
        .select("alert_id", "at", "seq", "old_status", "new_status", "comment")


@query("alert_statuses", with_views("""
    SELECT a.alert_id, coalesce(l.status, a.status) AS status FROM alerts a
    LEFT JOIN (SELECT alert_id, arg_max(status, n) AS status FROM walk WHERE accepted GROUP BY alert_id) l USING (alert_id)""",
    "alerts", ctes=lifecycle_sql()))
def alert_statuses(t: Tables):
    """Alerts with the status that the stored batches left them in."""
    return HI.read_statuses(stored_history(t), t.alerts, 1).select("alert_id", "status")


@query("alert_resolve", with_views("""
    SELECT a.alert_id, coalesce(l.status, a.status) AS status, coalesce(l.changes, 0) AS change_count,
      l.resolved_at, l.acknowledged_at, l.false_positive_at, l.resolution_comment, l.resolution_reason
    FROM alerts a LEFT JOIN (SELECT alert_id, arg_max(status, n) AS status, count(*) AS changes,
      max("at") FILTER (status = 'resolved') AS resolved_at, max("at") FILTER (status = 'acknowledged') AS acknowledged_at,
      max("at") FILTER (status = 'false_positive') AS false_positive_at, arg_max(comment, n) AS resolution_comment,
      arg_max(reason, n) FILTER (force) AS resolution_reason
      FROM walk WHERE accepted GROUP BY alert_id) l USING (alert_id)""", "alerts", ctes=lifecycle_sql(_FORCED)))
def alert_resolve(t: Tables):
    """Resolving and marking as false positive skip the transition table."""
    decided = A.apply_transitions(t.alerts, commands(t, _FORCED))
    return A.alert_states(t.alerts, decided).select(
        "alert_id", "status", "change_count", "resolved_at", "acknowledged_at", "false_positive_at",
        "resolution_comment", "resolution_reason")


@query("lifecycle_stats", with_views("""
    SELECT old_status, new_status, count(*) AS changes, count(DISTINCT alert_id) AS alerts FROM walk
    WHERE accepted AND "at" >= TIMESTAMP '2001-08-02' - INTERVAL 24000 HOUR AND "at" < TIMESTAMP '2001-08-02'
    GROUP BY ALL""", "alerts", ctes=lifecycle_sql()))
def lifecycle_stats(t: Tables):
    """Out of the stored history; nothing is replayed."""
    until = as_of("2001-08-02 00:00:00")
    history = HI.read_history(t.spark, stored_history(t), until - F.make_interval(hours=F.lit(24000)), until)
    return K.lifecycle_summary(history, until, hours=24000)


# ------------------------------------------------------------------------ risk
_RISK_INPUT = """risk_input AS (SELECT event_id AS alert_id, severity, ts AS triggered_at, username,
      CASE user_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' END AS criticality,
      concat('asset ', user_id % 9) AS asset_name, event_id * 7 % 101 AS threat_score, event_id % 3 = 0 AS is_malicious,
      CAST(event_id % 5 AS DOUBLE) * 2.5 AS user_risk, CAST(event_id % 11 AS DOUBLE) * 10 AS anomaly FROM sec_events)"""
_FACTORS = """factors AS (SELECT *,
      CASE severity WHEN 'low' THEN 20.0 WHEN 'medium' THEN 50.0 WHEN 'high' THEN 75.0 WHEN 'critical' THEN 100.0
        ELSE 50.0 END::DOUBLE AS base,
      CASE criticality WHEN 'medium' THEN 1.2 WHEN 'high' THEN 1.5 WHEN 'critical' THEN 2.0 ELSE 1.0 END::DOUBLE AS mult,
      CASE WHEN is_malicious THEN threat_score / 100.0::DOUBLE * 30.0 ELSE 0 END::DOUBLE AS ti,
      CASE WHEN epoch_us(triggered_at) % 86400000000 < 32400000000 OR epoch_us(triggered_at) % 86400000000 > 61200000000
        THEN 1.2 ELSE 1.0 END::DOUBLE AS tm, anomaly / 100.0::DOUBLE * 20.0 AS an FROM risk_input),
    scored AS (SELECT *, CAST(round_even(least(greatest(
        (base + (base * mult - base) + ti + user_risk + an) * tm, 0.0), 100.0), 0) AS INT) AS risk_score FROM factors)"""
_LEVEL = ("CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 "
          "THEN 'medium' ELSE 'low' END")


def risk_input(t: Tables):
    names = ["low", "medium", "high", "critical"]
    criticality = F.lit(None).cast("string")
    for i, name in enumerate(names):
        criticality = F.when(F.col("user_id") % 5 == i, F.lit(name)).otherwise(criticality)
    return t.sec_events.select(
        F.col("event_id").alias("alert_id"), "severity", F.col("ts").alias("triggered_at"), "username",
        criticality.alias("criticality"), F.concat(F.lit("asset "), F.col("user_id") % 9).alias("asset_name"),
        (F.col("event_id") * 7 % 101).alias("threat_score"), (F.col("event_id") % 3 == 0).alias("is_malicious"),
        ((F.col("event_id") % 5).cast("double") * 2.5).alias("user_risk"),
        ((F.col("event_id") % 11).cast("double") * 10).alias("anomaly"))


@query("risk_score", with_views("""
    SELECT alert_id, risk_score, round(base, 6) AS base, round(base * mult - base, 6) AS asset_boost,
      round(ti, 6) AS ti_boost, tm AS time_multiplier, round(an, 6) AS anomaly_boost FROM scored""",
    "sec_events", ctes=_RISK_INPUT + ", " + _FACTORS))
def risk_score(t: Tables):
    scored = H.score_alerts(risk_input(t))
    return scored.select(
        "alert_id", "risk_score", F.round("factor_base_severity", 6).alias("base"),
        F.round("factor_asset_boost", 6).alias("asset_boost"), F.round("factor_threat_intel_boost", 6).alias("ti_boost"),
        F.col("factor_time_of_day_multiplier").alias("time_multiplier"),
        F.round("factor_anomaly_boost", 6).alias("anomaly_boost"))


# ------------------------------------------------------ risk, from events to scores
_POINTS = ("CASE risk_event WHEN 'auth.failed' THEN 5.0 WHEN 'malware.detected' THEN 25.0 WHEN 'policy.violation' "
           "THEN 10.0 WHEN 'network.command_and_control' THEN 30.0 ELSE 1.0 END::DOUBLE")
_RISKY = f"""risky AS (SELECT *, {_POINTS} / 10.0 AS points FROM sec_events
      WHERE username <> ''),
    marked AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY username ORDER BY ts, event_id)
      >= 604800000000, false)::INT AS fresh FROM risky),
    lives AS (SELECT *, sum(fresh) OVER (PARTITION BY username ORDER BY ts, event_id) AS life FROM marked)"""


def _risky(t: Tables):
    return t.sec_events, H.risk_points(F.col("risk_event")) / 10.0


@query("risk_pipeline", with_views(f"""
    SELECT alert_id, severity, criticality, threat_score, is_malicious, round(user_risk, 6) AS user_risk,
      round(anomaly, 6) AS anomaly, risk_score, {_LEVEL} AS risk_level FROM scored""",
    "sec_events", "assets", ctes=_CREATED + ", " + _INDICATORS + ", " + _SCORES + ", " + _RISKY + ", " + BASELINES_CTE + ", "
    + COMBINED_CTE + """,
    event_threat AS (SELECT event_id, CAST(max(score) AS INT) AS score FROM indicators JOIN scores USING (type, value) GROUP BY 1),
    profile AS (SELECT username, ts, max(user_risk) AS user_risk FROM (SELECT username, ts, least(sum(points) OVER
      (PARTITION BY username, life ORDER BY ts, event_id), 50.0) AS user_risk FROM lives) GROUP BY ALL),
    risk_input AS (SELECT c.alert_id, c.severity, c.triggered_at, coalesce(s.criticality, d.criticality, 'low') AS criticality,
        t.score AS threat_score, coalesce(t.score >= 80, false) AS is_malicious,
        coalesce(p.user_risk, 0.0)::DOUBLE AS user_risk, coalesce(v.score, 0.0)::DOUBLE AS anomaly
      FROM created c JOIN sec_events e USING (event_id)
      LEFT JOIN asset_keys s ON s.k = lower(c.source) LEFT JOIN asset_keys d ON d.k = lower(c.destination)
      LEFT JOIN event_threat t USING (event_id)
      LEFT JOIN profile p ON p.username = e.username AND p.ts = e.ts
      LEFT JOIN verdicts v ON v.username = e.username AND v.hostname = e.hostname AND v.hour_start = date_trunc('hour', e.ts)), """
    + _FACTORS))
def risk_pipeline(t: Tables):
    """Events to scored alerts: enrichment on the event, rules, alerts, and scores read from what the event
    carries, from the user's profile as it was then and from the anomalies of that hour."""
    indicators = TI.extract_indicators(t.rich_events)
    tagged = E.join_assets(t.rich_events, E.asset_lookup(t.assets)).withColumns({
        "_source_rank": E.criticality_rank(F.col("source_asset")),
        "_destination_rank": E.criticality_rank(F.col("destination_asset"))})
    enriched = E.write_enrichment(tagged.join(TI.join_scores(indicators, _scores(indicators)), "event_id", "left"),
                                  E.ASSET_KEYS | {"threat_intel": "threat_intel"})
    alerts = A.create_alerts(match_rules(enriched, compiled_rules(t.rich_events)), source_rank=F.col("_source_rank"),
                             destination_rank=F.col("_destination_rank"), keep=("username", "hostname", "enrichment"))
    profiled = H.user_risk_of_alerts(H.read_enrichment(alerts), *_risky(t))
    scored = H.score_alerts(H.anomaly_of_alerts(profiled, combined_verdicts(t)))
    return scored.select("alert_id", "severity", "criticality", "threat_score", "is_malicious",
                         F.round("user_risk", 6).alias("user_risk"), F.round("anomaly", 6).alias("anomaly"),
                         "risk_score", "risk_level")


@query("risk_level", with_views(f"SELECT alert_id, {_LEVEL} AS risk_level FROM scored", "sec_events",
                                ctes=_RISK_INPUT + ", " + _FACTORS))
def risk_level(t: Tables):
    return H.score_alerts(risk_input(t)).select("alert_id", "risk_level")


@query("risk_reasoning", with_views("""
    SELECT alert_id, concat('Risk score is HIGH due to: ', concat_ws(', ',
      concat('base severity score of ', CAST(base AS INT)),
      CASE WHEN mult > 1 AND base * mult - base > 0 THEN concat(upper(criticality[1]), criticality[2:],
        ' criticality asset (', asset_name, ')') END,
      CASE WHEN ti > 0 THEN concat('known malicious IP (threat intel score: ', threat_score, ')') END,
      CASE WHEN tm > 1 THEN 'occurred outside business hours' END,
      CASE WHEN user_risk > 0 AND username <> '' THEN concat('high-risk user (', username, ')') END,
      CASE WHEN an > 0 THEN 'anomalous activity detected' END)) AS reasoning FROM scored""",
    "sec_events", ctes=_RISK_INPUT + ", " + _FACTORS))
def risk_reasoning(t: Tables):
    return H.score_alerts(risk_input(t)).select("alert_id", "reasoning")


@query("risk_writeback", with_views(f"""
    SELECT a.alert_id, a.status, s.risk_score IS NOT NULL AS scored, coalesce(s.risk_score, a.risk_score) AS risk_score,
      s.level AS risk_level, s.base AS stored_base FROM alerts a
    LEFT JOIN (SELECT alert_id, risk_score, {_LEVEL} AS level, base FROM scored) s USING (alert_id)""",
    "alerts", "sec_events", ctes=_RISK_INPUT + ", " + _FACTORS))
def risk_writeback(t: Tables):
    scored = H.score_alerts(risk_input(t))
    factors = F.struct(*[F.col(c).alias(c.removeprefix("factor_")) for c in scored.columns if c.startswith("factor_")])
    scores = scored.select("alert_id", "risk_score", "risk_level", "reasoning", factors.alias("factors"))
    blank = F.lit(None).cast("string")
    alerts = t.alerts.withColumns({"risk_level": blank, "reasoning": blank, "risk_factors": blank})
    return H.write_back(alerts, scores).select(
        "alert_id", "status", "scored", "risk_score", "risk_level",
        F.get_json_object("risk_factors", "$.base_severity").cast("double").alias("stored_base"))


@query("off_hours", with_views("""
    SELECT event_id, epoch_us(ts) % 86400000000 < 32400000000 OR epoch_us(ts) % 86400000000 > 61200000000 AS day_shift,
      true AS night_shift FROM sec_events""", "sec_events"))
def off_hours(t: Tables):
    return t.sec_events.select("event_id", H.off_hours(F.col("ts")).alias("day_shift"),
                               H.off_hours(F.col("ts"), "22:00-06:00").alias("night_shift"))


@query("user_risk_increment", with_views(f"SELECT event_id, {_POINTS} AS points FROM sec_events", "sec_events"))
def user_risk_increment(t: Tables):
    return t.sec_events.select("event_id", H.risk_points(F.col("risk_event")).alias("points"))


@query("user_risk_profile", with_views(f"""
    SELECT username, round(least(sum(points), 50.0), 6) AS score, count(*) AS event_count, max(ts) AS last_updated,
      arg_max(event_type, ts) AS last_event_type
    FROM lives JOIN (SELECT username, max(life) AS life FROM lives GROUP BY username) USING (username, life)
    GROUP BY username HAVING max(ts) > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""", "sec_events", ctes=_RISKY))
def user_risk_profile(t: Tables):
    events, points = _risky(t)
    return H.user_profiles(events, points, as_of()).withColumn("score", F.round("score", 6))


@query("user_risk_running", with_views("""
    SELECT event_id, username, round(least(sum(points) OVER (PARTITION BY username, life ORDER BY ts, event_id), 50.0), 6)
      AS user_risk FROM lives""", "sec_events", ctes=_RISKY))
def user_risk_running(t: Tables):
    events, points = _risky(t)
    return H.user_risk_at_event(events, points).select("event_id", "username", F.round("user_risk", 6).alias("user_risk"))


# ------------------------------------------------------ reading the enrichment
def _enriched(t: Tables):
    """Events with the enrichment map the ingest job writes."""
    asset = lambda criticality: F.to_json(F.struct(F.concat(F.lit("asset "), F.col("user_id")).alias("name"),
                                                   criticality.alias("criticality")))
    score = lambda n: F.concat(F.lit('{"is_malicious":'), (n >= 80).cast("string"), F.lit(',"score":'),
                               n.cast("string"), F.lit("}"))
    low, high = F.col("event_id") * 3 % 101, F.col("event_id") * 7 % 101
    nested = F.concat(F.lit('{"source_ip":'), score(low), F.lit(',"metadata.x.ip":'), score(high), F.lit("}"))
    level = F.when(F.col("event_id") % 4 == 0, F.lit("CRITICAL")).when(F.col("event_id") % 4 == 1, F.lit("odd")) \
        .otherwise(F.lit("Medium"))
    pairs = F.create_map(
        F.lit("source_asset"), F.when(F.col("event_id") % 3 == 0, asset(level)),
        F.lit("destination_asset"), F.when(F.col("event_id") % 2 == 0, asset(F.lit("high"))),
        F.lit("threat_intel"), F.when(F.col("event_id") % 5 < 3, nested),
        F.lit("direct"), F.when(F.col("event_id") % 5 == 3, score(low)),
        F.lit("anomaly_score"), F.when(F.col("event_id") % 2 == 0, (F.col("user_id") / 4).cast("string"))
        .otherwise(F.lit("none")))
    return t.sec_events.select("event_id", "user_id", F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("enrichment"))


@query("risk_extract_asset", with_views("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'low'
      ELSE 'medium' END WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS criticality,
      CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN concat('asset ', user_id) END AS asset_name
    FROM sec_events""", "sec_events"))
def risk_extract_asset(t: Tables):
    criticality, name = H.asset_from_enrichment(F.col("enrichment"))
    return _enriched(t).select("event_id", criticality.alias("criticality"), name.alias("asset_name"))


@query("risk_extract_ti", with_views("""
    SELECT event_id, score, score >= 80 AS is_malicious FROM (SELECT event_id, CAST(CASE WHEN event_id % 5 < 3
      THEN greatest(event_id * 3 % 101, event_id * 7 % 101) WHEN event_id % 5 = 3 THEN event_id * 3 % 101 END AS INT)
      AS score FROM sec_events)""", "sec_events"))
def risk_extract_ti(t: Tables):
    found = _enriched(t).select("event_id", H.threat_from_enrichment(F.col("enrichment")).alias("s"))
    return found.select("event_id", "s.score", "s.is_malicious")


@query("risk_extract_anomaly", with_views("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id / 4.0 ELSE 0.0 END::DOUBLE AS anomaly
    FROM sec_events""", "sec_events"))
def risk_extract_anomaly(t: Tables):
    return _enriched(t).select("event_id", H.anomaly_from_enrichment(F.col("enrichment")).alias("anomaly"))


# ------------------------------------------------------------------- playbooks
PLAYBOOK_STEPS = "array<struct<id:string,action:string,condition:string,retry_count:int>>"


@query("playbook_plan", with_views("""
    SELECT alert_id, rule_id, 'contain' AS playbook_id, step_no, step_id, action, CASE step_no
      WHEN 1 THEN 'run' WHEN 2 THEN CASE WHEN severity IN ('high', 'critical') THEN 'run' ELSE 'skip' END
      WHEN 3 THEN CASE WHEN severity IN ('medium', 'high', 'critical') THEN 'run' ELSE 'skip' END ELSE 'run' END AS decision
    FROM alerts, (VALUES (1, 's1', 'notify'), (2, 's2', 'block_ip'), (3, 's3', 'ticket'), (4, 's4', 'log'))
      steps(step_no, step_id, action) WHERE rule_id IN ('rule-1', 'rule-4')""", "alerts"))
def playbook_plan(t: Tables):
    actions = t.spark.createDataFrame(
        [("rule-1", "playbook", "contain"), ("rule-2", "playbook", "off"), ("rule-3", "alert", "contain"),
         ("rule-4", "Playbook", "contain"), ("rule-5", "playbook", None)],
        "rule_id string, type string, playbook_id string")
    steps = [("s1", "notify", None, None), ("s2", "block_ip", "high_severity", None),
             ("s3", "ticket", "Medium_Or_Higher", 2), ("s4", "log", "no_such_condition", None)]
    playbooks = t.spark.createDataFrame([("contain", True, steps), ("off", False, steps)],
                                        f"playbook_id string, enabled boolean, steps {PLAYBOOK_STEPS}")
    return P.plan_steps(t.alerts, actions, playbooks)


@query("playbook_outcome", with_views("""
    SELECT execution_id, playbook_id, bool_and(success) AS success, count(*) AS step_count, min(started_at) AS started_at,
      max(completed_at) AS completed_at, CAST(epoch_ms(max(completed_at)) - epoch_ms(min(started_at)) AS BIGINT) AS duration_ms
    FROM results r JOIN (SELECT execution_id, min(step_no) FILTER (NOT success AND retry_count IS NULL) AS stop
      FROM results GROUP BY ALL) s USING (execution_id) WHERE stop IS NULL OR step_no <= stop
    GROUP BY ALL""", ctes="""results AS (SELECT l_orderkey AS execution_id, 'contain' AS playbook_id, l_linenumber AS step_no,
      l_returnflag <> 'R' AS success, CASE WHEN l_linestatus = 'F' THEN 2 END AS retry_count, l_shipdate AS started_at,
      l_shipdate + to_seconds(CAST(l_quantity AS INT)) AS completed_at FROM lineitem)"""))
def playbook_outcome(t: Tables):
    results = t.raw("lineitem").select(
        F.col("l_orderkey").alias("execution_id"), F.lit("contain").alias("playbook_id"),
        F.col("l_linenumber").alias("step_no"), (F.col("l_returnflag") != "R").alias("success"),
        F.when(F.col("l_linestatus") == "F", F.lit(2)).alias("retry_count"), F.col("l_shipdate").alias("started_at"),
        (F.col("l_shipdate") + F.make_interval(secs=F.col("l_quantity").cast("int"))).alias("completed_at"))
    return P.outcomes(results)
