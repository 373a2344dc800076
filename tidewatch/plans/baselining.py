"""Baselines and anomalies over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as G
from ..session import work_dir
from ..sources import tables as TB
from .bindings import AS_OF, Tables, as_of, with_views
from .catalog import query

DAYS = 30
_WINDOW = f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AND ts < TIMESTAMP '{AS_OF}' AND username <> ''"
_MOMENTS = ("round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS stddev, min(n) AS min_value, max(n) AS max_value, "
            "count(*) AS sample_count")
BASELINES_CTE = f"""
    user_hour AS (SELECT username, CAST(hour(h) AS INT) AS hour_of_day, avg(n) AS mean, stddev_pop(n) AS stddev,
        min(n) AS min_value, max(n) AS max_value, count(*) AS sample_count FROM
      (SELECT username, date_trunc('hour', ts) AS h, count(*) AS n FROM sec_events WHERE {_WINDOW} GROUP BY ALL)
      GROUP BY username, hour(h) HAVING count(*) >= 3),
    conn AS (SELECT username, hostname, avg(n) AS mean, stddev_pop(n) AS stddev, min(n) AS min_value,
        max(n) AS max_value, count(*) AS sample_count FROM
      (SELECT username, hostname, date_trunc('hour', ts) AS h, count(*) AS n FROM sec_events
       WHERE {_WINDOW} AND hostname <> '' GROUP BY ALL) GROUP BY username, hostname HAVING count(*) >= 3),
    ports AS (SELECT username, hostname, avg(n) AS mean, stddev_pop(n) AS stddev, min(n) AS min_value,
        max(n) AS max_value, count(*) AS sample_count FROM
      (SELECT username, hostname, date_trunc('hour', ts) AS h, count(DISTINCT destination_port) AS n FROM sec_events
       WHERE {_WINDOW} AND hostname <> '' AND destination_port > 0 GROUP BY ALL)
      GROUP BY username, hostname HAVING count(*) >= 3)"""
_ROUNDED = "round(mean, 6) AS mean, round(stddev, 6) AS stddev, min_value, max_value, sample_count"


def rounded(rows, *names: str):
    return rows.withColumns({name: F.round(name, 6) for name in names})


@query("baseline_user_hour", with_views(f"SELECT username, hour_of_day, {_ROUNDED} FROM user_hour", "sec_events",
                                        ctes=BASELINES_CTE))
def user_hour(t: Tables):
    return rounded(G.user_hour_baseline(t.sec_events, as_of(), DAYS), "mean", "stddev")


@query("baseline_user_host_conn", with_views(f"SELECT username, hostname, {_ROUNDED} FROM conn", "sec_events",
                                             ctes=BASELINES_CTE))
def user_host_conn(t: Tables):
    return rounded(G.connection_baseline(t.sec_events, as_of(), DAYS), "mean", "stddev")


@query("baseline_user_host_ports", with_views(f"SELECT username, hostname, {_ROUNDED} FROM ports", "sec_events",
                                              ctes=BASELINES_CTE))
def user_host_ports(t: Tables):
    return rounded(G.port_baseline(t.sec_events, as_of(), DAYS), "mean", "stddev")


@query("baseline_store", with_views(f"""
    SELECT 'user_hour' AS metric_type, username, '' AS hostname, hour_of_day, {_ROUNDED},
      TIMESTAMP '{AS_OF}' AS calculated_at, {DAYS} AS window_days FROM user_hour
    UNION ALL SELECT 'user_host_conn', username, hostname, NULL, {_ROUNDED}, TIMESTAMP '{AS_OF}', {DAYS} FROM conn
    UNION ALL SELECT 'user_host_ports', username, hostname, NULL, {_ROUNDED}, TIMESTAMP '{AS_OF}', {DAYS} FROM ports
    """, "sec_events", ctes=BASELINES_CTE))
def store(t: Tables):
    return rounded(G.baseline_snapshot(t.sec_events, as_of(), DAYS), "mean", "stddev")


_SNAPSHOTS = f"""snapshots AS (
    SELECT 'user_host_conn' AS metric_type, username, hostname, CAST(NULL AS INT) AS hour_of_day, mean,
      TIMESTAMP '2024-01-30 06:00:00' AS calculated_at FROM conn
    UNION ALL SELECT 'user_host_conn', username, hostname, NULL, mean + 1, TIMESTAMP '2024-01-30 18:00:00' FROM conn
    UNION ALL SELECT 'user_host_conn', username, hostname, NULL, mean + 2, TIMESTAMP '2024-01-29 20:00:00' FROM conn)"""


@query("baseline_latest", with_views("""
    SELECT username, hostname, calc_date, calculated_at, round(mean, 6) AS mean FROM
      (SELECT *, CAST(calculated_at AS DATE) AS calc_date FROM snapshots)
    QUALIFY row_number() OVER (PARTITION BY metric_type, username, hostname, hour_of_day, calc_date
      ORDER BY calculated_at DESC) = 1""", "sec_events", ctes=BASELINES_CTE + ", " + _SNAPSHOTS))
def latest(t: Tables):
    base = G.connection_baseline(t.sec_events, as_of(), DAYS)
    at = lambda stamp, plus: base.select(
        F.lit("user_host_conn").alias("metric_type"), "username", "hostname",
        F.lit(None).cast("int").alias("hour_of_day"), (F.col("mean") + plus).alias("mean"),
        as_of(stamp).alias("calculated_at"))
    snapshots = at("2024-01-30 06:00:00", 0).unionByName(at("2024-01-30 18:00:00", 1)) \
        .unionByName(at("2024-01-29 20:00:00", 2))
    return rounded(G.latest_baseline(snapshots), "mean") \
        .select("username", "hostname", "calc_date", "calculated_at", "mean")


@query("baseline_valid", with_views(f"""
    SELECT username, hostname, calculated_at, round(mean, 6) AS mean FROM
      (SELECT username, hostname, mean + 1 AS mean, TIMESTAMP '2024-01-30 06:00:00' AS calculated_at FROM conn
       WHERE username LIKE '%1' UNION ALL
       SELECT username, hostname, mean, TIMESTAMP '2024-01-29 20:00:00' FROM conn WHERE NOT username LIKE '%1'
         AND NOT username LIKE '%2')""", "sec_events", ctes=BASELINES_CTE))
def valid(t: Tables):
    """Stored snapshots read back 25 hours before an evening: older and later ones do not answer."""
    path = work_dir(t.spark, "baselines")
    base = G.connection_baseline(t.sec_events, as_of(), DAYS)
    at = lambda stamp, plus, rows: base.filter(rows).select(
        F.lit("user_host_conn").alias("metric_type"), "username", "hostname", F.lit(None).cast("int").alias("hour_of_day"),
        (F.col("mean") + plus).alias("mean"), "stddev", as_of(stamp).alias("calculated_at"))
    for snapshot in (at("2024-01-29 10:00:00", 5, "true"), at("2024-01-29 20:00:00", 0, "not username like '%2'"),
                     at("2024-01-30 06:00:00", 1, "username like '%1'"), at("2024-01-30 21:00:00", 9, "true")):
        TB.write_analytic(snapshot, "baseline_features", path)
    stored = TB.read_baseline(t.spark, path, as_of("2024-01-30 20:00:00"))
    return rounded(stored, "mean").select("username", "hostname", "calculated_at", "mean")


# ------------------------------------------------------------------- anomalies
def _z(current: str) -> str:
    return f"coalesce(CASE WHEN stddev = 0 THEN 0.0 ELSE ({current} - mean) / stddev END, 0.0)"


def _score(z: str) -> str:
    return (f"CASE WHEN abs({z}) < 2.5 THEN 0.0 WHEN abs({z}) >= 5 THEN 100.0 "
            f"ELSE (abs({z}) - 2.5) / 2.5 * 100.0 END")


def _verdict(keys: str, observed: str, baseline: str, using: str, current: str = "observed") -> str:
    return f"""SELECT {keys}, observed, round(z, 6) AS z_score, abs(z) >= 2.5 AND mean IS NOT NULL AS is_anomalous,
      round({_score('z')}, 6) AS score FROM
      (SELECT *, {_z(current)} AS z FROM ({observed}) LEFT JOIN {baseline} USING ({using}))"""


_OBS_HOUR = """SELECT username, date_trunc('hour', ts) AS hour_start, CAST(hour(ts) AS INT) AS hour_of_day,
    count(*) AS observed FROM sec_events WHERE username <> '' GROUP BY ALL"""
_OBS_CONN = """SELECT username, hostname, date_trunc('hour', ts) AS hour_start, count(*) AS observed
    FROM sec_events WHERE username <> '' AND hostname <> '' GROUP BY ALL"""
_OBS_PORT = """SELECT username, hostname, date_trunc('hour', ts) AS hour_start,
    count(DISTINCT destination_port) AS observed
    FROM sec_events WHERE username <> '' AND hostname <> '' AND destination_port > 0 GROUP BY ALL"""
_OUT = ["observed", "z_score", "is_anomalous", "score"]


@query("anomaly_hourly", with_views(_verdict("username, hour_start", _OBS_HOUR, "user_hour", "username, hour_of_day"),
                                    "sec_events", ctes=BASELINES_CTE))
def anomaly_hourly(t: Tables):
    baseline = G.user_hour_baseline(t.sec_events, as_of(), DAYS)
    return rounded(G.hourly_anomalies(t.sec_events, baseline), "z_score", "score") \
        .select("username", "hour_start", *_OUT)


@query("anomaly_connection", with_views(
    _verdict("username, hostname, hour_start", _OBS_CONN, "conn", "username, hostname"), "sec_events",
    ctes=BASELINES_CTE))
def anomaly_connection(t: Tables):
    baseline = G.connection_baseline(t.sec_events, as_of(), DAYS)
    return rounded(G.connection_anomalies(t.sec_events, baseline), "z_score", "score") \
        .select("username", "hostname", "hour_start", *_OUT)


@query("anomaly_ports", with_views(
    _verdict("username, hostname, hour_start", _OBS_PORT, "ports", "username, hostname", "1.0"), "sec_events",
    ctes=BASELINES_CTE))
def anomaly_ports(t: Tables):
    """With the fixed current value 1 in place of the observed count."""
    baseline = G.port_baseline(t.sec_events, as_of(), DAYS)
    return rounded(G.port_anomalies(t.sec_events, baseline, constant=1.0), "z_score", "score") \
        .select("username", "hostname", "hour_start", *_OUT)


@query("anomaly_score", with_views(
    f"SELECT event_id, round({_score('z')}, 6) AS score FROM (SELECT event_id, (bytes_sent - 1000000) / 200000.0 AS z "
    "FROM sec_events)", "sec_events"))
def anomaly_score(t: Tables):
    z = (F.col("bytes_sent") - 1000000) / 200000.0
    return t.sec_events.select("event_id", F.round(G.anomaly_score(z), 6).alias("score"))


COMBINED_CTE = f"""
    seen AS (SELECT username, hostname, date_trunc('hour', ts) AS hour_start, count(*) AS events,
      count(DISTINCT destination_port) FILTER (destination_port > 0) AS n_ports
      FROM sec_events WHERE username <> '' GROUP BY ALL),
    user_seen AS (SELECT username, hour_start, CAST(hour(hour_start) AS INT) AS hour_of_day,
      sum(events) AS user_events FROM seen GROUP BY ALL),
    z0 AS (SELECT username, hour_start, {_z('user_events')} AS z0, mean AS m0 FROM user_seen
      LEFT JOIN user_hour USING (username, hour_of_day)),
    z1 AS (SELECT username, hostname, hour_start, {_z('events')} AS z1 FROM seen
      LEFT JOIN conn USING (username, hostname)),
    z2 AS (SELECT username, hostname, hour_start, {_z('n_ports')} AS z2 FROM seen
      LEFT JOIN ports USING (username, hostname)),
    checks AS (SELECT *, {_score('z0')} AS s0,
        CASE WHEN hostname <> '' THEN {_score('z1')} ELSE 0 END AS s1,
        CASE WHEN hostname <> '' AND n_ports > 0 THEN {_score('z2')} ELSE 0 END AS s2,
        abs(z0) >= 2.5 AS b0, hostname <> '' AND abs(z1) >= 2.5 AS b1,
        hostname <> '' AND n_ports > 0 AND abs(z2) >= 2.5 AS b2
      FROM seen JOIN z0 USING (username, hour_start) JOIN z1 USING (username, hostname, hour_start)
      JOIN z2 USING (username, hostname, hour_start)),
    verdicts AS (SELECT username, hostname, hour_start, events, b0 OR b1 OR b2 AS is_anomalous,
      greatest(CASE WHEN b0 THEN s0 ELSE 0 END, CASE WHEN b1 THEN s1 ELSE 0 END, CASE WHEN b2 THEN s2 ELSE 0 END) AS score,
      b0::INT + b1::INT + b2::INT AS reasons,
      CASE WHEN b0 OR b1 OR b2 THEN 'multiple_metrics' ELSE 'none' END AS metric FROM checks)"""


_partials: dict[tuple[str, str], str] = {}


def stored_partials(t: Tables) -> str:
    """The folder of the day partials of the given events, written when they are first asked for."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _partials:
        path = work_dir(t.spark, "partials")
        G.write_partials(G.hourly_observations(t.sec_events), path)
        _partials[key] = path
    return _partials[key]


def combined_verdicts(t: Tables):
    """What is seen in each hour against the baselines that the stored days give."""
    return G.combined_anomalies(
        G.hourly_observations(t.sec_events), *G.merged_baselines(t.spark, stored_partials(t), as_of(), DAYS))


@query("baseline_merged", with_views("""
    SELECT username, hostname, round(conn.mean, 6) AS conn_mean, round(conn.stddev, 6) AS conn_stddev,
      round(ports.mean, 6) AS ports_mean, round(ports.stddev, 6) AS ports_stddev
    FROM conn FULL JOIN ports USING (username, hostname)""", "sec_events", ctes=BASELINES_CTE))
def baseline_merged(t: Tables):
    """Baselines of users and hosts out of the stored partials of each day."""
    hosts = G.merged_baselines(t.spark, stored_partials(t), as_of(), DAYS)[1]
    return rounded(hosts, "conn_mean", "conn_stddev", "ports_mean", "ports_stddev").where("conn_mean IS NOT NULL")


@query("anomaly_combine", with_views("""
    SELECT username, hostname, hour_start, events, is_anomalous, round(score, 6) AS score, reasons, metric
    FROM verdicts""", "sec_events", ctes=BASELINES_CTE + ", " + COMBINED_CTE))
def anomaly_combine(t: Tables):
    reasons = F.when(F.col("is_anomalous"), F.size(F.split("reason", "; "))).otherwise(F.lit(0))
    return rounded(combined_verdicts(t), "score").withColumn("reasons", reasons) \
        .select("username", "hostname", "hour_start", "events", "is_anomalous", "score", "reasons", "metric")


@query("anomaly_hour_memo", with_views("""
    SELECT event_id, coalesce(is_anomalous, false) AS is_anomalous, round(coalesce(score, 0.0), 6) AS score
    FROM sec_events e LEFT JOIN verdicts v ON e.username = v.username AND e.hostname = v.hostname
      AND date_trunc('hour', e.ts) = v.hour_start""", "sec_events", ctes=BASELINES_CTE + ", " + COMBINED_CTE))
def anomaly_hour_memo(t: Tables):
    return rounded(G.memoized_verdicts(t.sec_events, combined_verdicts(t)), "score") \
        .select("event_id", "is_anomalous", "score")
