"""Roll-ups, top lists, health checks and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.basic import epoch_seconds, floor_div, name_of, rank_of
from ..model import ANALYTIC_TABLES, SEVERITIES
from .alerts import at_least
from .periods import neighbours
from .selection import values_at


def since(ts: str, as_of: Column, **interval: int) -> Column:
    """Time test on the bare column, so it prunes partitions and row groups."""
    span = F.make_interval(**{unit: F.lit(n) for unit, n in interval.items()})
    return (F.col(ts) >= as_of - span) & (F.col(ts) < as_of)


# -------------------------------------------------------------------- roll-ups
def top_talkers(network: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    return network.filter(since(ts, as_of, hours=24)) \
        .groupBy(F.to_date(ts).alias("event_date"), "source_ip", "destination_ip") \
        .agg(F.count("*").alias("connection_count"), F.sum("bytes_sent").alias("total_bytes_sent"),
             F.sum("bytes_received").alias("total_bytes_received"))


def alert_stats(alerts: DataFrame, ts: str = "triggered_at") -> DataFrame:
    """Mergeable hourly partials: sums and counts, never averages."""
    return alerts.groupBy(F.to_date(ts).alias("alert_date"), F.date_trunc("hour", ts).alias("alert_hour"), "severity") \
        .agg(F.count("*").alias("alert_count"), F.sum("risk_score").alias("risk_sum"),
             F.count("risk_score").alias("risk_count"))


def read_alert_stats(partials: DataFrame) -> DataFrame:
    """Partials of any number of loads merged, with the average taken last."""
    return partials.groupBy("alert_date", "alert_hour", "severity").agg(
        F.sum("alert_count").alias("alert_count"),
        (F.sum("risk_sum") / F.sum("risk_count")).alias("avg_risk_score"))


def user_hourly_activity(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.filter(F.col("username") != "") \
        .groupBy(F.to_date(ts).alias("event_date"), "username", F.hour(ts).alias("hour_of_day")) \
        .agg(F.count("*").alias("event_count"))


def user_host_connections(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Connections and exact distinct ports per day, user and host."""
    return events.filter((F.col("username") != "") & (F.col("hostname") != "")) \
        .groupBy(F.to_date(ts).alias("event_date"), "username", "hostname") \
        .agg(F.count("*").alias("connection_count"),
             F.count_distinct(F.when(F.col("destination_port") > 0, F.col("destination_port"))).alias("unique_ports"))


def port_sketches(events: DataFrame, ts: str = "ts") -> DataFrame:
    """The same roll-up with a mergeable sketch in place of distinct ports."""
    return events.filter((F.col("username") != "") & (F.col("hostname") != "")) \
        .groupBy(F.to_date(ts).alias("event_date"), "username", "hostname") \
        .agg(F.count("*").alias("connection_count"), F.hll_sketch_agg("destination_port").alias("port_sketch"))


def merge_port_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(
        F.sum("connection_count").alias("connection_count"),
        F.hll_sketch_estimate(F.hll_union_agg("port_sketch")).alias("unique_ports"))


# ------------------------------------------------------------------- top lists
def top_sources(events: DataFrame, as_of: Column, ts: str = "ts", limit: int = 10) -> DataFrame:
    return events.filter(since(ts, as_of, hours=24)).groupBy("source_ip").agg(
        F.count("*").alias("alert_count"), F.max(rank_of(F.col("severity"), SEVERITIES)).alias("_rank"),
        F.avg("bytes_sent").alias("avg_bytes")) \
        .withColumn("max_severity", name_of(F.col("_rank"), SEVERITIES)).drop("_rank") \
        .orderBy(F.desc("alert_count"), "source_ip").limit(limit)


def severity_distribution(events: DataFrame, as_of: Column, ts: str = "ts", days: int = 7) -> DataFrame:
    """Counts and shares; the total runs over the six counts, not the events."""
    counts = events.filter(since(ts, as_of, days=days)).groupBy("severity").agg(F.count("*").alias("event_count"))
    whole = Window.partitionBy(F.lit(0))
    return counts.withColumn("percentage", F.col("event_count") * 100.0 / F.sum("event_count").over(whole))


def user_activity(events: DataFrame, as_of: Column, ts: str = "ts", more_than: int = 10, limit: int = 100,
                  hours: int = 24) -> DataFrame:
    return events.filter(since(ts, as_of, hours=hours)) \
        .groupBy("username", "hostname", F.hour(ts).alias("hour")) \
        .agg(F.count("*").alias("event_count"), F.sum("bytes_sent").alias("data_transferred")) \
        .filter(F.col("event_count") > more_than) \
        .orderBy(F.desc("event_count"), "username", "hostname", "hour").limit(limit)


def top_pairs(events: DataFrame, as_of: Column, event_type: str, ts: str = "ts", limit: int = 50,
              hours: int = 24) -> DataFrame:
    return events.filter(since(ts, as_of, hours=hours) & (F.col("event_type") == event_type)) \
        .groupBy("source_ip", "destination_ip") \
        .agg(F.sum("bytes_sent").alias("total_bytes"), F.count("*").alias("connection_count")) \
        .orderBy(F.desc("total_bytes"), "source_ip", "destination_ip").limit(limit)


def filtered_alerts(alerts: DataFrame, as_of: Column, lowest: str | None = None, rule_id: str | None = None,
                    limit: int = 100, hours: int = 24) -> DataFrame:
    found = alerts.filter(since("created_at", as_of, hours=hours))
    if lowest:
        found = found.filter(at_least(F.col("severity"), lowest))
    if rule_id:
        found = found.filter(F.col("rule_id") == rule_id)
    return found.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def lifecycle_summary(history: DataFrame, as_of: Column, at: str = "at", hours: int = 24) -> DataFrame:
    """Status changes per (from, to)."""
    return history.filter(since(at, as_of, hours=hours)).groupBy("old_status", "new_status") \
        .agg(F.count("*").alias("changes"), F.count_distinct("alert_id").alias("alerts"))


def risk_summary(alerts: DataFrame, as_of: Column, ts: str = "triggered_at", days: int = 7) -> DataFrame:
    return alerts.filter(since(ts, as_of, days=days)).groupBy("risk_level").agg(
        F.count("*").alias("alert_count"), F.avg("risk_score").alias("avg_risk"),
        F.percentile_approx("risk_score", 0.95).alias("p95_risk"))


# ---------------------------------------------------------------------- health
def event_rates(events: DataFrame, step: str = "5 minutes", seconds: int = 300, ts: str = "ts",
                errors: Column | None = None, empty: bool = True) -> DataFrame:
    """Events, per-second rate and error share for every step of the covered
    time; empty steps are included unless ``empty`` is false.

    The steps are generated from the first to the last counted step, so the
    number of rows is the covered time divided by the step.
    """
    bad = errors if errors is not None else F.lit(False)
    counted = events.groupBy(F.window(F.col(ts), step)["start"].alias("step_start")) \
        .agg(F.count("*").alias("events"), F.count_if(bad).alias("errors"))
    if empty:
        steps = counted.agg(F.min("step_start").alias("a"), F.max("step_start").alias("b")).select(
            F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("step_start"))
        counted = steps.join(counted, "step_start", "left")
    return counted.select(
        "step_start", F.coalesce("events", F.lit(0)).alias("events"),
        (F.coalesce("events", F.lit(0)) / seconds).alias("rate"),
        (F.coalesce("errors", F.lit(0)) / F.col("events")).alias("error_share"))


def trailing_rates(rates: DataFrame, steps: int = 3, seconds: int = 300) -> DataFrame:
    """Adds the rate and error share over the last ``steps`` steps (15 minutes of
    5-minute ones). Every step is sent to those that still see it; nothing is ordered."""
    reach = F.sequence(F.lit(0), F.lit(steps - 1))
    errors = F.coalesce(F.col("error_share") * F.col("events"), F.lit(0.0))
    seen = rates.select("events", errors.alias("_errors"), F.col("step_start").alias("_from"), F.explode(reach).alias("_i")) \
        .groupBy((F.col("_from") + F.make_interval(secs=F.col("_i") * seconds)).alias("step_start")) \
        .agg(F.sum("events").alias("_events"), F.sum("_errors").alias("_errors"))
    return rates.join(seen, "step_start").withColumns({
        "trailing_rate": F.col("_events") / (steps * seconds),
        "trailing_error_share": F.when(F.col("_events") > 0, F.col("_errors") / F.col("_events"))}).drop("_events", "_errors")


def held_above(rates: DataFrame, value: str, ceiling: float, for_seconds: int, seconds: int = 60) -> DataFrame:
    """Runs of neighbouring steps whose ``value`` stays above a ceiling for ``for_seconds`` or more.

    A step opens a run if the one before is not its neighbour, and closes one
    likewise; among openings and closings, what follows an opening is its closing.
    """
    moved = lambda column, by: F.col(column) + F.make_interval(secs=F.lit(by))
    high = neighbours(rates.filter(F.col(value) > ceiling).select("step_start"), "step_start")
    opens = F.coalesce(F.col("previous") != moved("step_start", -seconds), F.lit(True))
    closes = F.coalesce(F.col("next") != moved("step_start", seconds), F.lit(True))
    ends = high.select("step_start", F.explode(F.array_compact(F.array(
        F.when(opens, F.lit(0)), F.when(closes, F.lit(1))))).alias("end"))
    runs = neighbours(ends, "step_start", ["end"]).filter("end = 0").select(
        F.col("step_start").alias("held_from"), moved("next", seconds).alias("held_until"))
    return runs.filter(epoch_seconds(F.col("held_until")) - epoch_seconds(F.col("held_from")) >= for_seconds)


def silent_stretches(events: DataFrame, step: str = "5 minutes", step_seconds: int = 300,
                     for_seconds: int = 600, ts: str = "ts") -> DataFrame:
    """Runs of empty steps of ``for_seconds`` or more between two busy steps."""
    busy = events.groupBy(F.window(F.col(ts), step)["start"].alias("step_start")).agg(F.count("*").alias("events"))
    gap = epoch_seconds(F.col("next")) - epoch_seconds(F.col("step_start")) - step_seconds
    return neighbours(busy, "step_start").withColumn("_gap", gap) \
        .filter(F.col("_gap") >= for_seconds) \
        .select((F.col("step_start") + F.make_interval(secs=F.lit(step_seconds))).alias("silent_from"),
                F.col("next").alias("silent_until"), floor_div(F.col("_gap"), step_seconds).alias("steps"))


def latency_percentiles(samples: DataFrame, service: str, value: str, ts: str = "ts", step: str = "5 minutes",
                        exact: bool = True) -> DataFrame:
    """p50, p95 and p99 per service and step, between neighbours in proportion.
    The exact form counts each value once and closes in on the ranks by cells of
    values, so no group is sorted; the approximate one keeps a fixed-size summary per group."""
    points = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    start = F.window(F.col(ts), step)["start"].alias("step_start")
    groups = ["service", "step_start"]
    if not exact:
        return samples.groupBy(F.col(service).alias("service"), start) \
            .agg(*[F.percentile_approx(value, p, 10000).alias(name) for name, p in points])
    counted = samples.groupBy(F.col(service).alias("service"), start, F.col(value).cast("double").alias("_value")) \
        .agg(F.count(value).alias("_n"))
    place = lambda p: (F.col("_size") - 1) * F.lit(p)
    found = values_at(counted, groups, "_value", "_n", {
        f"_{name}_{side}": whole(place(p)).cast("long") for name, p in points
        for side, whole in (("low", F.floor), ("high", F.ceil))})
    between = lambda name, p: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) \
        * (place(p) - F.floor(place(p)))
    return found.select(*groups, *[between(name, p).alias(name) for name, p in points])


# ------------------------------------------------------------------- retention
def retained(rows: DataFrame, as_of: Column, days: int, ts: str) -> DataFrame:
    """Rows young enough to keep; whole old partitions are never read."""
    return rows.filter(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)))


def retention_report(tables: dict[str, tuple[DataFrame, str]], as_of: Column) -> DataFrame:
    """Kept and dropped rows of each analytic table, by its own retention."""
    reports = []
    for name, (rows, ts) in tables.items():
        days = ANALYTIC_TABLES[name][2]
        old = F.col(ts) < as_of - F.make_interval(days=F.lit(days))
        reports.append(rows.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("dropped"))
                       .select(F.lit(name).alias("table_name"), F.lit(days).alias("days"), "kept", "dropped"))
    report = reports[0]
    for other in reports[1:]:
        report = report.unionByName(other)
    return report
