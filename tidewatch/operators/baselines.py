"""Behaviour baselines and z-score anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_SAMPLES = 3
Z_THRESHOLD = 2.5
Z_CEILING = 5.0
BASELINE_HOURS = 25  # a stored baseline answers for so long

METRICS = ["user_hour", "user_host_conn", "user_host_ports"]


# ------------------------------------------------------------------- baselines
def recent_named(events: DataFrame, as_of: Column, days: int, ts: str) -> DataFrame:
    """Events of the last ``days`` that name a user; both tests reach the scan."""
    return events.filter((F.col(ts) >= as_of - F.make_interval(days=F.lit(days))) & (F.col(ts) < as_of)
                         & (F.col("username") != ""))


def moments(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), F.min(value).alias("min_value"),
            F.max(value).alias("max_value"), F.count("*").alias("sample_count")]


def _enough(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("sample_count") >= MIN_SAMPLES)


def user_hour_baseline(events: DataFrame, as_of: Column, days: int = 7, ts: str = "ts") -> DataFrame:
    """Events per user and clock hour, described per user and hour of day."""
    hourly = recent_named(events, as_of, days, ts) \
        .groupBy("username", F.date_trunc("hour", ts).alias("hour_start")).agg(F.count("*").alias("n"))
    return _enough(hourly.groupBy("username", F.hour("hour_start").alias("hour_of_day")).agg(*moments("n")))


def connection_baseline(events: DataFrame, as_of: Column, days: int = 7, ts: str = "ts") -> DataFrame:
    """Events per clock hour, described per user and host."""
    hourly = recent_named(events, as_of, days, ts).filter(F.col("hostname") != "") \
        .groupBy("username", "hostname", F.date_trunc("hour", ts).alias("hour_start")).agg(F.count("*").alias("n"))
    return _enough(hourly.groupBy("username", "hostname").agg(*moments("n")))


def port_baseline(events: DataFrame, as_of: Column, days: int = 7, ts: str = "ts",
                  approximate: float | None = None) -> DataFrame:
    """Distinct destination ports per clock hour, described per user and host.

    ``approximate`` is a relative error; with it one sketch per group replaces
    the shuffle of all distinct ports.
    """
    ports = F.approx_count_distinct("destination_port", approximate) if approximate \
        else F.count_distinct("destination_port")
    hourly = recent_named(events, as_of, days, ts) \
        .filter((F.col("hostname") != "") & (F.col("destination_port") > 0)) \
        .groupBy("username", "hostname", F.date_trunc("hour", ts).alias("hour_start")).agg(ports.alias("n"))
    return _enough(hourly.groupBy("username", "hostname").agg(*moments("n")))


def baseline_snapshot(events: DataFrame, as_of: Column, days: int = 7, ts: str = "ts") -> DataFrame:
    """All three baselines as one long table from a single pass over the events.

    Events shrink to one row per user, host and clock hour before anything else
    happens; the three metrics are then read off those rows.
    """
    hourly = (
        recent_named(events, as_of, days, ts)
        .groupBy("username", "hostname", F.date_trunc("hour", ts).alias("hour_start"),
                 F.nullif(F.coalesce("destination_port", F.lit(0)), F.lit(0)).alias("port"))
        .agg(F.count("*").alias("n"))
        .groupBy("username", "hostname", "hour_start")
        .agg(F.sum("n").alias("n"), F.count("port").alias("ports"))
    )
    hosted = F.col("hostname") != ""
    metric = lambda name, host, value: F.struct(
        F.lit(name).alias("metric_type"), host.alias("host"), value.cast("bigint").alias("value"))
    rows = hourly.select("username", "hour_start", F.explode(F.array(
        metric("user_hour", F.lit(""), F.col("n")),
        F.when(hosted, metric("user_host_conn", F.col("hostname"), F.col("n"))),
        F.when(hosted & (F.col("ports") > 0), metric("user_host_ports", F.col("hostname"), F.col("ports"))),
    )).alias("m")).filter("m is not null").select("username", "hour_start", "m.*")
    per_hour = rows.groupBy("metric_type", "username", "host", "hour_start").agg(F.sum("value").alias("value"))
    hour_of_day = F.when(F.col("metric_type") == "user_hour", F.hour("hour_start"))
    return _enough(
        per_hour.groupBy("metric_type", "username", F.col("host").alias("hostname"), hour_of_day.alias("hour_of_day"))
        .agg(*moments("value"))
    ).withColumns({"calculated_at": as_of, "window_days": F.lit(days)})


def host_baselines(events: DataFrame, as_of: Column, days: int = 7, ts: str = "ts") -> DataFrame:
    """Connection and port baselines of each user and host side by side, from one
    pass and one fold of the hours: ``conn_*`` and ``ports_*``, null where there
    are too few samples."""
    hourly = (
        recent_named(events, as_of, days, ts).filter(F.col("hostname") != "")
        .groupBy("username", "hostname", F.date_trunc("hour", ts).alias("hour_start"),
                 F.when(F.col("destination_port") > 0, F.col("destination_port")).alias("port"))
        .agg(F.count("*").alias("n"))
        .groupBy("username", "hostname", "hour_start")
        .agg(F.sum("n").alias("conn"), F.nullif(F.count("port"), F.lit(0)).alias("ports"))
    )
    described = hourly.groupBy("username", "hostname").agg(*[part for name in ("conn", "ports") for part in (
        F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_stddev"), F.count(name).alias(f"{name}_n"))])
    return described.select("username", "hostname", *[
        F.when(F.col(f"{name}_n") >= MIN_SAMPLES, F.col(f"{name}_{part}")).alias(f"{name}_{part}")
        for name in ("conn", "ports") for part in ("mean", "stddev")])


# -------------------------------------------------------------- partials by day
def day_partials(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by user, day and hour of day; by user, host and day) of ``hourly_observations``: counts, sums and
    sums of squares, out of which the baselines of any number of whole days are merged."""
    day = F.to_date("hour_start").alias("day")
    users = observed.groupBy("username", "hour_start").agg(F.sum("events").alias("n")) \
        .select("username", day, F.hour("hour_start").alias("hour_of_day"), "n")
    measured = {"conn": F.col("events"), "ports": F.when(F.col("ports") > 0, F.col("ports"))}
    hosts = observed.filter(F.col("hostname") != "").groupBy("username", "hostname", day).agg(*[part for name, value in measured.items()
        for part in (F.count(value).alias(f"{name}_n"), F.sum(value).alias(f"{name}_sum"), F.sum(value * value).alias(f"{name}_squares"))])
    return users, hosts


def write_partials(observed: DataFrame, path: str) -> None:
    """Add the partials of some days to those stored, a folder for each day."""
    for name, rows in zip(("users", "hosts"), day_partials(observed)):
        rows.repartition("day").write.mode("append").partitionBy("day").parquet(f"{path}/{name}")


def merged_baselines(spark: SparkSession, path: str, as_of: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(``user_hour_baseline``, ``host_baselines``) of the ``days`` whole days before ``as_of``, from
    stored partials alone; other days are not read."""
    last = F.to_date(as_of)
    recent = lambda name: spark.read.parquet(f"{path}/{name}").filter(
        (F.col("day") >= F.date_sub(last, days)) & (F.col("day") < last))
    users = _enough(recent("users").groupBy("username", "hour_of_day").agg(*moments("n")))
    summed = recent("hosts").groupBy("username", "hostname").agg(*[
        F.sum(f"{name}_{part}").alias(f"{name}_{part}") for name in ("conn", "ports") for part in ("n", "sum", "squares")])
    n, total, squares = (lambda name, part=part: F.col(f"{name}_{part}").cast("double") for part in ("n", "sum", "squares"))
    described = {"mean": lambda name: total(name) / n(name),
                 "stddev": lambda name: F.sqrt(n(name) * squares(name) - total(name) * total(name)) / n(name)}
    return users, summed.select("username", "hostname", *[
        F.when(n(name) >= MIN_SAMPLES, value(name)).alias(f"{name}_{part}")
        for name in ("conn", "ports") for part, value in described.items()])


def valid_baseline(snapshots: DataFrame, as_of: Column, hours: int = BASELINE_HOURS) -> DataFrame:
    """Newest snapshot of each baseline at a time, unless it has outlived its ``hours``."""
    keys = ["metric_type", "username", "hostname", "hour_of_day"]
    alive = snapshots.filter((F.col("calculated_at") > as_of - F.make_interval(hours=F.lit(hours)))
                             & (F.col("calculated_at") <= as_of))
    newest = Window.partitionBy(*keys).orderBy(F.desc("calculated_at"), F.desc("mean"))
    return alive.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def latest_baseline(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per metric, user, host, hour and calculation date."""
    keys = ["metric_type", "username", "hostname", "hour_of_day", "calc_date"]
    dated = snapshots.withColumn("calc_date", F.to_date("calculated_at"))
    newest = Window.partitionBy(*keys).orderBy(F.desc("calculated_at"), F.desc("mean"))
    return dated.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


# ------------------------------------------------------------------- anomalies
def z_score(current: Column, mean: Column, stddev: Column) -> Column:
    return F.when(stddev == 0, F.lit(0.0)).otherwise((current - mean) / stddev)


def anomaly_score(z: Column) -> Column:
    """0 below the threshold, 100 from the ceiling, linear between."""
    size = F.abs(z)
    return (
        F.when(size < Z_THRESHOLD, F.lit(0.0)).when(size >= Z_CEILING, F.lit(100.0))
        .otherwise((size - Z_THRESHOLD) / (Z_CEILING - Z_THRESHOLD) * 100.0)
    )


def score_against(observed: DataFrame, baseline: DataFrame, keys: list[str], current: Column) -> DataFrame:
    """Observed values with their baseline, z-score, verdict and score. Without
    a baseline there is no anomaly."""
    return scored(observed.join(baseline.select(*keys, "mean", "stddev"), keys, "left"), current)


def scored(joined: DataFrame, current: Column) -> DataFrame:
    """Verdict and score of rows that carry their ``mean`` and ``stddev``, or nulls."""
    z = F.coalesce(z_score(current, F.col("mean"), F.col("stddev")), F.lit(0.0))
    return joined.withColumn("z_score", z).withColumns({
        "is_anomalous": (F.abs("z_score") >= Z_THRESHOLD) & F.col("mean").isNotNull(),
        "score": anomaly_score(F.col("z_score")),
    })


def hourly_observations(events: DataFrame, ts: str = "ts") -> DataFrame:
    """What is seen per user, host and clock hour: events and distinct ports."""
    return events.filter(F.col("username") != "").groupBy(
        "username", "hostname", F.date_trunc("hour", ts).alias("hour_start")
    ).agg(F.count("*").alias("events"), F.count_distinct(F.when(F.col("destination_port") > 0,
                                                              F.col("destination_port"))).alias("ports"))


def hourly_anomalies(events: DataFrame, baseline: DataFrame, ts: str = "ts",
                     constant: float | None = None) -> DataFrame:
    """Each user's clock hours against the baseline of that hour of day.
    ``constant`` replaces the observed count by a fixed current value."""
    observed = events.filter(F.col("username") != "") \
        .groupBy("username", F.date_trunc("hour", ts).alias("hour_start")).agg(F.count("*").alias("observed")) \
        .withColumn("hour_of_day", F.hour("hour_start"))
    current = F.lit(constant) if constant is not None else F.col("observed").cast("double")
    return score_against(observed, baseline, ["username", "hour_of_day"], current)


def connection_anomalies(events: DataFrame, baseline: DataFrame, ts: str = "ts",
                         constant: float | None = None) -> DataFrame:
    observed = events.filter((F.col("username") != "") & (F.col("hostname") != "")) \
        .groupBy("username", "hostname", F.date_trunc("hour", ts).alias("hour_start")) \
        .agg(F.count("*").alias("observed"))
    current = F.lit(constant) if constant is not None else F.col("observed").cast("double")
    return score_against(observed, baseline, ["username", "hostname"], current)


def port_anomalies(events: DataFrame, baseline: DataFrame, ts: str = "ts",
                   constant: float | None = None) -> DataFrame:
    observed = events.filter((F.col("username") != "") & (F.col("hostname") != "") & (F.col("destination_port") > 0)) \
        .groupBy("username", "hostname", F.date_trunc("hour", ts).alias("hour_start")) \
        .agg(F.count_distinct("destination_port").alias("observed"))
    current = F.lit(constant) if constant is not None else F.col("observed").cast("double")
    return score_against(observed, baseline, ["username", "hostname"], current)


def combined_anomalies(observed: DataFrame, user_hour: DataFrame, hosts: DataFrame,
                       constant: float | None = None) -> DataFrame:
    """One verdict per user, host and clock hour out of the three checks.

    The highest score leads (first of hourly, connections, ports on a tie) and
    the reasons of all failed checks are joined. ``observed`` comes from
    ``hourly_observations``, ``hosts`` from ``host_baselines``, joined once for
    both of its checks; each event of that hour shares its verdict.
    """
    value = lambda column: F.lit(constant) if constant is not None else F.col(column).cast("double")
    per_user = observed.groupBy("username", "hour_start").agg(F.sum("events").alias("user_events")) \
        .withColumn("hour_of_day", F.hour("hour_start"))
    hour_label = F.concat(F.lit("Activity at hour "), F.col("hour_of_day").cast("string"))
    hour_note = F.concat(F.lit(", current: "), value("user_events").cast("bigint").cast("string"))
    checked = score_against(per_user, user_hour, ["username", "hour_of_day"], value("user_events")) \
        .select("username", "hour_start", _check(0, hour_label, hour_note).alias("check_0"))
    joined = observed.join(checked, ["username", "hour_start"], "left")
    whose = F.concat(F.col("username"), F.lit("@"), F.col("hostname"))
    joined = joined.join(hosts, ["username", "hostname"], "left")
    for position, name, column, label in (
            (1, "conn", "events", F.concat(F.lit("Connection count from "), whose)),
            (2, "ports", "ports", F.concat(F.lit("Unique destination ports for "), whose))):
        usable = (F.col("hostname") != "") & (F.col(column) > 0)
        described = joined.withColumns({"mean": F.col(f"{name}_mean"), "stddev": F.col(f"{name}_stddev")})
        joined = scored(described, value(column)) \
            .withColumn(f"check_{position}", F.when(usable, _check(position, label, F.lit("")))) \
            .drop("mean", "stddev", "z_score", "is_anomalous", "score")
    failed = F.filter(F.array("check_0", "check_1", "check_2"), lambda c: c.isNotNull() & c["bad"])
    found, lead = F.size("_failed") > 0, F.array_max("_failed")
    return joined.withColumn("_failed", failed).select(
        "username", "hostname", "hour_start", "events",
        F.coalesce(lead["score"], F.lit(0.0)).alias("score"), found.alias("is_anomalous"),
        F.coalesce(lead["z_score"], F.lit(0.0)).alias("z_score"),
        F.when(found, F.array_join(F.transform("_failed", lambda c: c["reason"]), "; "))
        .otherwise(F.lit("No anomalies detected")).alias("reason"),
        F.when(found, F.lit("multiple_metrics")).otherwise(F.lit("none")).alias("metric"),
    )


def _check(position: int, label: Column, note: Column) -> Column:
    """Outcome of one check; the order of its fields decides which one leads."""
    reason = F.concat(
        label, F.lit(" is "), F.format_string("%.2f", F.abs("z_score")),
        F.lit(" standard deviations from normal (mean: "), F.format_string("%.2f", F.col("mean")), note, F.lit(")"))
    return F.struct(F.col("score").alias("score"), F.lit(-position).alias("turn"), F.col("z_score").alias("z_score"),
                    F.col("is_anomalous").alias("bad"), reason.alias("reason"))


def memoized_verdicts(events: DataFrame, verdicts: DataFrame, ts: str = "ts") -> DataFrame:
    """Each event with the verdict of its user, host and clock hour, which is
    computed once per hour and not once per event."""
    keyed = events.withColumn("hour_start", F.date_trunc("hour", ts))
    return keyed.join(verdicts, ["username", "hostname", "hour_start"], "left").withColumns({
        "score": F.coalesce("score", F.lit(0.0)), "is_anomalous": F.coalesce("is_anomalous", F.lit(False))})
