"""The stored history of alerts: status changes as they were accepted, and each changed alert's last status.

Commands come in batches. A batch reads the last statuses, never earlier
commands, and adds its accepted changes to the history, by month. Every
batch writes folders of its own, so a batch that is repeated replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alerts import apply_transitions, status_history


def _month(at: Column) -> Column:
    return F.year(at) * 100 + F.month(at)


def append_batch(root: str, alerts: DataFrame, commands: DataFrame, number: int) -> None:
    """Apply batch ``number`` (from 0) of ``commands`` to ``alerts`` (alert_id and the status each began with).

    Batches follow each other in time; a command that comes late is applied
    after those of the batches before it.
    """
    spark = alerts.sparkSession
    current = alerts.select("alert_id", "status")
    before = None
    if number:
        before = spark.read.parquet(f"{root}/status/batch={number - 1}")
        known = before.withColumnRenamed("status", "_known")
        current = current.join(known, "alert_id", "left").select("alert_id", F.coalesce("_known", "status").alias("status"))
    changes = status_history(apply_transitions(current, commands)).withColumn("month", _month(F.col("at")))
    path = f"{root}/history/batch={number}"
    # Dealt out by month and size: a range would be sought by replaying all commands once more.
    changes.hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(path)
    written = spark.read.schema(changes.schema).parquet(path)
    latest = written.groupBy("alert_id").agg(F.max_by("new_status", F.struct("at", "seq")).alias("status"))
    if before is not None:
        latest = latest.unionByName(before.join(latest.select("alert_id"), "alert_id", "left_anti"))
    latest.write.mode("overwrite").parquet(f"{root}/status/batch={number}")


def read_history(spark: SparkSession, root: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Accepted changes from ``since`` up to ``until``; months outside are not read."""
    found = spark.read.option("basePath", f"{root}/history").parquet(f"{root}/history")
    month = F.col("month")
    if since is not None:
        found = found.where((month >= _month(since)) & (F.col("at") >= since))
    if until is not None:
        found = found.where((month <= _month(until)) & (F.col("at") < until))
    return found.drop("batch", "month")


def read_statuses(root: str, alerts: DataFrame, number: int) -> DataFrame:
    """``alerts`` with the status each has after batch ``number``."""
    last = alerts.sparkSession.read.parquet(f"{root}/status/batch={number}").withColumnRenamed("status", "_last")
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("_last", "status")).drop("_last")
