"""Analytic tables, asset files and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ANALYTIC_TABLES, ASSET_CSV, ASSET_TYPES, CRITICALITIES
from ..operators.baselines import BASELINE_HOURS, valid_baseline


# ------------------------------------------------------------- analytic tables
def write_analytic(rows: DataFrame, table: str, path: str, mode: str = "append", bloom: list[str] | None = None):
    """Month-partitioned parquet, sorted inside each file for row-group pruning.

    The rebalance hint lets Spark split a large month over many writers and
    gather small ones, so neither huge nor tiny files appear.
    """
    ts, sort_key, _ = ANALYTIC_TABLES[table]
    monthly = rows.withColumn("event_month", F.date_format(ts, "yyyy-MM"))
    present = [c for c in sort_key if c in rows.columns]
    writer = monthly.hint("rebalance", F.col("event_month")).sortWithinPartitions("event_month", *present).write
    for column in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.mode(mode).partitionBy("event_month").parquet(path)


def scan_analytic(spark: SparkSession, table: str, path: str, since: Column | None = None,
                  until: Column | None = None, since_month: str | None = None) -> DataFrame:
    """Scan with the time bound on both the partition and the time column."""
    ts = ANALYTIC_TABLES[table][0]
    rows = spark.read.parquet(path)
    if since_month:
        rows = rows.filter(F.col("event_month") >= since_month)
    if since is not None:
        rows = rows.filter(F.col(ts) >= since)
    if until is not None:
        rows = rows.filter(F.col(ts) < until)
    return rows


def read_baseline(spark: SparkSession, path: str, as_of: Column, hours: int = BASELINE_HOURS) -> DataFrame:
    """Stored baselines that still answer at a time; snapshots are kept with
    ``write_analytic(..., "baseline_features", path)``."""
    rows = scan_analytic(spark, "baseline_features", path, as_of - F.make_interval(hours=F.lit(hours)))
    return valid_baseline(rows, as_of, hours).drop("event_month")


# ----------------------------------------------------------------- asset files
def read_asset_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSET_CSV).option("header", True).option("enforceSchema", False) \
        .option("mode", "PERMISSIVE").csv(path)


def check_assets(rows: DataFrame) -> DataFrame:
    """Imported rows with defaults, split tags, and the reason of refusal."""
    kind = F.lower(F.trim(F.coalesce("asset_type", F.lit("other"))))
    level = F.lower(F.trim(F.coalesce("criticality", F.lit("low"))))
    folded = F.translate(kind, "_", "")
    stored = F.lit(None).cast("string")
    for name in ASSET_TYPES:
        stored = F.when(folded == name.replace("_", ""), F.lit(name)).otherwise(stored)
    error = F.when(stored.isNull(), F.concat(F.lit("unknown asset_type "), kind)) \
        .when(~level.isin(CRITICALITIES), F.concat(F.lit("unknown criticality "), level))
    tags = F.when(F.trim(F.coalesce("tags", F.lit(""))) == "", F.array().cast("array<string>")) \
        .otherwise(F.transform(F.split("tags", ","), lambda tag: F.trim(tag)))
    return rows.select(
        F.coalesce("hostname", F.lit("")).alias("name"), F.coalesce("hostname", F.lit("")).alias("hostname"),
        F.col("ip").alias("ip_address"), F.coalesce(stored, kind).alias("asset_type"), level.alias("criticality"),
        "owner", tags.alias("tags"), error.alias("error"))


def import_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("imported"),
                       F.count_if(F.col("error").isNotNull()).alias("failed"))


# ------------------------------------------------------------------- audit log
def append_audit(events: DataFrame, path: str) -> None:
    """One JSON object per line, appended."""
    events.write.mode("append").json(path)


def publish_audit(batch: DataFrame, log_path: str, table_path: str) -> None:
    """One batch to the line log and to the audit table; body of a foreachBatch.
    The batch is written to the table first and the log is fed from memory or
    disk blocks, so the source is read once."""
    kept = batch.persist()
    try:
        write_analytic(kept, "audit_events", table_path)
        append_audit(kept, log_path)
    finally:
        kept.unpersist()
