"""From alerts to planned playbook steps, and from step results to outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Step conditions and the severities that meet them.
STEP_CONDITIONS = {
    "high_severity": ["high", "critical"],
    "medium_or_higher": ["medium", "high", "critical"],
}


def condition_met(condition: Column, severity: Column) -> Column:
    """No condition and unknown conditions are met."""
    met = F.lit(True)
    for name, severities in STEP_CONDITIONS.items():
        met = F.when(F.lower(condition) == name, F.lower(severity).isin(severities)).otherwise(met)
    return met


def plan_steps(alerts: DataFrame, actions: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Ordered steps for each alert.

    ``actions``: rule_id, type, playbook_id. ``playbooks``: playbook_id,
    enabled, steps ARRAY<STRUCT<id, action, condition, retry_count>>. Rules and
    playbooks are configuration, so the alert side is the only large one.
    """
    wanted = actions.filter((F.lower("type") == "playbook") & F.col("playbook_id").isNotNull()) \
        .join(playbooks.filter("enabled"), "playbook_id")
    planned = alerts.join(wanted.select("rule_id", "playbook_id", "steps"), "rule_id")
    return planned.select("alert_id", "rule_id", "severity", "playbook_id", F.posexplode("steps")) \
        .select("alert_id", "rule_id", "playbook_id", (F.col("pos") + 1).alias("step_no"),
                F.col("col.id").alias("step_id"), F.col("col.action").alias("action"),
                F.when(condition_met(F.col("col.condition"), F.col("severity")), F.lit("run"))
                .otherwise(F.lit("skip")).alias("decision"))


def outcomes(results: DataFrame) -> DataFrame:
    """Summary per execution: steps count up to the first failure that has no
    retry policy; success needs every counted step to succeed.

    ``results``: execution_id, playbook_id, step_no, success, retry_count,
    started_at, completed_at. The first stopping step is an aggregate joined
    back, so no execution is put in order inside one task.
    """
    stopping = F.when(~F.col("success") & F.col("retry_count").isNull(), F.col("step_no"))
    stops = results.groupBy("execution_id").agg(F.min(stopping).alias("_stop"))
    counted = results.join(stops, "execution_id").filter(F.col("_stop").isNull() | (F.col("step_no") <= F.col("_stop")))
    return counted.groupBy("execution_id", "playbook_id").agg(
        F.bool_and("success").alias("success"), F.count("*").alias("step_count"),
        F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"),
    ).withColumn("duration_ms", ((F.unix_micros(F.col("completed_at").cast("timestamp"))
                                  - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("bigint"))
