"""Risk scores of alerts and running risk profiles of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import case_map, epoch_micros, floor_div
from ..model import CRITICALITIES
from .periods import asof_value, block_stretches, running_totals

# ---------------------------------------------------------------- fixed values
BASE_WEIGHTS = {"low": 20.0, "medium": 50.0, "high": 75.0, "critical": 100.0}
DEFAULT_BASE = 50.0
ASSET_MULTIPLIERS = {"low": 1.0, "medium": 1.2, "high": 1.5, "critical": 2.0}
OFF_HOURS_MULTIPLIER = 1.2
THREAT_MAX_BOOST = 30.0
ANOMALY_MAX_BOOST = 20.0
BUSINESS_HOURS = "09:00-17:00"
USER_RISK_CAP = 50.0
USER_RISK_DAYS = 7
USER_RISK_POINTS = {
    "auth.failed": 5.0, "auth.lockout": 10.0, "auth.privilege_escalation": 15.0, "auth.unusual_time": 8.0,
    "auth.unusual_location": 12.0, "data.access_sensitive": 7.0, "data.exfiltration_attempt": 20.0,
    "malware.detected": 25.0, "policy.violation": 10.0, "network.suspicious_traffic": 8.0,
    "network.command_and_control": 30.0,
}


# ------------------------------------------------------------------------ score
def _clock_seconds(text: str) -> int:
    hours, minutes, *rest = [int(part) for part in text.strip().split(":")]
    return hours * 3600 + minutes * 60 + (rest[0] if rest else 0)


def off_hours(ts: Column, business_hours: str = BUSINESS_HOURS) -> Column:
    """Before the start or after the end of the working day; both ends count as
    working. A range that cannot be read falls back to 09:00-17:00."""
    try:
        start, end = map(_clock_seconds, business_hours.split("-"))
    except ValueError:
        start, end = map(_clock_seconds, BUSINESS_HOURS.split("-"))
    micros_of_day = F.pmod(epoch_micros(ts), F.lit(86_400_000_000))
    return (micros_of_day < start * 1_000_000) | (micros_of_day > end * 1_000_000)


def risk_factors(severity: Column, criticality: Column, threat_score: Column, is_malicious: Column,
                 user_risk: Column, anomaly: Column, triggered_at: Column,
                 business_hours: str = BUSINESS_HOURS) -> dict[str, Column]:
    """The six contributions to a score, by name."""
    base = case_map(F.lower(severity), BASE_WEIGHTS, DEFAULT_BASE)
    multiplier = case_map(F.lower(criticality), ASSET_MULTIPLIERS, 1.0)
    return {
        "base_severity": base,
        "asset_boost": base * multiplier - base,
        "threat_intel_boost": F.when(F.coalesce(is_malicious, F.lit(False)),
                                     F.coalesce(threat_score, F.lit(0)) / 100.0 * THREAT_MAX_BOOST)
        .otherwise(F.lit(0.0)),
        "time_of_day_multiplier": F.when(off_hours(triggered_at, business_hours), F.lit(OFF_HOURS_MULTIPLIER))
        .otherwise(F.lit(1.0)),
        "user_risk_boost": F.coalesce(user_risk, F.lit(0.0)),
        "anomaly_boost": F.coalesce(anomaly, F.lit(0.0)) / 100.0 * ANOMALY_MAX_BOOST,
    }


def risk_score(factors: dict[str, Column]) -> Column:
    """Weighted sum, clamped to 0..100, halves rounded to even."""
    total = (
        factors["base_severity"] + factors["asset_boost"] + factors["threat_intel_boost"]
        + factors["user_risk_boost"] + factors["anomaly_boost"]
    ) * factors["time_of_day_multiplier"]
    return F.bround(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 0).cast("int")


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 80, F.lit("critical")).when(score >= 60, F.lit("high"))
        .when(score >= 40, F.lit("medium")).otherwise(F.lit("low"))
    )


def _plain_number(value: Column) -> Column:
    """``75`` for 75.0, ``37.5`` for 37.5."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def risk_reasoning(factors: dict[str, Column], criticality: Column, asset_name: Column, threat_score: Column,
                   username: Column, anomaly_reason: Column | None = None) -> Column:
    """The contributing factors as one sentence."""
    anomaly = F.lit("anomalous activity detected")
    if anomaly_reason is not None:
        anomaly = F.coalesce(F.concat(anomaly, F.lit(": "), anomaly_reason), anomaly)
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("base severity score of "), _plain_number(factors["base_severity"])),
        F.when((factors["asset_boost"] > 0) & criticality.isNotNull(), F.concat(
            F.initcap(criticality), F.lit(" criticality asset ("), F.coalesce(asset_name, F.lit("")), F.lit(")"))),
        F.when(factors["threat_intel_boost"] > 0, F.concat(
            F.lit("known malicious IP (threat intel score: "), threat_score.cast("string"), F.lit(")"))),
        F.when(factors["time_of_day_multiplier"] > 1, F.lit("occurred outside business hours")),
        F.when((factors["user_risk_boost"] > 0) & (F.trim(username) != ""), F.concat(
            F.lit("high-risk user ("), username, F.lit(")"))),
        F.when(factors["anomaly_boost"] > 0, anomaly),
    )
    return F.concat(F.lit("Risk score is HIGH due to: "), parts)


def score_alerts(alerts: DataFrame, business_hours: str = BUSINESS_HOURS) -> DataFrame:
    """Adds factors, score, level and reasoning to alerts that carry
    ``severity, criticality, asset_name, threat_score, is_malicious, user_risk,
    anomaly, triggered_at, username``. One projection, no shuffle."""
    factors = risk_factors(F.col("severity"), F.col("criticality"), F.col("threat_score"), F.col("is_malicious"),
                           F.col("user_risk"), F.col("anomaly"), F.col("triggered_at"), business_hours)
    named = {name: F.col(f"factor_{name}") for name in factors}
    return alerts.withColumns({f"factor_{name}": value for name, value in factors.items()}) \
        .withColumn("risk_score", risk_score(named)).withColumns({
            "risk_level": risk_level(F.col("risk_score")),
            "reasoning": risk_reasoning(named, F.col("criticality"), F.col("asset_name"), F.col("threat_score"),
                                        F.col("username")),
        })


def write_back(alerts: DataFrame, scores: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts with their scores filled in where there is one. The status is left
    alone; ``scored`` tells that a score has been written."""
    fresh = scores.select(key, F.col("risk_score").alias("_score"), F.col("risk_level").alias("_level"),
                          F.col("reasoning").alias("_reason"), F.to_json("factors").alias("_factors"))
    return alerts.join(fresh, key, "left").withColumns({
        "risk_score": F.coalesce("_score", "risk_score"), "risk_level": F.coalesce("_level", "risk_level"),
        "reasoning": F.coalesce("_reason", "reasoning"), "risk_factors": F.coalesce("_factors", "risk_factors"),
        "scored": F.col("_score").isNotNull(),
    }).drop("_score", "_level", "_reason", "_factors")


# -------------------------------------------------------- reading the enrichment
def asset_from_enrichment(enrichment: Column) -> tuple[Column, Column]:
    """(criticality, name) of the source asset, else of the destination asset."""
    source, target = F.try_element_at(enrichment, F.lit("source_asset")), \
        F.try_element_at(enrichment, F.lit("destination_asset"))
    body = F.coalesce(source, target)
    stored = F.lower(F.get_json_object(body, "$.criticality"))
    criticality = F.when(stored.isin(CRITICALITIES), stored).otherwise(F.lit("low"))
    return F.when(body.isNotNull(), criticality).otherwise(F.lit("low")), F.get_json_object(body, "$.name")


def threat_from_enrichment(enrichment: Column) -> Column:
    """Strongest score struct among the event's reputation scores, null without
    any. Scores sit in one nested JSON map or directly beside other values."""
    score_map = "map<string,struct<is_malicious:boolean,score:int>>"
    nested = F.map_values(F.from_json(F.try_element_at(enrichment, F.lit("threat_intel")), score_map))
    direct = F.transform(F.map_values(enrichment),
                         lambda body: F.from_json(body, "is_malicious boolean, score int"))
    usable = lambda s: s["is_malicious"].isNotNull() & s["score"].isNotNull()
    everything = F.filter(F.concat(F.coalesce(nested, F.array().cast("array<struct<is_malicious:boolean,score:int>>")),
                                   F.coalesce(direct, F.array().cast("array<struct<is_malicious:boolean,score:int>>"))),
                          usable)
    strongest = F.array_max(F.transform(everything, lambda s: F.struct(
        s["score"].alias("score"), s["is_malicious"].alias("is_malicious"))))
    return strongest


def anomaly_from_enrichment(enrichment: Column) -> Column:
    return F.coalesce(F.try_element_at(enrichment, F.lit("anomaly_score")).try_cast("double"), F.lit(0.0))


def read_enrichment(alerts: DataFrame, enrichment: str = "enrichment") -> DataFrame:
    """What ``score_alerts`` needs, but for the user's score, out of what the event carries."""
    criticality, name = asset_from_enrichment(F.col(enrichment))
    return alerts.withColumns({
        "criticality": criticality, "asset_name": name, "_threat": threat_from_enrichment(F.col(enrichment)),
        "anomaly": anomaly_from_enrichment(F.col(enrichment)),
    }).withColumns({"threat_score": F.col("_threat.score"),
                    "is_malicious": F.coalesce("_threat.is_malicious", F.lit(False))}).drop("_threat")


# ----------------------------------------------------------------- user profiles
def risk_points(event_type: Column) -> Column:
    return case_map(F.lower(event_type), USER_RISK_POINTS, 1.0)


def user_profiles(events: DataFrame, points: Column, as_of: Column | None = None, ts: str = "ts",
                  tiebreak: str = "event_id") -> DataFrame:
    """Current profile of each user: points add up to a cap and are forgotten
    after seven silent days.

    Events shrink to one row per user and day before a user's days are put in
    order, so a user with a third of all events is a few hundred rows there.
    """
    stamp = F.col(ts)
    daily = (
        events.filter(F.trim("username") != "")
        .withColumn("_block", floor_div(epoch_micros(stamp), 86_400_000_000))
        .groupBy("username", "_block")
        .agg(F.sum(points).alias("_sum"), F.count("*").alias("_n"),
             F.min(epoch_micros(stamp)).alias("_start"), F.max(epoch_micros(stamp)).alias("_end"),
             F.max(F.struct(stamp.alias("ts"), F.col(tiebreak).alias("id"),
                            F.col("event_type").alias("event_type"))).alias("_last"))
    )
    lives = block_stretches(daily, "username", USER_RISK_DAYS * 86400).groupBy("username", "stretch").agg(
        F.least(F.sum("_sum"), F.lit(USER_RISK_CAP)).alias("score"), F.sum("_n").alias("event_count"),
        F.max("_last").alias("_last"))
    current = lives.groupBy("username").agg(
        F.max_by(F.struct("score", "event_count", "_last"), "stretch").alias("p")).select(
        "username", "p.score", "p.event_count", F.col("p._last.ts").alias("last_updated"),
        F.col("p._last.event_type").alias("last_event_type"))
    if as_of is None:
        return current
    return current.filter(F.col("last_updated") > as_of - F.make_interval(days=F.lit(USER_RISK_DAYS)))


def user_risk_at_event(events: DataFrame, points: Column, ts: str = "ts",
                       tiebreak: str = "event_id") -> DataFrame:
    """Each event with its user's score right after it."""
    named = events.filter(F.trim("username") != "")
    return running_totals(named, "username", F.col(ts), tiebreak, points, USER_RISK_DAYS * 86400) \
        .withColumn("user_risk", F.least("running", F.lit(USER_RISK_CAP))).drop("running", "stretch")


def user_risk_of_alerts(alerts: DataFrame, events: DataFrame, points: Column, ts: str = "ts",
                        tiebreak: str = "event_id") -> DataFrame:
    """Alerts with ``user_risk``: their user's score when they were triggered, what happened
    at that instant included; 0 without a user or after seven silent days."""
    running = user_risk_at_event(events, points, ts, tiebreak).select("username", F.col(ts).alias("_at"), "user_risk")
    return asof_value(alerts, running, "username", "triggered_at", "_at", "user_risk", "user_risk", USER_RISK_DAYS * 86400) \
        .withColumn("user_risk", F.coalesce("user_risk", F.lit(0.0)))


def anomaly_of_alerts(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Alerts with the ``anomaly`` score that their user, host and clock hour got, or else the one they carry."""
    keyed = alerts.withColumn("hour_start", F.date_trunc("hour", "triggered_at"))
    found = verdicts.select("username", "hostname", "hour_start", F.col("score").alias("_score"))
    return keyed.join(found, ["username", "hostname", "hour_start"], "left") \
        .withColumn("anomaly", F.coalesce("_score", "anomaly")).drop("_score", "hour_start")
