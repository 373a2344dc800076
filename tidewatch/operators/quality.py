"""Schema checks, size limits and table constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import all_of
from ..functions.text import MAX_EVENT_BYTES, MAX_FIELD_CHARS, has_control_chars
from ..model import ASSET_TYPES, CRITICALITIES, EVENT_TYPES, HTTP_METHODS, PROTOCOLS, SEVERITIES

# Address spelling the event schema accepts.
SCHEMA_IP = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$|^$"
REQUIRED = ["id", "timestamp", "event_type", "severity", "source_ip", "destination_ip", "protocol"]
COUNTERS = ["bytes_sent", "bytes_received", "packet_count"]


def event_errors(columns: list[str]) -> Column:
    """Names of the schema rules a row breaks, for the columns it has."""
    have = set(columns)
    broken: list[tuple[str, Column]] = [
        (f"{name} is required", F.col(name).isNull() if name in have else F.lit(True)) for name in REQUIRED]

    def rule(name: str, message: str, bad) -> None:
        if name in have:
            broken.append((f"{name} {message}", F.coalesce(bad(F.col(name)), F.lit(False))))

    for name, known in (("event_type", EVENT_TYPES), ("severity", SEVERITIES), ("protocol", PROTOCOLS),
                        ("http_method", HTTP_METHODS)):
        rule(name, "is not a known value", lambda c, known=known: ~c.isin(known))
    for name in ("source_ip", "destination_ip"):
        rule(name, "is not an address", lambda c: ~c.rlike(SCHEMA_IP))
    for name in ("source_port", "destination_port"):
        rule(name, "is out of range", lambda c: ~c.between(0, 65535))
    for name in COUNTERS:
        rule(name, "is negative", lambda c: c < 0)
    rule("http_status_code", "is out of range", lambda c: ~c.between(100, 599))
    return F.array_compact(F.array(*[F.when(bad, F.lit(message)) for message, bad in broken]))


def validate_events(events: DataFrame) -> DataFrame:
    return events.withColumn("errors", event_errors(events.columns)) \
        .withColumn("is_valid", F.size("errors") == 0)


def input_checks(text: Column, max_bytes: int = MAX_EVENT_BYTES, max_chars: int = MAX_FIELD_CHARS) -> dict[str, Column]:
    """Size, encoding, control-character and length tests of one text field."""
    return {
        "size_ok": F.octet_length(text) <= max_bytes,
        "utf8_ok": F.is_valid_utf8(text),
        "control_ok": ~has_control_chars(text),
        "length_ok": F.length(text) <= max_chars,
    }


def check_input(rows: DataFrame, text: Column) -> DataFrame:
    checks = input_checks(text)
    return rows.withColumns(checks).withColumn("accepted", all_of([F.col(name) for name in checks]))


def constraint_violations(assets: DataFrame) -> DataFrame:
    """Asset rows that break a table constraint, and addresses used twice."""
    rules = {
        "ip_address too short": F.length("ip_address") < 7,
        "asset_type unknown": ~F.col("asset_type").isin(ASSET_TYPES),
        "criticality unknown": ~F.col("criticality").isin(CRITICALITIES),
    }
    named = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    single = assets.select(F.explode(named).alias("violation"), F.col("id").cast("string").alias("subject"))
    twice = assets.filter(F.col("ip_address").isNotNull()).groupBy("ip_address").agg(F.count("*").alias("n")) \
        .filter("n > 1").select(F.lit("ip_address not unique").alias("violation"), F.col("ip_address").alias("subject"))
    return single.unionByName(twice)


def packet_violations(packets: DataFrame) -> DataFrame:
    """Packet or name rows whose addresses or names are too short."""
    rules = {"src_ip too short": F.length("src_ip") < 7, "dst_ip too short": F.length("dst_ip") < 7}
    if "sni" in packets.columns:
        rules["sni too short"] = F.length("sni") < 3
    named = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return packets.select(F.explode(named).alias("violation"), F.col("id").cast("string").alias("subject"))
