"""Event envelopes on topics: JSON text in camelCase to and from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basic import case_map, empty_map
from ..model import ENVELOPE, EVENT_TYPES, PACKET, PROTOCOLS, SEVERITIES
from ..operators.fields import merge_maps
from ..operators.parsing import protocol_name, string_map


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(word.capitalize() for word in rest)


def camel_layout(layout: T.StructType) -> T.StructType:
    """The same layout with the field names used in JSON."""
    return T.StructType([
        T.StructField(camel(f.name), camel_layout(f.dataType) if isinstance(f.dataType, T.StructType) else f.dataType)
        for f in layout.fields])


def stored_name(name: Column, known: list[str]) -> Column:
    """Enumeration value in any spelling as its stored snake_case form."""
    return case_map(F.lower(F.translate(name, "_", "")), {value.replace("_", ""): value for value in known}, "unknown")


def decode_envelopes(rows: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns out of JSON text. Text that is not an envelope keeps its
    row with ``decoded`` false, so poison messages are visible, not lost."""
    body = F.from_json(F.col(value).cast("string"), camel_layout(ENVELOPE), {"mode": "PERMISSIVE"}).cast(ENVELOPE)
    opened = rows.withColumn("_body", body).select("*", *[F.col(f"_body.{f.name}").alias(f.name) for f in ENVELOPE])
    kept = [c for c in rows.columns if c != value]
    normalized = F.col("normalized")
    normal = F.when(normalized.isNotNull(), normalized.withField(
        "event_type", stored_name(normalized["event_type"], EVENT_TYPES)).withField(
        "severity", stored_name(normalized["severity"], SEVERITIES)).withField(
        "protocol", stored_name(normalized["protocol"], PROTOCOLS)))
    return opened.withColumns({
        "decoded": F.coalesce(F.col("event_id").isNotNull(), F.lit(False)), "normalized": normal,
        "enrichment": F.coalesce("enrichment", empty_map()),
    }).select(*kept, *ENVELOPE.fieldNames(), "decoded")


def encode_envelopes(envelopes: DataFrame) -> DataFrame:
    """(key, value) messages: event id and JSON without nulls."""
    return envelopes.select(
        F.col("event_id").cast("string").alias("key"),
        F.to_json(F.struct(*ENVELOPE.fieldNames()).cast(camel_layout(ENVELOPE)),
                  {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def read_topic(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Envelope stream of Kafka topics; needs the connector on the cluster.
    The stream checkpoint takes the place of committed offsets."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers) \
        .option("subscribe", topics).options(**options).load()
    return decode_envelopes(raw.select("topic", "partition", "offset", F.col("timestamp").alias("arrived_at"), "value"))


def write_topic(envelopes: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish an envelope stream; the idempotent producer and the checkpoint
    make retries safe."""
    return encode_envelopes(envelopes).writeStream.format("kafka") \
        .option("kafka.bootstrap.servers", servers).option("kafka.enable.idempotence", "true") \
        .option("topic", topic).option("checkpointLocation", checkpoint).start()


# --------------------------------------------------------------------- flatten
def flatten_events(envelopes: DataFrame) -> DataFrame:
    """Fifteen analytic columns with their defaults, plus the month to store by."""
    n = lambda name: F.col(f"normalized.{name}")
    text = lambda column: F.coalesce(column, F.lit(""))
    stamp = F.coalesce(n("timestamp"), F.col("received_at"))
    return envelopes.select(
        F.col("event_id").cast("string").alias("event_id"), "received_at", stamp.alias("event_timestamp"),
        F.coalesce(n("event_type"), F.lit("unknown")).alias("event_type"),
        F.coalesce(n("severity"), F.lit("info")).alias("severity"),
        text(n("source_ip")).alias("source_ip"), text(n("destination_ip")).alias("destination_ip"),
        F.coalesce(n("source_port"), F.lit(0)).alias("source_port"),
        F.coalesce(n("destination_port"), F.lit(0)).alias("destination_port"),
        F.coalesce(n("protocol"), F.lit("unknown")).alias("protocol"),
        text(n("username")).alias("username"), text(n("hostname")).alias("hostname"),
        text(n("device_name")).alias("device_name"), "source", "source_type",
        F.date_format(stamp, "yyyy-MM").alias("event_month"),
    )


# --------------------------------------------------------------------- packets
def packets_to_envelopes(packets: DataFrame) -> DataFrame:
    """Landed packet rows as envelopes; the id is a digest of the packet row."""
    metadata = merge_maps(F.coalesce(F.col("metadata"), empty_map()), string_map({
        "payloadPreview": F.when(F.trim("payload_preview") != "", F.col("payload_preview")),
        "sni": F.when(F.trim("sni") != "", F.col("sni"))}))
    key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f.name).cast("string"), F.lit(""))
                                    for f in PACKET if f.name != "metadata"]), 256)
    lookup = lambda name: F.try_element_at(F.col("_meta"), F.lit(name))
    null = lambda kind: F.lit(None).cast(kind)
    raw = F.to_json(F.struct(
        F.col("source_ip").alias("sourceIp"), F.col("destination_ip").alias("destinationIp"), "protocol", "timestamp",
        F.col("source_port").alias("sourcePort"), F.col("destination_port").alias("destinationPort"),
        F.col("raw_payload").alias("rawPayload"), "sni", F.col("_meta").alias("metadata")))
    normalized = F.struct(
        F.col("_key").alias("id"), F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.lit("network_traffic").alias("event_type"), F.lit("info").alias("severity"), "source_ip", "destination_ip",
        "source_port", "destination_port", protocol_name(F.col("protocol")).alias("protocol"),
        F.col("payload_preview").alias("payload"), F.col("_meta").alias("metadata"),
        lookup("deviceName").alias("device_name"), lookup("sensorId").alias("sensor_id"),
        null("string").alias("username"), null("string").alias("hostname"))
    return packets.withColumns({"_meta": metadata, "_key": key}).select(
        F.col("_key").alias("event_id"), F.col("timestamp").cast("timestamp").alias("received_at"),
        F.lit("network-sensor").alias("source"), F.lit("packet-capture").alias("source_type"), raw.alias("raw"),
        normalized.alias("normalized"), empty_map().alias("enrichment"), F.lit("v1.0").alias("schema_version"))
