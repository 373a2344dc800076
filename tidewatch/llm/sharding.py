"""Sharding by an external shuffle in two passes.

The first pass writes every record with a seeded hash that deals it to one of
many buckets, each small enough for a task's memory. The second brings a bucket
together, puts it into a Fisher-Yates order and lays the buckets end to end; a
record's place in that line gives its shard and slot. Native throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

LAW = "rows"  # what holds: shards differ by one row at most
BUCKET_BYTES = 32 << 20
_TOGETHER = 1024


def shuffled(rows: DataFrame, shards: int = 16, text: str = "text", seed: int = 0,
             bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, size, bucket, shard, slot) for each row of ``rows`` in a random order.

    ``size`` is the bytes of the text and one more; a null text has none. The
    hash is of a row's number and the seed, so copies, null ids and repeated
    rows are dealt like others and each gets a slot of its own. Shards differ by
    one row at most; slots count from 0 without gaps. A text larger than a
    bucket is a large bucket, never cut. An empty table gives no rows. Names of
    other columns do not matter: ``row`` is the row as it came.

    The same rows from the same files with the same seed get the same places.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1
    marked = written(rows.select(
        F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("draw"), size.alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")), "scatter")
    total = marked.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    marked = marked.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))

    # A bucket's place in the line travels to it as one more row, so no text takes part in a join.
    starts = _starts(marked.groupBy("bucket").agg(F.count("*").alias("n")))
    none = F.lit(None)
    dealt = marked.withColumn("start", none.cast("long")).unionByName(
        starts.select(none.cast("long").alias("draw"), none.cast("long").alias("size"),
                      none.cast(marked.schema["row"].dataType).alias("row"), "bucket", "start"))
    together = (dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "draw").groupBy("bucket")
                .agg(F.max("start").alias("start"),
                     F.collect_list(F.when(F.col("draw").isNotNull(), F.struct("size", "row"))).alias("records")))
    placed = together.withColumn("records", F.shuffle("records", seed)).select(
        "bucket", "start", F.posexplode("records").alias("place", "record"))
    at = F.col("start") + F.col("place")
    return placed.select("record.row", "record.size", "bucket", (at % shards).cast("int").alias("shard"),
                         F.floor(at / shards).cast("long").alias("slot"))


def _starts(counts: DataFrame) -> DataFrame:
    """(bucket, start): rows in the buckets before it. Buckets are added up in blocks, then the blocks."""
    before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)),
                                       F.lit(0))
    blocked = counts.withColumn("block", F.floor(F.col("bucket") / _TOGETHER))
    blocks = blocked.groupBy("block").agg(F.sum("n").alias("n")).select(
        "block", before(Window.orderBy("block")).alias("first"))
    inside = blocked.select("bucket", "block", before(Window.partitionBy("block").orderBy("bucket")).alias("inside"))
    return inside.join(blocks, "block").select("bucket", (F.col("first") + F.col("inside")).alias("start"))


def write_shards(rows: DataFrame, path: str, shards: int = 16, text: str = "text", seed: int = 0,
                 bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write (row, slot) to a folder for each shard. Inside a shard the files, in
    the order of their smallest slot, are its sequence; each is written in order."""
    placed = shuffled(rows, shards, text, seed, bucket_bytes)
    placed.select("row", "slot", "shard").write.partitionBy("shard").parquet(path)
