"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node it can reach.

    Large-star and small-star rounds: every node hangs its larger neighbours,
    then its smaller ones, on its smallest. The number of edges does not grow,
    the edges of a node are dealt out, and each round's edges are written.
    """
    rows = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    rows = written(rows, "edges")
    before = None
    while True:
        state = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
        both = rows.select(F.col("high").alias("u"), F.col("low").alias("v")).union(rows.select("low", "high"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_hot(both, least, ["u"], "v").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = join_hot(large, least, ["high"], "low").select(
            F.explode(F.array(F.struct(F.col("low").alias("high"), F.col("m").alias("low")),
                              F.struct(F.col("high").alias("high"), F.col("m").alias("low")))).alias("e"))
        rows = written(joined.select("e.*").where("high <> low").distinct(), "edges")
    return rows.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        rows.select("low", "low").distinct())
