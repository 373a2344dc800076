"""What the text operators share: row keys, batch maps and written steps.

Conventions of all operators: a null text is an empty text; a null ``doc_id``
is one document that comes before every other; repeated rows are judged alike
and all returned. Columns other than the key and the text are never looked at,
so their names and nulls do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, work_dir

FIRST = -(2**63)  # stands for a null id: before every other
MASK64 = (1 << 64) - 1
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when an execution ends


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def order_id(column: str) -> Column:
    """The id as a long that sorts a null first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(FIRST))


def plain_id(column: str) -> Column:
    """Undo ``order_id``."""
    return F.when(F.col(column) != FIRST, F.col(column))


def keyed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_key, text): rows with the same first two columns are the same."""
    rows = docs.select(order_id(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc", F.xxhash64("text").alias("text_key"), "text")


def written(rows: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The rows, written to the shared working folder and read back.

    Cuts the lineage where a result is used more than once, and survives lost
    executors. The folder lies under ``spark.checkpoint.dir``. What was shuffled
    to make the rows is deleted, not left until the driver collects its garbage.
    """
    spark = rows.sparkSession
    path = work_dir(spark, label)
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        rows.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)
    return spark.read.schema(rows.schema).parquet(path)


def by_batch(rows: DataFrame, convert: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``convert`` to each Arrow batch of each partition."""

    ship_package(rows.sparkSession)

    def run(batches):
        for batch in batches:
            yield from convert(batch)

    return rows.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(rows: DataFrame, salts: int) -> DataFrame:
    """Every row once for each salt, for the small side of a join on a hot key."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(column: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], spread: str, salts: int = 8) -> DataFrame:
    """Inner join of ``rows`` with narrow rows ``side``, unique by ``keys``, of which one may match a
    third of ``rows``: these are dealt out by ``spread``, and each row of ``side`` goes to all ``salts``."""
    return rows.withColumn("salt", salt_of(F.col(spread), salts)).join(salted(side, salts), [*keys, "salt"]).drop("salt")
