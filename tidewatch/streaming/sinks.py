"""Running a stream to the end of its present input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import work_dir


def run_append(stream: DataFrame, label: str, partition_by: list[str] | None = None,
               path: str | None = None) -> DataFrame:
    """Process what is there now into parquet (exactly once by the checkpoint)
    and read the table back."""
    spark = stream.sparkSession
    base = work_dir(spark, label)
    target = path or f"{base}/table"
    start_append(stream, target, f"{base}/checkpoint", partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def start_append(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None,
                 every: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table: a batch ``every`` so often (say
    "5 seconds") for as long as it runs, or what is there now. The source's
    own bound (files, bytes or offsets per trigger) bounds a batch."""
    writer = stream.writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint).option("path", path)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()


def run_batches(stream: DataFrame, body: Callable[[DataFrame, int], None], label: str) -> str:
    """Give each batch of what is there now to ``body``; returns the work folder."""
    base = work_dir(stream.sparkSession, label)
    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(body) \
        .trigger(availableNow=True).start().awaitTermination()
    return base


def run_update(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there now in update mode; each batch's changed rows are
    kept under its own folder, so a repeated batch overwrites itself."""
    spark = stream.sparkSession
    base = work_dir(spark, label)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table/batch={batch_id}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint") \
        .foreachBatch(store).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/table")


def stream_files(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int | None = None,
                 bytes_per_trigger: int | None = 64 << 30) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of those present.
    A batch is bounded by files or else by bytes."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(folder)
