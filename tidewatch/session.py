"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings an operator needs to give the same answer on any cluster. They are
# all runtime settings, so they can be applied to a session that already runs.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once in each application, so that functions
    of its modules can be loaded there wherever the session was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # else it was itself shipped as an archive
        archive = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "tidewatch.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
    _shipped.add(context.applicationId)


def local_session(app: str = "tidewatch", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Building a column otherwise asks the JVM for its call site each time,
        # which dominates the compiling of large rule sets.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("tidewatch.inputPartitions", str(spark.sparkContext.defaultParallelism))
    return configure(spark)


_local_root: str | None = None


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for stream checkpoints and cut-lineage tables.

    It lies under ``spark.checkpoint.dir``, which on a cluster names shared
    storage. Only a local session may fall back to a temporary folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_root = root = _local_root or tempfile.mkdtemp(prefix="tidewatch-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written to a fresh working folder and read back: for what is used more
    than once and costs more to make than to keep."""
    path = work_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
