"""Erasure, export, restriction and pseudonyms of a person's data."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mask_email


def erase_from_audit(audit: DataFrame, subjects: DataFrame, salt: str = "") -> DataFrame:
    """Audit rows stay, but nothing in a subject's rows names them any more.
    The stand-in name is a salted digest, so one person's rows still belong
    together without telling whose they are."""
    marked = audit.join(subjects.select(F.col("user_name").alias("_subject")).dropDuplicates(),
                        F.col("user_name") == F.col("_subject"), "left")
    gone = F.col("_subject").isNotNull()
    digest = F.left(F.sha2(F.concat(F.col("user_name"), F.lit(salt)), 256), F.lit(16))
    return marked.withColumns({
        "user_name": F.when(gone, F.concat(F.lit("anonymized-"), digest)).otherwise(F.col("user_name")),
        "ip_address": F.when(gone, F.lit("0.0.0.0")).otherwise(F.col("ip_address")),
        "user_agent": F.when(gone, F.lit("anonymized")).otherwise(F.col("user_agent")),
    }).drop("_subject")


def erase_rows(rows: DataFrame, subjects: DataFrame, owner: str) -> DataFrame:
    """Alerts or assets without those of the subjects."""
    gone = subjects.select(F.col("user_name").alias("_subject"))
    return rows.join(gone, F.col(owner) == F.col("_subject"), "left_anti")


# ------------------------------------------------------------- in stored tables
_MANIFEST = "_erasure.json"


def erase_in_files(spark: SparkSession, path: str, subjects: DataFrame, owner: str,
                   erase: Callable[[DataFrame], DataFrame], partition_by: list[str] | None = None) -> list[str]:
    """Apply ``erase`` to the files of a parquet table that hold rows of the subjects; returns those files.

    A scan of the owner column alone finds the files; only they are read,
    rewritten into a hidden folder and swapped. All others stay as they are. What is to
    be swapped is noted in the table's folder first, so an erasure that was cut
    off is completed by the next one, or by ``finish_erasure``. Where no row stays, no file
    stays either: such a table is read with its schema given.
    """
    finish_erasure(spark, path)
    if not any(map(_visible, _File(spark, path).files())):
        return []
    rows = spark.read.parquet(path)
    gone = subjects.select(F.col("user_name").alias("_subject"))
    holding = rows.select(F.col(owner).alias("_owner"), F.col("_metadata.file_path").alias("file")) \
        .join(gone, F.col("_owner") == F.col("_subject"), "left_semi").select("file").distinct()
    files = sorted(row.file for row in holding.collect())
    if not files:
        return []
    fresh = f"{path.rstrip('/')}/_fresh-{uuid.uuid4().hex[:12]}"
    kept = erase(spark.read.schema(rows.schema).option("basePath", path).parquet(*files))
    writer = kept.select(rows.columns).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh)
    _File(spark, f"{path.rstrip('/')}/{_MANIFEST}").write(json.dumps({"old": files, "fresh": fresh}))
    finish_erasure(spark, path)
    return files


def finish_erasure(spark: SparkSession, path: str) -> None:
    """Complete a swap that was noted and not ended: the old files go, then the fresh ones move in."""
    base = path.rstrip("/")
    note = _File(spark, f"{base}/{_MANIFEST}")
    if not note.exists():
        return
    plan = json.loads(note.read())
    for old in plan["old"]:
        _File(spark, old).delete()
    fresh = _File(spark, plan["fresh"])
    for inside in fresh.files():
        if inside.rsplit("/", 1)[-1].startswith("part-"):
            _File(spark, f"{plan['fresh']}/{inside}").move(_File(spark, f"{base}/{inside}"))
    fresh.delete()
    note.delete()


def _visible(inside: str) -> bool:
    """Whether Spark reads a file of a table's folder."""
    return not any(name.startswith(("_", ".")) and "=" not in name for name in inside.split("/"))


class _File:
    """A file or folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(context._jsc.hadoopConfiguration())
        self._text = context._jvm.org.apache.commons.io.IOUtils

    def exists(self) -> bool:
        return self._files.exists(self._path)

    def delete(self) -> None:
        self._files.delete(self._path, True)

    def write(self, text: str) -> None:
        out = self._files.create(self._path, True)
        self._text.write(text, out, "UTF-8")
        out.close()

    def read(self) -> str:
        stream = self._files.open(self._path)
        text = self._text.toString(stream, "UTF-8")
        stream.close()
        return text

    def move(self, target: _File) -> None:
        self._files.mkdirs(target._path.getParent())
        if not self._files.rename(self._path, target._path):
            raise OSError(f"could not move {self._path.toString()} to {target._path.toString()}")

    def files(self) -> list[str]:
        """Paths of all files inside, relative to the folder."""
        if not self.exists():
            return []
        base = self._files.makeQualified(self._path).toString().rstrip("/") + "/"
        found, left = [], self._files.listFiles(self._path, True)
        while left.hasNext():
            found.append(left.next().getPath().toString().removeprefix(base))
        return found


def export_subject(tables: dict[str, tuple[DataFrame, str, str]], subjects: DataFrame) -> DataFrame:
    """Every row that belongs to a subject, from all tables, as JSON.

    ``tables``: name -> (rows, owner column, id column).
    """
    exported = None
    for name, (rows, owner, key) in tables.items():
        mine = rows.join(subjects.select(F.col("user_name").alias("_subject")).dropDuplicates(),
                         F.col(owner) == F.col("_subject"))
        part = mine.select(F.col("_subject").alias("user_name"), F.lit(name).alias("source_table"),
                           F.col(key).cast("string").alias("row_id"), F.to_json(F.struct(*rows.columns)).alias("body"))
        exported = part if exported is None else exported.unionByName(part)
    return exported


def without_restricted(events: DataFrame, restricted: DataFrame, owner: str = "username") -> DataFrame:
    """Events whose person has not restricted processing."""
    return events.join(restricted.select(F.col("user_name").alias("_subject")),
                       F.col(owner) == F.col("_subject"), "left_anti")


def pseudonym_ip(ip: Column, salt: str) -> Column:
    return F.sha2(F.concat(ip, F.lit(salt)), 256)


def pseudonym_user(user: Column) -> Column:
    return F.concat(F.left(user, F.lit(1)), F.lit("***"), F.right(user, F.lit(1)))


def pseudonymize(rows: DataFrame, salt: str, ip_columns: list[str], user_columns: list[str],
                 text_columns: list[str] | None = None) -> DataFrame:
    return rows.withColumns({
        **{name: pseudonym_ip(F.col(name), salt) for name in ip_columns},
        **{name: pseudonym_user(F.col(name)) for name in user_columns},
        **{name: mask_email(F.col(name)) for name in text_columns or []},
    })
