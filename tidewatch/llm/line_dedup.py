"""Line dedup: lines that stand in many documents go, all but one document's.

Native throughout: lines are exploded with their keys, distinct documents are
counted for each key's hash, and what stays is put together by position. Only
hashes, ids and positions are shuffled to find the lines; each text is shuffled
once, to meet its dropped positions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, salt_of, salted

WHITE = " \t\n\x0b\x0c\r"
SALTS = 32


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, doc_id: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """(row, kept_text, n_lines, n_dropped) for each row of ``docs``; ``row`` is the row as it came.

    A key of at least ``min_chars`` code points found in ``min_docs`` or more
    documents loses all its lines but those of the largest id that holds it.
    Rows of one id are one document. A null id counts as one document and is
    never the largest beside others. A null or empty text is one empty line. An
    empty table gives no rows. Any number of lines of a document may go; if all
    go, the text is empty. The work on a text grows with its length, however
    many lines it has and however many of them go.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    rows = rows.select("row", F.coalesce(F.col("row").getField(doc_id).cast("long"), F.lit(-(2**63))).alias("doc"),
                       F.xxhash64(body).alias("text_key"))

    # The text's key is taken before the text is exploded: else each line would carry the text and hash it anew.
    keys = F.transform(F.split("text", "\n"), line_key)
    lines = keyed_texts(docs, doc_id, text).select("doc", "text_key", F.posexplode(keys).alias("position", "key"))
    lines = (lines.where(F.char_length("key") >= min_chars)
             .select("doc", "text_key", "position", F.unhex(F.md5("key")).alias("line")))

    repeated = (lines.select("line", "doc").distinct().groupBy("line")
                .agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc")).where(F.col("n_docs") >= min_docs))
    # A line may stand in a third of all documents, so its lines are dealt out by salt.
    dropped = (lines.withColumn("salt", salt_of(F.col("doc"), SALTS))
               .join(salted(repeated.select("line", "last_doc"), SALTS), ["line", "salt"])
               .where(F.col("doc") < F.col("last_doc"))
               .groupBy("doc", "text_key").agg(F.collect_set("position").alias("dropped")))

    n_lines = F.size(F.split(body, "\n"))
    stays = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("dropped"))
    # The text is split once, whatever the number of its lines: the array is bound before it is looked into.
    kept = F.get(F.transform(F.array(F.split(body, "\n")), lambda parts: F.array_join(
        F.transform(stays, lambda i: F.get(parts, i)), "\n")), F.lit(0))
    return rows.join(dropped, ["doc", "text_key"], "left").select(
        "row", F.when(F.col("dropped").isNull(), body).otherwise(kept).alias("kept_text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
