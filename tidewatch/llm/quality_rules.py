"""Quality rules kept in a ledger: measured once, judged by any policy later.

``ledger`` measures each text and stores one bit for every rule that fails.
A policy is a versioned set of bits, so a new policy, or what a rule alone is
worth, needs no second look at the texts: ``apply_policy`` and ``ablation``
work on the bits.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_full_lines", "n_capitals",
            "n_letters"]

# Name, and when a text fails it; the position is the bit. Rules are only ever
# added at the end, so stored bits keep their meaning.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 15 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_full_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("capitals", "100 * n_capitals > 50 * n_letters"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
POLICIES = {
    "base-1": BITS["few_words"] | BITS["repeated_words"],
    "prose-1": sum(BITS.values()),
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = reach = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def measure(text: str) -> tuple[int, ...]:
    """The values of ``MEASURES``. Words are runs without ASCII white space."""
    data = text.encode()
    words = data.split()
    white = len(data) - sum(map(len, words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(text) - white, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(data) - len(data.translate(None, CAPITALS)),
            len(data) - len(data.translate(None, LETTERS)))


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, its measures and ``failed``, the bits of failed rules.

    A null or empty text has all measures 0 and fails ``few_words`` only.
    Repeated rows give repeated rows, an empty table none, a null id stays null.
    """
    name = docs.schema[doc_id].dataType.simpleString()

    def convert(batch):
        rows = [measure(t or "") for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])

    measured = by_batch(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), convert,
                        f"doc_id {name}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, policy: str = "prose-1", name: str = "kept") -> DataFrame:
    """Add whether none of the policy's rules failed."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(rows: DataFrame, policy: str = "prose-1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that
    would be kept without it. One aggregation over the bits."""
    mask = POLICIES[policy]
    bits = F.col("failed").bitwiseAND(F.lit(mask))
    rules = [name for name, _ in RULES if BITS[name] & mask]
    sums = [F.sum((bits.bitwiseAND(F.lit(BITS[r])) != 0).cast("long")).alias(f"{r}_failed") for r in rules]
    alone = [F.sum((bits == BITS[r]).cast("long")).alias(f"{r}_alone") for r in rules]
    whole = rows.agg(F.count("*").alias("n_docs"), F.sum((bits == 0).cast("long")).alias("n_kept"), *sums, *alone)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(f"{r}_failed", F.lit(0)).alias("failed"),
                              F.coalesce(f"{r}_alone", F.lit(0)).alias("failed_alone"),
                              (F.coalesce("n_kept", F.lit(0)) + F.coalesce(f"{r}_alone", F.lit(0))).alias("kept_without"))
                     for r in rules])
    return whole.select("n_docs", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.inline(each))
