"""A quality classifier that learns from overlapping heuristics, not from labels.

Simple labellers vote good, bad or nothing on every document. The votes are
counted over the whole corpus, and expectation-maximisation estimates how
often each labeller is right and how likely each pattern of votes is good.
These likelihoods train a linear scorer over hashed features, which then
scores every document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, ship_package
from .html_extract import STOP_WORDS
from .quality_rules import CAPITALS, LETTERS, SYMBOLS, repeated_words

SLOTS = 1 << 14  # hashed features
MOST_SLOTS = 2048  # trigrams that a text is known by: 12 KB, whatever its length
TRAINING_DOCS = 4000  # at most so many documents train the scorer: those of the smallest hashes of id and text
KEEP = 0.1  # documents that score less are rejected; low, so that clean ones stay
STOPS = {w.encode() for w in STOP_WORDS}
ABSTAIN, VOTE_GOOD, VOTE_BAD = 0, 1, 2


@dataclass
class Labeller:
    """Votes bad above (or, if ``low_is_bad``, below) one bound of a measure and good on the other side of
    another; abstains between the two and on texts of fewer words than ``least``."""

    name: str
    measure: str
    bad: float
    good: float
    low_is_bad: bool = False
    least: int = 1


LABELLERS = [
    Labeller("repeated_words", "repeated", 0.5, 0.3, least=20),
    Labeller("few_different_words", "different", 0.35, 0.45, low_is_bad=True, least=20),
    Labeller("repeated_lines", "repeated_lines", 0.5, 0.35),
    Labeller("symbols", "symbols", 0.2, 0.05),
    Labeller("bars", "bars", 0.1, 0.02),
    Labeller("capitals", "capitals", 0.6, 0.4),
    Labeller("capital_words", "capital_words", 0.5, 0.3),
    Labeller("exclamations", "exclamations", 0.3, 0.1),
    Labeller("few_letters", "letters", 0.7, 0.8, low_is_bad=True, least=12),
    Labeller("sentences", "sentence_ends", 0.005, 0.03, low_is_bad=True, least=40),
    Labeller("stop_words", "stop_words", 0.02, 0.08, low_is_bad=True, least=30),
]
MEASURES = ["repeated", "different", "repeated_lines", "symbols", "bars", "capitals", "capital_words", "exclamations",
            "letters", "sentence_ends", "stop_words"]


def measures(data: bytes) -> tuple[int, dict[str, float]]:
    """The number of words and the shares the labellers look at."""
    words = data.split()
    n = max(1, len(words))
    letters = len(data) - len(data.translate(None, LETTERS))
    high = sum(np.frombuffer(data, np.uint8) >= 128) if not data.isascii() else 0
    in_words = max(1, sum(map(len, words)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    lower = data.lower().split()
    ends = data.count(b".") + data.count(b"!") + data.count(b"?")
    return len(words), {
        "repeated": repeated_words(words) / n,
        "different": len(set(lower)) / n if n < 400 else min(1.0, len(set(lower)) / n * (n / 400) ** 0.3),
        "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "symbols": (len(data) - len(data.translate(None, SYMBOLS))) / n,
        "bars": data.count(b"|") / n,
        "capitals": (len(data) - len(data.translate(None, CAPITALS))) / max(1, letters),
        "capital_words": sum(map(bytes.isupper, words)) / n,
        "exclamations": data.count(b"!") / n,
        "letters": (letters + high) / in_words,
        "sentence_ends": ends / n,
        "stop_words": sum(map(STOPS.__contains__, lower)) / n,
    }


def votes(n_words: int, shares: dict[str, float]) -> list[int]:
    found = []
    for labeller in LABELLERS:
        value, bad, good = shares[labeller.measure], labeller.bad, labeller.good
        if labeller.low_is_bad:
            value, bad, good = -value, -bad, -good
        found.append(ABSTAIN if n_words < labeller.least else VOTE_BAD if value > bad else
                     VOTE_GOOD if value <= good else ABSTAIN)
    return found


def features(data: bytes, n_words: int, shares: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: each measure's level, and the shares of the text's hashed byte trigrams, of
    which a long text keeps the ``MOST_SLOTS`` largest."""
    levels = [crc32(f"{name}:{min(20, int(20 * shares[name]))}".encode()) % SLOTS for name in MEASURES]
    levels.append(crc32(b"words:%d" % n_words.bit_length()) % SLOTS)
    slots, values = np.array(levels), np.ones(len(levels))
    if len(data) >= 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        grams = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(18)
        counts = np.bincount(grams, minlength=SLOTS)
        found = np.flatnonzero(counts)
        if len(found) > MOST_SLOTS:
            found = np.sort(found[np.argsort(-counts[found], kind="stable")[:MOST_SLOTS]])
        slots, values = np.concatenate((slots, found)), np.concatenate((values, counts[found] / len(grams)))
    return slots, values


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over patterns of votes (rows) and how often each occurs.

    Returns how likely each pattern is good, how often each labeller votes good
    and bad on documents of either class (labeller, class, vote), and the share
    of good documents. An abstention says nothing. Starts from any bad vote
    meaning bad, and is held near labellers that are right nine times in ten by
    a prior as heavy as a hundredth of the corpus.
    """
    total = counts.sum()
    if not total:
        return np.zeros(0), np.zeros((len(LABELLERS), 2, 2)), 0.5
    good = np.where((patterns == VOTE_BAD).any(1), 0.1, 0.9)
    one_hot = np.stack([patterns == v for v in (VOTE_GOOD, VOTE_BAD)], 2).astype(float)  # pattern, labeller, vote
    prior = np.array([[0.1, 0.9], [0.9, 0.1]])[None] * max(1.0, total / 100)  # class, vote
    for _ in range(rounds):
        weight = np.stack(((1 - good) * counts, good * counts))  # class, pattern
        tables = np.einsum("cp,plv->lcv", weight, one_hot) + prior
        tables /= tables.sum(2, keepdims=True)
        share = (weight[1].sum() + 1) / (total + 2)
        log = np.einsum("plv,lcv->pc", one_hot, np.log(tables)) + np.log([1 - share, share])
        moved = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        done = np.abs(moved - good).max() < 1e-6
        good = moved
        if done:
            break
    return good, tables, share


def train(sizes: np.ndarray, slots: np.ndarray, values: np.ndarray, goals: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic scorer (the last is the constant) for soft goals, from the features of all
    examples in turn and how many each has; both classes weigh the same."""
    weights = np.zeros(SLOTS + 1)
    if not len(sizes):
        return weights
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    share = min(max(goals.mean(), 0.01), 0.99)
    weigh = goals / (2 * share) + (1 - goals) / (2 * (1 - share))
    first, second = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for step in range(1, rounds + 1):
        scores = np.bincount(rows, weights[slots] * values, len(sizes)) + weights[-1]
        error = weigh * (1 / (1 + np.exp(-np.clip(scores, -30, 30))) - goals) / len(sizes)
        slope = np.append(np.bincount(slots, error[rows] * values, SLOTS), error.sum()) + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def score(weights: np.ndarray, data: bytes) -> float:
    slots, values = features(data, *measures(data))
    return float(1 / (1 + np.exp(-np.clip(weights[slots] @ values + weights[-1], -30, 30))))


def _base3(found: list[int]) -> int:
    code = 0
    for vote in found:
        code = 3 * code + vote
    return code


def vote_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """How often each pattern of votes (its base-3 number) occurs; at most 3^11 of them, whatever the corpus."""

    def convert(batch):
        codes = [_base3(votes(*measures((t or "").encode()))) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64())], ["code"])

    rows = by_batch(docs.select(F.col(text).alias("text")), convert, "code long")
    return {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()}


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", training_docs: int = TRAINING_DOCS) -> np.ndarray:
    """The scorer's weights. Votes are counted over all documents; at most ``training_docs`` documents
    (those whose ids and texts have the smallest hashes, so any order of rows gives the same; equal rows
    count as one) train the scorer."""
    counted = vote_counts(docs, text)
    codes = sorted(counted)
    patterns = np.array([[code // 3**i % 3 for i in reversed(range(len(LABELLERS)))] for code in codes],
                        int).reshape(-1, len(LABELLERS))
    good, _, _ = estimate(patterns, np.array([counted[c] for c in codes], float))
    likely = dict(zip(codes, good.tolist()))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("h"), "text")

    def convert(batch):
        found = []
        for value in batch.column(1).to_pylist():
            data = value.encode()
            n, shares = measures(data)
            slots, values = features(data, n, shares)
            found.append((_base3(votes(n, shares)), slots.astype("<u2").tobytes(), values.astype("<f4").tobytes()))
        codes, slots, values = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64()), pa.array(slots, pa.binary()),
                                          pa.array(values, pa.binary())], ["h", "code", "slots", "amounts"])

    # Hashes of different rows are even, so those below a bound are about as many as wanted. Their features are taken
    # where they are read, so no text leaves its task. Where equal rows leave too few, the bound is raised.
    share = 1.25 * training_docs / max(1, sum(counted.values()))
    while True:
        bound = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
        taken = by_batch(rows.where(F.col("h") <= bound), convert, "h long, code long, slots binary, amounts binary")
        sample = taken.dropDuplicates(["h"]).orderBy("h").limit(training_docs).select("code", "slots", "amounts").collect()
        if len(sample) >= training_docs or share >= 1:
            break
        share *= 8
    sample.sort()
    sizes = np.array([len(r["slots"]) // 2 for r in sample], int)
    slots = np.frombuffer(b"".join([r["slots"] for r in sample]), "<u2")
    values = np.frombuffer(b"".join([r["amounts"] for r in sample]), "<f4")
    goals = np.array([likely[r["code"]] for r in sample])
    del sample
    return train(sizes, slots, values, goals)


def scorer(weights: np.ndarray) -> Callable[[str | None], float]:
    return lambda text: score(weights, (text or "").encode())


def classify(docs: DataFrame, weights: np.ndarray, threshold: float = KEEP, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(doc_id, score, kept) for each row. A null text is an empty one, a null id stays null, repeated
    rows score alike, an empty table gives no rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # SLOTS + 1 numbers

    def convert(batch):
        rate = scorer(shared.value)
        scores = [rate(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = by_batch(rows, convert, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return scored.withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = KEEP, text: str = "text") -> DataFrame:
    """The rows that the scorer keeps, with all their columns."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rate(texts: pd.Series) -> pd.Series:
        return texts.map(scorer(shared.value), na_action=None).astype("float64")

    return docs.where(F.pandas_udf(rate, "double")(F.col(f"`{text}`")) >= threshold)
