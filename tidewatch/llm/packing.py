"""Packing of token sequences into windows by non-negative least squares.

Every document is cut into whole windows and one remainder. For the remainders'
lengths, combinations of two or three that fill a window are enumerated, the
number of times each is used is solved against the histogram of lengths, and
the rounded solution is carried out. What is left is laid end to end and cut at
window borders. The plan depends on the histogram alone (one count for each
length below the window), so it is small whatever the corpus; where a document
goes follows from its rank among those of its length.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, written

WINDOW = 2048
FREQUENT = 32  # lengths tried as the second of three


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of the given lengths that fill a window: all pairs, triples whose second member is the
    first again or one of the most frequent lengths, and equal parts."""
    present = set(lengths.tolist())
    frequent = lengths[np.argsort(-counts, kind="stable")][:FREQUENT].tolist()
    found = {(a, window - a) for a in present if 2 * a >= window and window - a in present}
    for a in present:
        for b in {a, *frequent}:
            c = window - a - b
            if c > 0 and c in present:
                found.add(tuple(sorted((a, b, c), reverse=True)))
        if window % a == 0 and window // a <= 8:
            found.add((a,) * (window // a))
    return sorted(found, reverse=True)


def nonnegative_least_squares(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, size: int,
                              rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |Ax - target|, where A has a one added at each (row, column) pair; by accelerated projected
    gradients."""
    scale = max(1.0, float(target.max(initial=0)))
    goal = target / scale

    def times(x):
        return np.bincount(rows, x[columns], minlength=len(goal))

    def transposed(y):
        return np.bincount(columns, y[rows], minlength=size)

    probe = np.ones(size)
    for _ in range(12):
        probe = transposed(times(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * np.linalg.norm(transposed(times(probe))))
    x = ahead = np.zeros(size)
    weight = 1.0
    for _ in range(rounds):
        moved = np.maximum(0, ahead - step * transposed(times(ahead) - goal))
        following = (1 + (1 + 4 * weight * weight) ** 0.5) / 2
        ahead = moved + (weight - 1) / following * (moved - x)
        x, weight = moved, following
    return x * scale


@dataclass
class Plan:
    """Where the remainder of a length and rank goes."""

    window: int
    # By length: ends of rank ranges, and (first rank, first sequence, offsets) of each.
    ends: dict[int, list[int]] = field(default_factory=dict)
    ranges: dict[int, list[tuple[int, int, tuple[int, ...]]]] = field(default_factory=dict)
    planned: dict[int, int] = field(default_factory=dict)
    left_at: dict[int, int] = field(default_factory=dict)  # where a length's left-over begins in their row
    n_planned: int = 0  # sequences of the plan
    n_left: int = 0  # sequences of left-overs
    left_total: int = 0

    def borders(self) -> list[int]:
        """Starts of the last left-over sequences, which together are less than a window: powers of two, so
        that they need no padding."""
        at = self.left_total - self.left_total % self.window
        found, size = [], self.window
        while size > 1:
            size //= 2
            if self.left_total - at >= size:
                found.append(at)
                at += size
        return found

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the remainder, length, sequence, offset) of each piece."""
        ends = self.ends.get(length, [])
        i = bisect_right(ends, rank)
        if i < len(ends):
            first, sequence, offsets = self.ranges[length][i]
            turn, slot = divmod(rank - first, len(offsets))
            return [(0, length, sequence + turn, offsets[slot])]
        at = self.left_at[length] + (rank - self.planned.get(length, 0)) * length
        end, whole, tail = at + length, self.left_total // self.window, self.borders()
        found, start = [], at
        while at < end:
            if at < whole * self.window:
                number, begin = divmod(at, self.window)
                begin = at - begin
                until = begin + self.window
            else:
                k = bisect_right(tail, at) - 1
                number, begin = whole + k, tail[k]
                until = tail[k + 1] if k + 1 < len(tail) else self.left_total
            size = min(end, until) - at
            found.append((at - start, size, self.n_planned + number, at - begin))
            at += size
        return found


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """A plan for remainders of the given lengths, each shorter than the window."""
    plan = Plan(window)
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    mixes = combinations(lengths, counts, window)
    left = dict(histogram)
    if mixes:
        index = {n: i for i, n in enumerate(lengths.tolist())}
        rows = np.array([index[n] for mix in mixes for n in mix])
        columns = np.repeat(np.arange(len(mixes)), [len(mix) for mix in mixes])
        solved = nonnegative_least_squares(rows, columns, counts.astype(float), len(mixes))
        uses = np.zeros(len(mixes), np.int64)
        order = np.argsort(-solved, kind="stable").tolist()
        # Rounded first; then as often as what is left allows.
        for wanted in (np.rint(solved).astype(np.int64).tolist(), None):
            for k in order:
                if wanted and not wanted[k]:
                    continue
                mix = mixes[k]
                most = min(left[n] // mix.count(n) for n in mix)
                times = min(most, wanted[k]) if wanted else most
                if times:
                    uses[k] += times
                    for n in mix:
                        left[n] -= times
        for k in np.flatnonzero(uses).tolist():
            mix, times = mixes[k], int(uses[k])
            offsets: dict[int, list[int]] = {}
            at = 0
            for n in mix:
                offsets.setdefault(n, []).append(at)
                at += n
            for n, slots in offsets.items():
                first = plan.planned.get(n, 0)
                plan.ranges.setdefault(n, []).append((first, plan.n_planned, tuple(slots)))
                plan.planned[n] = first + times * len(slots)
                plan.ends.setdefault(n, []).append(plan.planned[n])
            plan.n_planned += times
    for n in sorted(histogram, reverse=True):
        plan.left_at[n] = plan.left_total
        plan.left_total += left[n] * n
    plan.n_left = plan.left_total // window + len(plan.borders())
    return plan


_coders: dict[str, tiktoken.Encoding] = {}


def coder(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-level BPE of a tokenizers file, as ranks: a merge's rank is the id of what it makes."""
    if path not in _coders:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others
        # for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        made = {left + right for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        ranks = {bytes(map(byte_of.__getitem__, token)): number for token, number in model["vocab"].items()
                 if len(token) == 1 or token in made}
        _coders[path] = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _coders[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("ids", pa.binary())])
_PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def tokenized(docs: DataFrame, path: str, pattern: str, end_id: int, window: int, doc_id: str, text: str) -> DataFrame:
    """Whole windows and remainders of each document's ids, numbered; ids are little-endian 16-bit."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def convert(batch):
        encode = coder(path, pattern)
        if encode.max_token_value >= 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        for first in range(0, batch.num_rows, 256):
            part, found = batch.slice(first, 256), []
            for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = encode.encode_to_numpy(value or "", disallowed_special=())
                ids = np.append(ids, end_id).astype("<u2")
                found += [(key, i, min(window, len(ids) - i), len(ids), ids[i:i + window].tobytes())
                          for i in range(0, len(ids), window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _PIECES)], schema=_PIECES)

    pieces = by_batch(rows, convert, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return written(pieces.select(F.monotonically_increasing_id().alias("number"), "*"), "tokens", "zstd")


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 1, window: int = WINDOW, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all documents, each in
    its place. ``ids`` are little-endian 32-bit.

    A document is its ids and ``end_id``; a null or empty text is that id alone.
    Repeated rows are packed each, null ids stay null, an empty table gives no
    rows. ``path`` is a byte-level BPE file of the tokenizers library whose ids
    follow its merges, readable on every worker. The window is a power of two.
    """
    spark = docs.sparkSession
    pieces = tokenized(docs, path, pattern, end_id, window, doc_id, text)
    rest = pieces.where(F.col("length") < window)
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # < window rows
    plan = plan_windows(histogram, window)

    # Rank within a length: a hot length is dealt into as many parts as each part has rows.
    parts = F.array(*[F.lit(max(1, round(histogram.get(n, 0) ** 0.5))) for n in range(1, window)])
    part = F.pmod(F.xxhash64("number"), F.element_at(parts, F.col("length").cast("int"))).alias("part")
    counts = rest.select("length", part).groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("number")) - 1
    ranked = (rest.select("*", part).withColumn("within", within).join(firsts, ["length", "part"])
              .withColumn("rank", F.col("first") + F.col("within")))
    columns = ["doc_id", "start", "length", "doc_tokens", "ids", "number", "rank"]
    whole = pieces.where(F.col("length") == window).withColumn("rank", F.lit(None).cast("long"))
    shared = spark.sparkContext.broadcast(plan)  # below ``window`` lengths, each in few combinations
    first_whole = plan.n_planned + plan.n_left

    def place(batch):
        chosen = shared.value
        for first in range(0, batch.num_rows, 512):
            found = []
            for key, start, length, total, ids, number, rank in zip(
                    *(c.to_pylist() for c in batch.slice(first, 512).columns)):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                if rank is None:
                    found.append((key, start, length, total, first_whole + number, 0, wide.tobytes()))
                else:
                    found += [(key, start + at, size, total, sequence, offset, wide[at:at + size].tobytes())
                              for at, size, sequence, offset in chosen.places(length, rank)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _PLACED)], schema=_PLACED)

    return by_batch(ranked.select(columns).union(whole.select(columns)), place,
                    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
