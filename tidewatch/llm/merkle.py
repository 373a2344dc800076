"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph is a line. Paragraphs are gathered into sections that end where a
paragraph's own hash says so, so an edit does not move the borders behind it.
A paragraph is cut into pieces the same way, by a rolling hash over its bytes,
so that an edit inside a paragraph changes few pieces. Texts of every length are
cut alike, so short and long ones can be compared. Equal roots mean
equal texts; where roots differ, equal branches are skipped and the differing
ones locate the edits.

A fingerprint is the tree as text: ``root;pieces;sketch;section/section/...``. A
section is ``hash.paragraph.paragraph...``, eight hex digits each. The pieces
themselves are known by their number and a sketch, the least ``SKETCH`` of their
hashes: at most 2 KB whatever the length of the text, and a text with fewer different pieces
is known by all of them. The least hashes of two sketches together are an even sample of
all pieces of both, so the share that both have tells how like the texts are, with a standard
error of 0.03 at most.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST, by_batch, order_id, ship_package, shuffle_partitions

PIECE_MASK = np.uint32(3)  # a piece ends at one position in 4,
LONGEST = 128  # and at the latest after so many bytes
CONTEXT = 12  # bytes of its paragraph up to its end that tell a shorter piece from others
SECTION_MASK = 3  # a section ends at one paragraph in 4
SKETCH = 256  # least hashes of pieces that a fingerprint keeps
_MULTIPLIER = 0x9E3779B1


def _piece_ends(data: bytes) -> list[int]:
    """Ends of pieces: behind newlines, where the hash of the last 8 bytes says so, and in runs without either."""
    values = np.frombuffer(data, np.uint8)
    size = len(values)
    ends = np.zeros(size + 1, bool)
    ends[np.flatnonzero(values == 10) + 1] = True
    if size > 8:
        rolled = values.astype(np.uint32) + np.uint32(1)
        step, factor = 1, _MULTIPLIER
        while step < 8:
            rolled = rolled[:-step] * np.uint32(factor) + rolled[step:]
            step, factor = 2 * step, factor * factor & 0xFFFFFFFF
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x85EBCA6B)
        rolled >>= np.uint32(13)
        ends[8:] |= rolled & PIECE_MASK == 0
    found = np.flatnonzero(ends[:size])
    borders = np.concatenate(([0], found, [size]))
    for i in np.flatnonzero(np.diff(borders) > LONGEST).tolist():
        ends[borders[i] + LONGEST:borders[i + 1]:LONGEST] = True
    return np.flatnonzero(ends[:size]).tolist()


def _sketch(pieces: list[int]) -> np.ndarray:
    """The least of the pieces' hashes, in order, each once."""
    hashes = np.array(pieces, np.uint32)
    hashes ^= hashes >> np.uint32(16)
    hashes *= np.uint32(0x7FEB352D)
    hashes ^= hashes >> np.uint32(15)
    hashes *= np.uint32(0x846CA68B)
    return np.unique(hashes ^ hashes >> np.uint32(16))[:SKETCH]


class Tree:
    """The tree of one text: its root, its sections (hash, hashes of paragraphs), and the number and sketch of its pieces."""

    def __init__(self, root: str, size: int, sketch: np.ndarray, sections: list):
        self.root, self.size, self.sketch, self.sections = root, size, sketch, sections

    @classmethod
    def of(cls, text: str) -> Tree:
        data = text.encode()
        sections, paragraphs, pieces = [], [], []
        top, section_hash = hashlib.blake2b(digest_size=16), hashlib.blake2b(digest_size=16)
        start = begin = 0
        for end in [*_piece_ends(data), len(data)] if data else ():
            pieces.append(crc32(data[max(begin, min(start, end - CONTEXT)):end]))
            start = end
            if data[end - 1] == 10 or end == len(data):
                digest = hashlib.blake2b(data[begin:end], digest_size=16).digest()
                paragraphs.append(digest[:4].hex())
                section_hash.update(digest)
                begin = end
                if digest[4] & SECTION_MASK == 0 or end == len(data):
                    digest = section_hash.digest()
                    top.update(digest)
                    sections.append((digest[:4].hex(), paragraphs))
                    paragraphs, section_hash = [], hashlib.blake2b(digest_size=16)
        return cls(top.hexdigest(), len(pieces), _sketch(pieces), sections)

    @classmethod
    def parse(cls, fingerprint: str) -> Tree:
        root, size, sketch, rest = fingerprint.split(";")
        names = (part.split(".") for part in rest.split("/")) if rest else ()
        return cls(root, int(size), np.frombuffer(bytes.fromhex(sketch), ">u4").astype(np.uint32),
                   [(name, below) for name, *below in names])

    def fingerprint(self) -> str:
        return ";".join((self.root, str(self.size), self.sketch.astype(">u4").tobytes().hex(),
                         "/".join(".".join((name, *below)) for name, below in self.sections)))


def likeness(left: Tree, right: Tree) -> float:
    """1 for equal roots alone, else twice the shared pieces by all pieces, as far as the sketches tell."""
    if left.root == right.root:
        return 1.0
    both = np.union1d(left.sketch, right.sketch)
    if max(len(left.sketch), len(right.sketch)) == SKETCH:
        both = both[:SKETCH]
    if not len(left.sketch) or not len(right.sketch):
        return 0.0
    shared = np.isin(both, left.sketch, assume_unique=True) & np.isin(both, right.sketch, assume_unique=True)
    share = float(shared.sum()) / len(both)
    return min(2 * share / (1 + share), 1 - 1 / (left.size + right.size + 1))


def edited_paragraphs(before: str, after: str) -> list[int]:
    """Numbers of the paragraphs of the second fingerprint that the first does not have."""
    old, new = Tree.parse(before), Tree.parse(after)
    if old.root == new.root:
        return []
    same = Counter(s[0] for s in old.sections)
    known = Counter(p for s in old.sections for p in s[1])
    found, number = [], 0
    for name, paragraphs in new.sections:
        equal = same[name] > 0
        same[name] -= equal
        for digest in paragraphs:
            if not equal and known[digest] <= 0:
                found.append(number)
            known[digest] -= 1
            number += 1
    return found


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row; a null text is an empty one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def convert(batch):
        prints = [Tree.of(t or "").fingerprint() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return by_batch(rows, convert, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(doc_id, text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    """The row of one document, given the one that follows it."""
    cut = len(text) // 3
    edited = text[:len(text) - cut] + following[:cut]
    edited_tree = Tree.of(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree.fingerprint(),
            edited_tree.fingerprint(), likeness(tree, edited_tree), likeness(tree, next_tree))


def _run_of_documents(batches):
    """Rows of one range in order: each document meets the one before it. The row that follows the range
    comes last and only serves the one before it."""
    before, ended = None, False
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = []
            for follows, doc, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                if ended:
                    break
                tree = Tree.of(text)
                if before:
                    rows.append(_compare(*before, text, tree))
                before, ended = (None if doc == FIRST else doc, text, tree), follows
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _ranges(rows: DataFrame, parts: int) -> DataFrame:
    """The rows with ``part``, the number of the range of ids they fall into, larger ids first."""
    quantiles = rows.approxQuantile("place", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    borders = sorted(set(quantiles))  # fewer than ``parts``
    if not borders:
        return rows.withColumn("part", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol="place", outputCol="part")
    return cut.transform(rows).withColumn("part", (F.lit(len(borders)) - F.col("part")).cast("int"))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    The edited text has the last third of the code points replaced by the first
    as many of the next document, by descending id; after the last comes the
    first. ``near_edited`` and ``near_next`` compare with the edited and the
    next text. Rows of equal ids follow each other by text; null ids come last;
    a single row is its own next. Null and empty texts have the root of no
    sections; two of them are alike (1), one and another text are not (0).

    Texts are shuffled once, into ranges of ids, each read in order, holding two
    documents at a time. The first document of a range goes to the range before
    as well. Which one that is, and the borders, come from the ids alone: one row for each range.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = shuffle_partitions(spark)
    # A double holds the order of longs, if not all their digits: ids it cannot tell apart share a range.
    rows = docs.select(order_id(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _ranges(rows.withColumn("place", F.col("doc").cast("double")), parts).drop("place")
    heads = [(r["part"], r["doc"]) for r in rows.groupBy("part").agg(F.max("doc").alias("doc")).orderBy("part").collect()]
    following = spark.createDataFrame([(doc, heads[i - 1][0]) for i, (_, doc) in enumerate(heads)],
                                      "doc long, before int")  # at most ``parts`` rows
    rows = rows.join(F.broadcast(following), "doc", "left")
    places = F.array(F.struct("part", F.lit(False).alias("follows")),
                     F.struct(F.col("before").alias("part"), F.lit(True).alias("follows")))
    rows = rows.select("doc", "text", F.inline(F.filter(places, lambda p: p["part"].isNotNull())))
    ranged = rows.repartitionById(parts, "part").sortWithinPartitions("part", "follows", F.col("doc").desc(), "text")
    return _in_parts(ranged)


def _in_parts(ranged: DataFrame) -> DataFrame:
    """Give the rows of each range to ``_run_of_documents``; a partition may hold several ranges."""

    def run(batches):
        def runs():
            for batch in batches:
                numbers = np.asarray(batch.column(0))
                borders = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
                for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(numbers)]):
                    if b > a:
                        yield int(numbers[a]), batch.slice(a, b - a).select(["follows", "doc", "text"])

        for _, group in groupby(runs(), lambda pair: pair[0]):
            yield from _run_of_documents(batch for _, batch in group)

    return ranged.select("part", "follows", "doc", "text").mapInArrow(run, RESULT)
