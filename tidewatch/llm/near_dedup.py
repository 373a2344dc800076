"""Near-duplicate documents by circulant MinHash.

One permutation scatters the hashed shingles over a ring of 2^32 places; a
second one, applied after turning the ring by k, gives coordinate k of every
signature. Coordinates are banded; documents that share a band are candidates,
and every link is confirmed on the full shingle sets.

Documents of equal sets count as one. In a bucket all members are compared with
the first one (its leader), so candidates grow with the members and not with
their pairs. Where a leader's members then fall into several components, those
outside the largest are compared with all members, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, by_batch, join_hot, keyed_texts, plain_id, salt_of, salted, ship_package, written
from .components import components

BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6
BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # members of one side of a comparison, and about how many shingles they have
SALTS = 32
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, 256, np.uint64)
_STRIDE = 1 << 16  # bytes hashed at a time
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _ring(base: int) -> np.ndarray:
    out = np.empty(_STRIDE, np.uint64)
    value = 1
    for i in range(_STRIDE):
        out[i] = value
        value = value * base & MASK64
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run without ASCII white space)."""
    global _powers
    if _powers is None:
        _powers = _ring(_BASE), _ring(_INVERSE)
    found = []
    at = 0
    while at < len(data):
        end = min(len(data), at + _STRIDE)
        if end < len(data) and not _WHITE[data[end]]:  # not inside a word, unless the word is longer than a stride
            cut = max(data.rfind(w, at, end) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                stop = min((i for i in (data.find(w, end) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0),
                           default=len(data))
                # One long word, perhaps: hashed by itself.
                for word in data[at:stop].split():
                    digest = hashlib.blake2b(word, digest_size=8).digest()
                    found.append(np.frombuffer(digest, np.uint64))
                at = stop
                continue
            end = cut + 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate(([False], ~_WHITE[part], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[part] * _powers[0][:len(part)])))
            words = (sums[ends] - sums[starts]) * _powers[1][starts]
            found.append(mix64(words + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of lower-cased words; of the whole sequence if it is shorter."""
    hashes = word_hashes(text.encode().translate(LOWER))
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        total = mix64(total * np.uint64(3) + hashes[i:len(hashes) - size + 1 + i] + np.uint64(i + 1))
    return np.unique(total if size == words else mix64(total + np.uint64(size)))


def _second(x: np.ndarray) -> None:
    """The second permutation of the ring, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: the least of the second permutation over the turned ring."""
    places = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    turns = np.arange(size, dtype=np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(places), 1 << 14):
        part = places[begin:begin + (1 << 14)]
        step = max(1, (1 << 15) // len(part))
        for k in range(0, size, step):
            turned = part[None, :] + turns[k:k + step, None]
            _second(turned)
            np.minimum(out[k:k + step], turned.min(1), out=out[k:k + step])
    return out


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    values = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = mix64(keys * np.uint64(_BASE) + values[:, i])
    return keys.view(np.int64)


def links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Pairs across the two sides with 100 * intersection >= percent * union, less those that earlier ones imply."""
    if not left or not right:
        return []
    owners = np.repeat(np.arange(len(left) + len(right)), [len(s) for _, s in (*left, *right)])
    values = np.concatenate([s for _, s in (*left, *right)])
    order = np.argsort(values, kind="stable")
    owners, values = owners[order], values[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    number = np.cumsum(new) - 1
    on_left = owners < len(left)
    both = (np.bincount(number, on_left) > 0) & (np.bincount(number, ~on_left) > 0)
    index = np.cumsum(both) - 1
    use = both[number]
    owners, number, on_left = owners[use], index[number[use]], on_left[use]
    shared = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for begin in range(0, int(both.sum()), step):
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        here = slice(*np.searchsorted(number, [begin, begin + step]))
        owner, column, of_left = owners[here], number[here] - begin, on_left[here]
        a[owner[of_left], column[of_left]] = 1
        b[owner[~of_left] - len(left), column[~of_left]] = 1
        shared += a @ b.T
    sizes = np.array([len(s) for _, s in left])[:, None] + np.array([len(s) for _, s in right])[None, :]
    shared = np.rint(shared).astype(np.int64)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in np.argwhere(100 * shared >= percent * (sizes - shared)).tolist():
        a, b = left[i][0], right[j][0]
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            found.append((a, b))
    return found


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sides of each task (leader, query, data); rows are (task columns, side, node, shingles)."""
    task = ["leader", "query", "data"]

    def run(batches):
        key, sides = None, ([], [])
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    found += links(*sides, percent)
                    key, sides = row[:3], ([], [])
                sides[row[3]].append((row[4], np.frombuffer(row[5], np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] or
                                             [pa.array([], pa.int64())] * 2, schema=_EDGES)
        found = links(*sides, percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_EDGES)

    ordered = rows.select(*task, "side", "node", "shingles").repartition(*task).sortWithinPartitions(*task, "side")
    return ordered.mapInArrow(run, "a long, b long")


def _blocks(members, shingles):
    """Into how many blocks so many members are dealt, so that a task holds neither too many nor too long ones."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def group_near_duplicates(docs: DataFrame, shingle_words: int = 4, percent: int = 80, doc_id: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """(doc, text_key, n_shingles, component, is_first) for each row of ``docs``; see ``keyed_texts`` for the first two.

    Documents are linked if their distinct shingles have at least ``percent`` in
    common. ``component`` is the smallest id that links reach, the own id if
    there are none; ``is_first`` marks one row of each component. Texts without a
    word have no shingles and link with nothing, not even with each other. Rows of
    equal ids are documents of their own; a null id comes before all others.
    """
    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, doc_id, text)

    def sign(batch):
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            sizes, digests, keys = [], [], []
            for value in part.column(2):
                shingles = shingle_set(value.as_py(), shingle_words)
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(shingles, digest_size=16).digest() if len(shingles) else None)
                keys.append(band_keys(shingles, BANDS, ROWS) if len(shingles) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), np.concatenate(keys))],
                ["doc", "text_key", "n_shingles", "digest", "keys"])

    signed = by_batch(texts, sign, "doc long, text_key long, n_shingles long, digest binary, keys array<long>")
    signed = written(signed.select(F.monotonically_increasing_id().alias("node"), "*"), "signatures")

    # One node for each set: the first document that has it.
    classes = (signed.where("digest IS NOT NULL").groupBy("digest")
               .agg(F.min(F.struct("doc", "node")).alias("first"), F.count("*").alias("n")))
    nodes = classes.select(F.col("first.node").alias("node"))
    keys = signed.select("node", "n_shingles", "keys").join(nodes, "node").select("node", "n_shingles", F.explode("keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    pairs = (join_hot(keys, leaders.select("key", "leader"), ["key"], "node").where("node <> leader")
             .select("leader", "node", "n_shingles").distinct())
    pairs = written(pairs, "pairs")

    def sets(batch):
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            found = [shingle_set(t.as_py(), shingle_words).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    wanted = pairs.select("node").union(pairs.select("leader")).distinct().join(
        signed.select("node", "doc", "text_key"), "node")
    shingles = by_batch(texts.join(wanted, ["doc", "text_key"]).select("node", "text"), sets, "node long, shingles binary")
    shingles = written(shingles.dropDuplicates(["node"]), "shingles")

    # Each leader against its members.
    sizes = pairs.groupBy("leader").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    asked = join_hot(pairs, sizes, ["leader"], "node").select(
        "leader", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("query"), "node")
    led = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("query"))
    rows = (asked.join(shingles, "node").select("leader", "query", F.lit(0).alias("data"), F.lit(0).alias("side"), "node",
                                                "shingles")
            .union(led.withColumn("node", F.col("leader")).join(shingles, "node")
                   .select("leader", "query", F.lit(0), F.lit(1), "node", "shingles")))
    first_links = written(_compare(rows, percent), "links")

    # Members of one leader that are still apart.
    roots = components(first_links)
    members = pairs.join(roots, "node", "left").select("leader", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    members = written(members, "members")
    parts = members.groupBy("leader", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    apart = (parts.groupBy("leader").agg(F.max(F.struct("n", "root", "size")).alias("most"), F.sum("n").alias("n"),
                                         F.sum("size").alias("size")).where(F.col("n") > F.col("most.n")))
    apart = apart.select("leader", F.col("most.root").alias("main"), _blocks(
        F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("queries"),
        _blocks(F.col("n"), F.col("size")).alias("datas"))
    open_members = join_hot(members, apart, ["leader"], "node")

    def dealt(own, others, side):
        block = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        return (block, other) if side == 0 else (other, block)

    def side_rows(frame, own, others, side):
        query, data = dealt(own, others, side)
        return frame.select("leader", query.alias("query"), data.alias("data"), F.lit(side).alias("side"), "node")

    rows = (side_rows(open_members.where("root <> main"), "queries", "datas", 0)
            .union(side_rows(open_members, "datas", "queries", 1)).join(shingles, "node")
            .select("leader", "query", "data", "side", "node", "shingles"))
    second_links = written(_compare(rows, percent), "links")

    roots = written(components(first_links.union(second_links)), "roots")
    firsts = (roots.join(signed.select("node", "doc"), "node").groupBy("root")
              .agg(F.min(F.struct("doc", "node")).alias("first")))
    # A component may hold a third of all documents.
    found = (roots.withColumn("salt", salt_of(F.col("node"), SALTS)).join(salted(firsts, SALTS), ["root", "salt"])
             .select("node", "first"))
    shared = (classes.where("n > 1").select("digest", "first")
              .join(found.select("node", F.col("first").alias("linked")), F.col("first.node") == F.col("node"), "left")
              .select("digest", F.coalesce("linked", "first").alias("of_class")))
    rows = signed.select("node", "doc", "text_key", "n_shingles", "digest").withColumn("salt", salt_of(F.col("node"), SALTS))
    rows = rows.join(salted(shared, SALTS), ["digest", "salt"], "left").join(found, "node", "left")
    first = F.coalesce("of_class", "first", F.struct("doc", "node"))
    return rows.select("doc", "text_key", "n_shingles", first["doc"].alias("component"),
                       (first["node"] == F.col("node")).alias("is_first"))


def near_duplicates(docs: DataFrame, shingle_words: int = 4, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; kept if the document is its component's smallest id."""
    groups = group_near_duplicates(docs, shingle_words, percent, doc_id, text)
    return groups.select(plain_id("doc").alias("doc_id"), "n_shingles", plain_id("component").alias("component_id"),
                         (F.col("doc") == F.col("component")).alias("kept"))


def keep_first(docs: DataFrame, shingle_words: int = 5, percent: int = 80, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns. A text without a word is a group of its own."""
    groups = group_near_duplicates(docs, shingle_words, percent, doc_id, text)
    kept = written(groups.where("is_first").select("doc", "text_key").distinct(), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.coalesce(F.col("row").getField(doc_id).cast("long"), F.lit(-(2**63))).alias("doc"),
                       F.xxhash64(F.coalesce(F.col("row").getField(text), F.lit(""))).alias("text_key"))
    return (rows.join(kept, ["doc", "text_key"], "left_semi").dropDuplicates(["doc", "text_key"])
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
