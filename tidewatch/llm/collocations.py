"""Phrases of two to four words, mined from a weighted de Bruijn graph.

Each place of a piece gives its longest gram: four words, or what is left of
the piece. Four words are an edge between two overlapping nodes of three, and
only these longest grams are counted and sent. How often a shorter phrase
occurs follows from them: the flow out of its node, plus the pieces that end
there, which are the shortened grams. Grams go to buckets by their first word,
so that all flows of a word are summed in one place; words, pairs and triples
that hold a large share of all places are dealt out by one word more.

Of the frequent edges, those that follow each other without a branch, a start or
an end become one path. What longer phrases say about the shorter ones inside
them is taken from the paths.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import with_place
from ..session import ship_package
from .common import salt_of, salted, shuffle_partitions, written

WORDS = 4
FLUSH_BYTES = 4 << 20  # of text that a task counts at once
BUCKETS_EACH = 4  # for each shuffle partition
HOT_SHARE = 1 / 16384  # of all places; so there are at most 16384 hot phrases of a length
SALTS = 16
_UNKNOWN = "und"
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\x0b\x0c\r\t",
                        string.ascii_lowercase.encode() + b"\n" * 9 + b" ")
_PACKED = "bucket int, lang string, size int, grams binary"
_COUNTED = "lang string, words int, phrase string, total long, complete boolean"
_CODEC = "zstd"
_NOTHING, _BLANK, _LINE = (pa.scalar(end, pa.large_binary()) for end in (b"", b" ", b"\n"))


# ----------------------------------------------------------------------- words
class _Words:
    """The words of folded text in which new lines end pieces and blanks end words."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, dtype=np.uint8)
        cut = (raw == 10) | (raw == 32)
        opens = ~cut
        opens[1:] &= cut[:-1]
        self.starts = np.flatnonzero(opens)
        closes = cut.copy()
        closes[0:1] = False
        closes[1:] &= ~cut[:-1]
        ends = np.flatnonzero(closes)
        if len(ends) < len(self.starts):
            ends = np.append(ends, len(raw))
        lines = np.flatnonzero(raw == 10)
        self.piece = np.searchsorted(lines, self.starts)
        offsets = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.cumsum(ends - self.starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts),
                                      [None, pa.py_buffer(offsets), pa.py_buffer(raw[~cut])])
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)

    def __len__(self) -> int:
        return len(self.codes)

    def after(self, steps: int) -> np.ndarray:
        """Whether the piece has a word so many places on."""
        there = np.zeros(len(self), dtype=bool)
        if len(self) > steps:
            there[:-steps] = self.piece[steps:] == self.piece[:-steps]
        return there

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, self.vocabulary.to_pylist()), dtype=np.uint64, count=len(self.vocabulary))


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its beginning and of its next word."""
    mixed = (before ^ (word + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _flushes(batches: Iterator[pa.RecordBatch], flush_bytes: int) -> Iterator[tuple[_Words, np.ndarray, list[str]]]:
    """(words, language number of each word, languages) for every ``flush_bytes`` of text."""
    held, size = [], 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            for part in _parts(text.as_buffer().to_pybytes().translate(_FOLD), flush_bytes):
                held.append((part, lang))
                size += len(part) + 1
                if size >= flush_bytes:
                    yield _flush(held)
                    held, size = [], 0
    if held:
        yield _flush(held)


def _parts(folded: bytes, most: int) -> Iterator[bytes]:
    """A long text cut between pieces, so that a task holds as much of it as of short ones."""
    start = 0
    while len(folded) - start > most:
        end = folded.rfind(b"\n", start, start + most)
        end = folded.find(b"\n", start + most) if end < 0 else end
        if end < 0:
            break
        yield folded[start:end]
        start = end + 1
    yield folded[start:]


def _flush(held: list[tuple[bytes, str]]) -> tuple[_Words, np.ndarray, list[str]]:
    words = _Words(b"\n".join(part for part, _ in held) + b"\n")
    numbers: dict[str, int] = {}
    of_part = np.array([numbers.setdefault(lang, len(numbers)) for _, lang in held], dtype=np.int64)
    ends = np.cumsum([len(part) + 1 for part, _ in held])
    return words, of_part[np.searchsorted(ends, words.starts, side="right")], list(numbers)


# ---------------------------------------------------------------------- counts
def phrase_counts(docs: DataFrame, min_count: int = 30, text: str = "text", lang: str = "lang",
                  flush_bytes: int = FLUSH_BYTES, hot_share: float = HOT_SHARE) -> DataFrame:
    """(lang, words, phrase, total) of every phrase of one to four words found ``min_count``
    times or more; with ``words`` 0 and an empty phrase, the number of words of a language.
    A task counts ``flush_bytes`` of text at once; both parameters leave the result as it is."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(_UNKNOWN)).alias("lang"),
                        F.col(f"`{text}`").alias("text")).where(F.length("text") > 0)
    buckets = BUCKETS_EACH * shuffle_partitions(spark)
    hot = _hot_phrases(texts, flush_bytes, hot_share)
    packed = texts.mapInArrow(_pack(hot, buckets, flush_bytes), _PACKED)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket", "lang")
    counted = written(dealt.mapInArrow(_sum(min_count), _COUNTED), "phrases")
    parts = counted.where("NOT complete").groupBy("lang", "words", "phrase").agg(F.sum("total").alias("total"))
    return counted.where("complete").drop("complete").unionByName(
        parts.where((F.col("words") == 0) | (F.col("total") >= min_count)))


def _hot_phrases(texts: DataFrame, flush_bytes: int, hot_share: float) -> list[np.ndarray]:
    """Hashes of the words, pairs and triples that hold ``hot_share`` of all places. They
    decide only where grams are summed. At most 1 / hot_share of each reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, language, languages in _flushes(batches, flush_bytes):
            least = max(1, int(len(words) * hot_share / 2))
            own = words.hashes()[words.codes]
            found = [(0, np.zeros(1, dtype=np.uint64), np.array([len(words)]))]
            at = np.arange(len(words))
            prefix = _mixed(_language_hashes(languages)[language], own)
            for level in (1, 2, 3):
                hashes, which, counts = np.unique(prefix, return_inverse=True, return_counts=True)
                heavy = counts >= least
                found.append((level, hashes[heavy], counts[heavy]))
                stays = heavy[which] & words.after(level)[at]
                at, prefix = at[stays], prefix[stays]
                prefix = _mixed(prefix, own[at + level])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(len(h), level, dtype=np.int32) for level, h, _ in found])),
                pa.array(np.concatenate([h for _, h, _ in found]).view(np.int64)),
                pa.array(np.concatenate([c for _, _, c in found]).astype(np.int64))], names=["level", "hash", "n"])

    sums = written(texts.mapInArrow(count, "level int, hash long, n long").groupBy("level", "hash")
                   .agg(F.sum("n").alias("n")), "heavy")
    total = sums.where("level = 0").agg(F.sum("n")).first()[0] or 0
    hot = sums.where((F.col("level") > 0) & (F.col("n") >= total * hot_share)).select("level", "hash").toArrow()
    levels, hashes = hot.column(0).to_numpy(), hot.column(1).to_numpy().view(np.uint64)
    return [np.sort(hashes[levels == level]) for level in (1, 2, 3)]


def _language_hashes(languages: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(name.encode()) for name in languages], dtype=np.uint64)


def _among(values: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(values), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values


def _pack(hot: list[np.ndarray], buckets: int, flush_bytes: int):
    """Counts the longest gram of every place and packs the grams by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(_CODEC, compression_level=1)
        for words, language, languages in _flushes(batches, flush_bytes):
            if not len(words):
                continue
            many = len(words.vocabulary) + 1
            there = [words.after(steps) for steps in range(1, WORDS)]
            first = np.unique(language * many + words.codes, return_inverse=True)[1]
            second = np.append(words.codes[1:] + 1, 0) * there[0]
            pairs, pair = np.unique(first * many + second, return_inverse=True)
            rest = np.append(pair[2:] + 1, [0, 0])[:len(pair)] * there[1]
            _, at, counts = np.unique(pair * (len(pairs) + 1) + rest, return_index=True, return_counts=True)

            own = words.hashes()
            there = [np.ones(len(at), dtype=bool), *(t[at] for t in there)]
            # A missing word is a word of its own here, after the last of the vocabulary.
            codes = [np.where(t, words.codes[np.minimum(at + step, len(words) - 1)], len(own))
                     for step, t in enumerate(there)]
            own = np.append(own, np.uint64(0))
            prefix = _mixed(_language_hashes(languages)[language[at]], own[codes[0]])
            level = np.zeros(len(at), dtype=np.uint8)
            for step in range(1, WORDS):
                deeper = np.flatnonzero(level == step - 1)
                deeper = deeper[_among(prefix[deeper], hot[step - 1])]
                level[deeper] = step
                prefix[deeper] = _mixed(prefix[deeper], own[codes[step][deeper]])
            bucket = (prefix % np.uint64(buckets)).astype(np.int64)
            group = bucket * len(languages) + language[at]
            order = np.argsort(group, kind="stable")
            group, level, counts = group[order], level[order], counts[order].astype(np.int64)
            columns = [words.vocabulary.take(pa.array(c[order], mask=c[order] == len(own) - 1)) for c in codes]
            grams = pc.binary_join_element_wise(*columns, _BLANK, null_handling="skip")
            grams = pc.binary_join_element_wise(grams, _NOTHING, _LINE)
            if isinstance(grams, pa.ChunkedArray):
                grams = grams.combine_chunks()
            ends = np.frombuffer(grams.buffers()[1], dtype=np.int64)[grams.offset:grams.offset + len(grams) + 1]
            text = memoryview(grams.buffers()[2])
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            out: tuple[list, ...] = ([], [], [], [])
            for start, end in zip(starts, [*starts[1:], len(group)]):
                body = b"".join((np.int64(end - start).tobytes(), counts[start:end].tobytes(), level[start:end].tobytes(),
                                 text[ends[start]:ends[end]]))
                for column, value in zip(out, (int(group[start] // len(languages)), languages[group[start] % len(languages)],
                                               len(body), codec.compress(body, asbytes=True))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()),
                                              pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())],
                                             names=["bucket", "lang", "size", "grams"])
    return run


def _sum(min_count: int):
    """Sums the grams of each bucket and language, and derives the shorter phrases from them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(_CODEC)
        key, held = None, []
        for batch in batches:
            columns = (batch.column(c) for c in ("bucket", "lang", "size", "grams"))
            for bucket, lang, size, grams in zip(*columns):
                if (bucket.as_py(), lang.as_py()) != key:
                    if held:
                        yield _flows(key[1], held, min_count)
                    key, held = (bucket.as_py(), lang.as_py()), []
                held.append(codec.decompress(grams.as_buffer(), size.as_py(), asbytes=True))
        if held:
            yield _flows(key[1], held, min_count)
    return run


def _flows(lang: str, bodies: list[bytes], min_count: int) -> pa.RecordBatch:
    counts, levels, texts = [], [], []
    for body in bodies:
        n = int(np.frombuffer(body, dtype=np.int64, count=1)[0])
        counts.append(np.frombuffer(body, dtype=np.int64, count=n, offset=8))
        levels.append(np.frombuffer(body, dtype=np.uint8, count=n, offset=8 + 8 * n))
        texts.append(memoryview(body)[8 + 9 * n:])
    count, level = np.concatenate(counts), np.concatenate(levels)
    words = _Words(b"".join(texts))
    first = np.flatnonzero(np.append(True, words.piece[1:] != words.piece[:-1]))
    length = np.diff(np.append(first, len(words)))
    many = len(words.vocabulary) + 1
    out = [(0, np.zeros(1, dtype=np.int64), count.sum(keepdims=True), np.zeros(1, dtype=bool))]
    at, node = np.arange(len(first)), np.zeros(len(first), dtype=np.int64)
    for order in range(1, WORDS + 1):
        # Grams with fewer words are the pieces that end: they count for shorter phrases alone.
        longer = length[at] >= order
        at, node = at[longer], node[longer]
        _, some, node = np.unique(node * many + words.codes[first[at] + order - 1], return_index=True, return_inverse=True)
        total = np.bincount(node, weights=count[at]).astype(np.int64)
        # All grams that begin alike have the same level up to their own length.
        complete = level[at[some]] < order
        stays = ~complete | (total >= min_count)
        out.append((order, first[at[some[stays]]], total[stays], complete[stays]))
    phrases = []
    for order, where, _, _ in out:
        columns = [words.vocabulary.take(pa.array(words.codes[where + step])) for step in range(order)]
        phrases.append(pc.binary_join_element_wise(*columns, _BLANK) if order
                       else pa.array([b""] * len(where), pa.large_binary()))
    phrase = pa.concat_arrays([p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p for p in phrases])
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(phrase), pa.string()),
        pa.array(np.concatenate([np.full(len(where), order, dtype=np.int32) for order, where, _, _ in out])),
        phrase.cast(pa.binary()).cast(pa.string()), pa.array(np.concatenate([total for _, _, total, _ in out])),
        pa.array(np.concatenate([complete for _, _, _, complete in out]))],
        names=["lang", "words", "phrase", "total", "complete"])


# ----------------------------------------------------------------------- graph
def _sorted(side: DataFrame) -> DataFrame:
    """A side that grows with the input, to be joined by sorting. Spark sizes it by the compressed files below it, whatever was
    exploded since, and would send the driver a broadcast many times the size that it allows for one."""
    return side.hint("merge")


def unary_paths(counts: DataFrame) -> DataFrame:
    """(lang, phrase, total): the frequent edges of the graph, those that can only follow each
    other joined to one path. Every phrase of four words in a path occurs ``total`` times.

    An edge leads on to the next if it brings all that reaches the node between
    them and the next takes all that leaves it. Paths have no cycles, for every
    piece begins somewhere; their order is found by doubling steps.
    """
    edges = counts.where(F.col("words") == WORDS).select("lang", "phrase", "total")
    nodes = counts.where(F.col("words") == WORDS - 1).select("lang", F.col("phrase").alias("node"), "total")
    into = edges.select("lang", F.substring_index("phrase", " ", 1 - WORDS).alias("node"), "total",
                        F.col("phrase").alias("edge"))
    out_of = edges.select("lang", F.substring_index("phrase", " ", WORDS - 1).alias("node"), "total",
                          F.col("phrase").alias("next"))
    key = ["lang", "node", "total"]
    links = into.join(_sorted(nodes), key).join(_sorted(out_of), key).select("lang", F.col("next").alias("edge"), F.col("edge").alias("at"))
    steps = edges.select("lang", F.col("phrase").alias("edge"), "total").join(_sorted(links), ["lang", "edge"], "left").select(
        "lang", "edge", "total", F.coalesce("at", "edge").alias("at"), F.col("at").isNotNull().cast("long").alias("steps"))
    steps, before = written(steps, "steps"), -1
    while (now := steps.agg(F.sum("steps")).first()[0] or 0) != before:
        before = now
        linked = steps.where("steps > 0")
        onward = steps.select("lang", F.col("edge").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"))
        linked = linked.join(_sorted(onward), ["lang", "at"]).select(
            "lang", "edge", "total", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps"))
        steps = written(steps.where("steps = 0").unionByName(linked), "steps")
    tail = F.struct("steps", F.substring_index("edge", " ", -1).alias("word"))
    return steps.groupBy("lang", "at").agg(
        F.array_sort(F.collect_list(F.when(F.col("steps") > 0, tail))).alias("tail"), F.max("total").alias("total")).select(
        "lang", F.concat_ws(" ", "at", F.transform("tail", lambda t: t["word"])).alias("phrase"), "total")


def _windows(words: Column, size: int) -> Column:
    """All phrases of ``size`` words that lie in an array of words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.concat_ws(
        " ", F.slice(words, i, size)))).otherwise(F.array().cast("array<string>"))


def score_of(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)), exact beyond 64 bits."""
    wide = lambda count: count.cast("decimal(19,0)")
    return F.call_function("div", F.lit(2000000).cast("decimal(7,0)") * wide(a), wide(l) + wide(r)).cast("long")


def collocations(docs: DataFrame, min_count: int = 30, most: int = 2000, text: str = "text", lang: str = "lang",
                 flush_bytes: int = FLUSH_BYTES, hot_share: float = HOT_SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two to four words.

    A-Z are lower-cased; ``.,;:!?`` and line ends cut a text into pieces, blanks and
    tabs a piece into words. A phrase found a >= ``min_count`` times is cut where
    floor(2000000 a / (l + r)) is least (the first such cut), l and r being how often
    its parts occur. It goes if a longer phrase that contains it occurs at least
    0.8 a times. The best ``most`` stay, by score, count and phrase.

    A null language is ``und``; a null or empty text has no pieces; an empty
    table gives no rows. Repeated rows count as often as they stand. A text of any
    length is counted whole.
    """
    counts = written(phrase_counts(docs, min_count, text, lang, flush_bytes, hot_share), "counts")
    candidates = counts.where("words BETWEEN 2 AND 4").select("lang", "phrase", "words", F.col("total").alias("a"))

    words = F.split("phrase", " ")
    paths = unary_paths(counts)
    inside = paths.select("lang", "total", F.explode(F.concat(_windows(words, 2), _windows(words, 3))).alias("phrase"))
    triples = counts.where("words = 3")
    inside = inside.unionByName(triples.select("lang", "total", F.explode(_windows(words, 2)).alias("phrase")))
    longer = inside.groupBy("lang", "phrase").agg(F.max("total").alias("longer"))
    eighty, hundred = (F.lit(n).cast("decimal(3,0)") for n in (80, 100))
    lone = candidates.join(_sorted(longer), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (hundred * F.col("longer").cast("decimal(19,0)") < eighty * F.col("a").cast("decimal(19,0)")))

    # A common word is part of many candidates, so parts are looked up by salt.
    parts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array(F.concat_ws(" ", F.slice(words, 1, k)),
                              F.concat_ws(" ", F.slice(words, k + 1, F.col("words") - k))).alias("parts")))
    cuts = lone.select("lang", "phrase", "a", F.explode(parts).alias("cut")).select(
        "lang", "phrase", "a", "cut.k", F.posexplode("cut.parts").alias("side", "part"))
    cuts = cuts.withColumn("salt", salt_of(F.col("phrase"), SALTS))
    known = salted(counts.where("words BETWEEN 1 AND 3").select("lang", F.col("phrase").alias("part"), "total"), SALTS)
    scored = cuts.join(_sorted(known), ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("total"))).alias("l"),
        F.max(F.when(F.col("side") == 1, F.col("total"))).alias("r"))
    best = scored.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # A score is at most a million; only the scores that can be among the best are put in order, each by itself.
    best = with_place(written(best, "scores"), ["lang"], 1_000_000 - F.col("score"), 250,
                      [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank", last=most)
    totals = counts.where("words = 0").select("lang", F.col("total").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
