"""Sharding, hard negatives and collocations against plain versions of themselves."""
import collections
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import collocations, hard_negatives, sharding
from tidewatch.session import work_dir

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()),
                     # Names that the operators use inside.
                     T.StructField("row", T.StringType()), T.StructField("size", T.StringType()),
                     T.StructField("bucket", T.LongType()), T.StructField("phrase", T.StringType()),
                     T.StructField("n.words", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "r", "s", 3, None, 1) for d, t, lang in rows], DOCS)


def stored(rows):
    """Read from files, so that rows keep their order from one run to the next."""
    path = work_dir(rows.sparkSession, "stored")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


# -------------------------------------------------------------------- sharding
@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, "w" * rng.randrange(60), "en") for i in range(700)]
    rows += [(None, "the same", None)] * 250 + [(7, None, "en"), (7, None, "en"), (800, "", "en"), (801, "é" * 50_000, "en"),
                                                (802, "long " * 200_000, "en")]
    return stored(frame(spark, rows).repartition(4))


@pytest.mark.parametrize("bucket_bytes", [500, 1 << 30])
def test_every_row_has_a_place_of_its_own(docs, bucket_bytes):
    found = sharding.shuffled(docs, shards=7, bucket_bytes=bucket_bytes).collect()
    sizes = collections.Counter((r.row.doc_id, len((r.row.text or "").encode()) + 1) for r in found)
    assert sizes == collections.Counter((r.row.doc_id, r.size) for r in found)
    assert sizes == collections.Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect())
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    counts = [len(s) for s in slots.values()]
    assert set(slots) == set(range(7)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert (len({r.bucket for r in found}) > 50) == (bucket_bytes == 500)


def test_order_is_random_and_follows_the_seed(docs):
    def order(seed):
        rows = sharding.shuffled(docs, shards=1, seed=seed, bucket_bytes=4000).where("row.doc_id < 700").collect()
        return [r.row.doc_id for r in sorted(rows, key=lambda r: r.slot)]

    first, other = order(1), order(2)
    assert first == order(1) and first != other
    for found in (first, other):
        assert abs(np.corrcoef(np.arange(len(found)), found)[0, 1]) < 0.15
        # Neighbours by id are no neighbours in the line.
        assert sum(abs(a - b) <= 2 for a, b in zip(found, found[1:])) < 20


def test_places_inside_a_bucket_are_even(spark):
    """Each of ten rows is first in about a tenth of many buckets' orders."""
    rows = stored(frame(spark, [(i, "x" * 99, "en") for i in range(10)]).coalesce(1))
    firsts = collections.Counter()
    for seed in range(40):
        firsts.update(r.row.doc_id for r in sharding.shuffled(rows, shards=10, seed=seed).where("slot = 0 AND shard < 5")
                      .collect())
    assert sum(firsts.values()) == 200 and set(firsts) == set(range(10))
    assert sum((firsts[i] - 20) ** 2 / 20 for i in range(10)) < 30


def test_sharding_is_native(docs):
    text = plan(sharding.shuffled(docs))
    assert not re.search("Python|Arrow|Pandas", text) and "SortMergeJoin" not in text


def test_shards_are_written_whole(spark, docs):
    path = work_dir(spark, "shards")
    sharding.write_shards(docs, path, shards=3, bucket_bytes=2000)
    found = spark.read.parquet(path)
    assert found.select("row.*").columns == docs.columns
    assert found.count() == docs.count() and found.select("shard", "slot").distinct().count() == docs.count()


def test_sharding_an_empty_table(spark):
    assert sharding.shuffled(frame(spark, [])).collect() == []


# -------------------------------------------------------------- hard negatives
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("cell", T.StringType()),
                        T.StructField("row", T.StringType()), T.StructField("window", T.DoubleType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "c", "r", 0.5)
                                  for i, v, label in rows], VECTORS)


def brute_negatives(rows, step=10, positives=5, negatives=10):
    taking = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            taking.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    found = []
    rank = lambda pair: (-pair[0], -(2**63) if pair[1] is None else pair[1])
    for at, (anchor, vector, label) in enumerate(taking):
        if anchor is None or anchor % step:
            continue
        scores = [(sum(x * y for x, y in zip(vector, other)), i, same == label)
                  for place, (i, other, same) in enumerate(taking) if place != at]
        own = sorted((s for s in scores if s[2]), key=rank)[:positives]
        for best, positive, _ in own:
            others = sorted((s for s in scores if not s[2] and 30 * best <= 100 * s[0] <= 90 * best), key=rank)
            found += [(anchor, positive, n, i, best, score) for n, (score, i, _) in enumerate(others[:negatives], 1)]
    return found


def mined(rows, step=10):
    found = hard_negatives.mine(rows, F.col("vec_id") % step == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=repr)


def some_vectors(rng, n, size=6):
    centers = rng.normal(size=(5, size))
    made = [(i, centers[i % 5] + 0.4 * rng.normal(size=size), int(rng.integers(0, 4))) for i in range(n)]
    made += [(n + i, centers[0], 1) for i in range(40)]  # equal vectors: ties by id
    made += [(2 * n + i, [0.0] * size, 2) for i in range(3)]
    made += [(5000, None, 1), (5010, [1.0, None] + [0.0] * (size - 2), 1), (5020, [math.nan] * size, 1),
             (5030, [math.inf] + [0.0] * (size - 1), 2), (5040, centers[1], None), (5050, [], 3), (5060, centers[2][:3], 3),
             (None, centers[3], 3), (6000, centers[3], 3), (6000, centers[4], 2)]
    return made


@pytest.mark.parametrize("block,probe,cell", [(4096, 4096, 512), (16, 8, 4)])
def test_hard_negatives(spark, monkeypatch, block, probe, cell):
    for name, value in (("BLOCK_ROWS", block), ("PROBE_ROWS", probe), ("CELL_ROWS", cell)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some_vectors(np.random.default_rng(8), 240)
    want = brute_negatives(rows)
    assert len(want) > 500
    assert mined(vectors(spark, rows).repartition(3)) == sorted(want, key=repr)


def test_searches_stop_at_certified_windows(spark, monkeypatch):
    """Far groups of vectors: a search leaves out most cells, and finds the same."""
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 4)
    rng = np.random.default_rng(4)
    centers = 3 * rng.normal(size=(12, 8))
    rows = [(i, centers[i % 12] + 0.05 * rng.normal(size=8), i % 5 % 3) for i in range(600)]
    made = vectors(spark, rows)
    index = hard_negatives._Index(hard_negatives._vectors(made, F.col("vec_id") % 10 == 0, 256, "vec_id", "embedding", "label"))
    everything = F.array(F.struct(F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")))
    queries = index.rows.where("anchor").select(F.col("row").alias("query"), "label", "vector", everything.alias("windows"))
    floors = index.search(queries, True, 5).where("rank = 5").select("query", F.col("score").cast("double").alias("low"))
    narrow = queries.drop("windows").join(floors, "query").select("query", "label", "vector", F.array(F.struct(
        "low", F.lit(math.inf).alias("high"))).alias("windows"))
    routed = narrow.mapInArrow(index._route(True, None), hard_negatives._ROUTED).select("row", F.explode("cells").alias("cell"))
    visited = routed.distinct().groupBy("row").count().agg(F.avg("count")).first()[0]
    assert visited < 0.4 * (index.counts > 0).sum()
    assert mined(made) == sorted(brute_negatives(rows), key=repr)


def test_cells_are_met_in_the_order_of_their_bounds(spark):
    rows = some_vectors(np.random.default_rng(2), 100)
    index = hard_negatives._Index(hard_negatives._vectors(vectors(spark, rows), F.lit(True), 256, "vec_id", "embedding", "label"))
    assert index.counts.sum() == index.rows.count() and index.blocks.groupBy("block").count().agg(F.max("count")).first()[0] <= 4096


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 3)], [(10, [1.0], 0)], [(10, None, 0)], [(10, [], 0), (20, [], 1), (30, [], 0)]])
def test_few_vectors(spark, rows):
    assert mined(vectors(spark, rows)) == sorted(brute_negatives(rows), key=repr)


def test_components_beyond_exact_scores_are_an_error(spark):
    with pytest.raises(ValueError):
        mined(vectors(spark, [(10, [3e6] * 4, 0), (20, [1.0] * 4, 1)]))


# ---------------------------------------------------------------- collocations
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_counts(rows, most=4):
    counts, places = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            places[lang] += len(words)
            counts.update((lang, tuple(words[i:i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    return counts, places


def brute_collocations(rows, least, most):
    counts, places = brute_counts(rows)
    found = collections.defaultdict(list)
    for (lang, gram), a in counts.items():
        if len(gram) < 2 or a < least:
            continue
        longer = [f for (other, big), f in counts.items() if other == lang and len(big) > len(gram)
                  and any(big[i:i + len(gram)] == gram for i in range(len(big) - len(gram) + 1))]
        if any(100 * f >= 80 * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(gram)):
            left, right = counts[lang, gram[:k]], counts[lang, gram[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(gram).encode(), left, right))
    return sorted((lang, rank, phrase.decode(), -a, left, right, places[lang], -score) for lang, best in found.items()
                  for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:most], 1))


def some_texts():
    rng = random.Random(6)
    words = ["the", "of", "The", "sea", "Lamp", "été", "x1", "a-b", "quay", "\x00odd", "lin", "ß"]
    passage = "one two three four five six seven eight nine ten"
    rows = []
    for i in range(150):
        text = " ".join(rng.choices(words, [9, 6, 2, 1, 1, 1, 1, 1, 1, 0.3, 1, 1], k=rng.randrange(0, 60)))
        text = "".join(c if c != " " or rng.random() > 0.1 else rng.choice([", ", ".", "\n", "\t", "  ", "\r\n", " ; "]) for c in text)
        rows.append((i, text + rng.choice(["", ". " + passage, " " + passage + "!", "\n" + passage + " and on"]),
                     rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, None, "en"), (500, "", "fr"), (501, " .,;\n\t", "it"), (502, "alone", "es"), (503, passage, "en"),
                   (503, passage, "en"), (504, "of the " * 4000, "en"), (505, "of the sea. " * 900, "de")]


@pytest.mark.parametrize("flush_bytes,hot_share", [(1 << 24, 1 / 16384), (700, 0.02), (3000, 1.0)])
def test_phrase_counts(spark, flush_bytes, hot_share):
    rows = some_texts()
    counts, places = brute_counts(rows)
    want = {(lang, len(gram), " ".join(gram), n) for (lang, gram), n in counts.items() if n >= 5}
    want |= {(lang, 0, "", n) for lang, n in places.items() if n}
    found = collocations.phrase_counts(frame(spark, rows).repartition(3), 5, flush_bytes=flush_bytes, hot_share=hot_share)
    got = [tuple(r) for r in found.select("lang", "words", "phrase", "total").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_collocations(spark):
    rows = some_texts()
    found = collocations.collocations(frame(spark, rows).repartition(3), 8, 40, flush_bytes=2000, hot_share=0.05)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, 8, 40)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 60


def test_no_side_that_grows_is_broadcast(spark, monkeypatch):
    """Not even where all files are smaller than the size up to which Spark broadcasts: each phrase is exploded by salt."""
    plans = {}

    def noted(rows, label, *more):
        plans.setdefault(label, []).append(rows._jdf.queryExecution().executedPlan().toString())
        return written(rows, label, *more)

    written = collocations.written
    monkeypatch.setattr(collocations, "written", noted)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "1g")
    try:
        assert collocations.collocations(frame(spark, some_texts()), 4, 30).count() > 0
    finally:
        spark.conf.set(setting, was)
    assert {"steps", "scores"} <= set(plans)
    assert all("Join" in p and "Broadcast" not in p for p in [*plans["steps"], *plans["scores"]])


def test_paths_join_edges_without_branch_or_end(spark):
    line = "a b c d e f g"
    texts = [line] * 6 + ["z " + line + " y"] * 2 + ["p q r s t u v w x"] * 3 + ["s t u v k"] * 3 + ["r s t u"] * 2
    counts = collocations.phrase_counts(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), 2).cache()
    found = {(r.phrase, r.total) for r in collocations.unary_paths(counts).collect()}
    # Pieces begin and end at the ends of the line; at "s t u" pieces join, after "t u v" they part.
    assert {(line, 8), ("z a b c", 2), ("e f g y", 2), ("p q r s t", 3), ("r s t u", 5), ("s t u v", 6), ("t u v k", 3),
            ("t u v w x", 3)} <= found
    edges = {tuple(p.split()[i:i + 4]) for p, _ in found for i in range(len(p.split()) - 3)}
    assert edges == {tuple(r.phrase.split()) for r in counts.where("words = 4").collect()}


def test_numbers_past_64_bits(spark):
    """Scores of counts whose product with 2000000 does not fit into a long."""
    huge = 9_000_000_000_000
    row = spark.createDataFrame([(huge, huge + 5, huge + 7)], "a long, l long, r long")
    score = collocations.score_of(F.col("a"), F.col("l"), F.col("r"))
    assert row.select(score).first()[0] == 2000000 * huge // (2 * huge + 12)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "word", "en")], [(1, "a b " * 50_000, "en"), (2, "c. " * 300_000, None)]])
def test_collocations_of_little_and_much(spark, rows):
    found = collocations.collocations(frame(spark, rows))
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, 30, 2000)
