"""Each operator against a plain version of itself, and the cases that break things."""
import base64
import collections
import hashlib
import os
import random
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from tidewatch.llm import (bpe, components, html_extract, line_dedup, merkle, near_dedup, packing,  # noqa: E402
                           quality_classifier, quality_rules, suffix_dedup, warc)
from tidewatch.llm.common import written  # noqa: E402
from tidewatch.session import work_dir  # noqa: E402

PATTERN = public_tokenizers.PATTERN
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     # Names that the operators use inside.
                     T.StructField("kept", T.StringType()), T.StructField("node", T.StringType()),
                     T.StructField("row", T.LongType()), T.StructField("salt", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("n.chars", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", None, 7, "s", None, 1) for d, t in rows], DOCS)


def prose(rng, words):
    return " ".join("".join(rng.choice(["ba", "ne", "tor", "lu", "mi", "sha", "k", "é"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(words))


def corpus():
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(1, 60)]
    passage = prose(rng, 60)
    rows += [(100 + i, base) for i in range(12)]
    for i in range(40):  # near copies with up to a fifth of the words changed
        words = base.split()
        for _ in range(rng.randint(1, 25)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)) for i in range(15)]
    rows += [(400, None), (401, ""), (402, " \n\t \n"), (403, "one"), (404, "One"), (405, "a b c"), (406, "A B C"),
             (407, "ab " * 3000), (408, "x" * 9000), (409, "x" * 70000 + " tail"), (410, "x" * 70000 + " tail"),
             (411, "\n".join(["same line of the text here"] * 50)), (412, "é" * 300 + "\n\n" + "é" * 300),
             (None, base), (None, None), (413, passage), (413, passage), (413, "another text of the same id " * 4)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(5).cache()


def empty(spark):
    return frame(spark, [])


# Brute-force versions

def sort_key(doc):
    return -(2**63) if doc is None else doc


def brute_lines(rows, least_docs=3, least_chars=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(sort_key(d))
    goes = {k: max(v) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in goes and sort_key(d) < goes[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def brute_sets(rows, size):
    out = []
    for _, t in rows:
        words = (t or "").encode().translate(near_dedup.LOWER).split()
        out.append(set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)} - {()})
    return out


def brute_groups(rows, size, percent=80):
    sets, parent = brute_sets(rows, size), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


def brute_strings(rows, size=50):
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - size + 1):
            s = data[i:i + size]
            first[s] = min(first.get(s, 2**63), sort_key(d))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if first[data[i:i + size]] < sort_key(d):
                gone[i:i + size] = b"\x01" * size
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


# Line dedup

def test_line_dedup(spark, docs):
    got = line_dedup.drop_repeated_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert ordered(map(tuple, got)) == ordered(brute_lines(corpus()))
    assert line_dedup.drop_repeated_lines(empty(spark)).collect() == []


def test_line_dedup_is_native(docs):
    plan = line_dedup.drop_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_line_keys(spark):
    rows = [(1, "\x0b A line of Twenty signs\t"), (2, "a LINE of twenty signs"), (3, "a line of twenty signs\r\nA"),
            (4, "short"), (5, "short"), (6, "short"), (7, "\u00c9 line of twenty signs x"), (8, "\u00e9 line of twenty signs x"),
            (9, "\u00a0a line of twenty signs")]
    got = line_dedup.drop_repeated_lines(frame(spark, rows)).select("row.doc_id", "n_dropped").collect()
    assert dict(map(tuple, got)) == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0}


# Near-duplicates

def test_near_duplicates(spark, docs):
    rows = corpus()
    sets, roots = brute_groups(rows, 4)
    least = collections.defaultdict(lambda: 2**63)
    for (d, _), r in zip(rows, roots):
        least[r] = min(least[r], sort_key(d))
    want = [(d, len(s), None if least[r] == -(2**63) else least[r], sort_key(d) == least[r])
            for (d, _), s, r in zip(rows, sets, roots)]
    assert ordered(map(tuple, near_dedup.near_duplicates(docs).collect())) == ordered(want)
    assert near_dedup.near_duplicates(empty(spark)).collect() == []


def test_near_duplicate_blocks(spark, monkeypatch):
    """With tiny blocks every group is split, and members apart from their leader's group are compared in the second round."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng, rows = random.Random(8), []
    base = prose(rng, 60).split()
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    _, roots = brute_groups(rows, 4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    first = {}
    for (d, _), r in zip(rows, roots):
        first.setdefault(r, d)
    assert got == {d: first[r] for (d, _), r in zip(rows, roots)}


def test_keep_first(docs):
    rows = corpus()
    _, roots = brute_groups(rows, 5)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(sort_key(r.doc_id) for r in kept.collect())
    least = {}
    for i, ((d, t), r) in enumerate(zip(rows, roots)):
        key = ("none", sort_key(d), t or "") if not (t or "").split() else r
        least[key] = min(least.get(key, 2**63), sort_key(d))
    assert got == sorted(least.values())


def test_hashes_do_not_depend_on_place():
    word = "w" * 65536
    for before in ("", "a ", "a b " * 20000, "x" * 65535 + " "):
        assert near_dedup.word_hashes((before + word + " z").encode())[-2] == near_dedup.word_hashes(word.encode())[0]
    long = "y" * 70000
    assert near_dedup.word_hashes(f"a {long} b".encode())[1] == near_dedup.word_hashes(long.encode())[0]


def test_signature_estimates_likeness():
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 2**63, 400, np.uint64), rng.integers(0, 2**63, 100, np.uint64)
    left = near_dedup.signature(common, 2000)
    right = near_dedup.signature(np.concatenate((common, own)), 2000)
    assert abs((left == right).mean() - 0.8) < 0.04


def test_components(spark):
    rng, edges = random.Random(4), [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# Repeated strings

def brute_digests(rows):
    return ordered((d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute_strings(rows))


def test_repeated_strings(spark, docs):
    assert ordered(map(tuple, suffix_dedup.deduplicated(docs).collect())) == brute_digests(corpus())
    assert suffix_dedup.deduplicated(empty(spark)).collect() == []


@pytest.mark.parametrize("hot", [1, 1000])
def test_repeated_strings_of_hot_triggers(spark, monkeypatch, hot):
    """Few letters make many different phrases of one trigger; a low bound sends them string by string."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SORTED", 100)
    rng = random.Random(6)
    common = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    rows = [(rng.randint(0, 30), "".join(rng.choice(common) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
                                         for _ in range(rng.randint(1, 12)))) for _ in range(50)]
    rows += [(50, "c" * 49), (51, "c" * 50), (52, "c" * 51), (53, "c" * 49)]
    assert ordered(map(tuple, suffix_dedup.deduplicated(frame(spark, rows)).collect())) == brute_digests(rows)


@pytest.mark.parametrize("hot", [1, 1000])
def test_texts_of_short_periods(spark, monkeypatch, hot):
    """Texts of one character or a short word again and again send few phrases, and lose what they should."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(1, "a" * 3000), (2, "a" * 2000 + "b" * 700), (3, "xy" * 900 + "a" * 60), (4, "y" + "xy" * 400 + "end"),
            (5, "abc" * 500), (6, "b" * 700 + "cab" * 100), (7, "a" * 49), (8, "b" * 49 + "a" * 50)]
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicated(frame(spark, rows)).collect()}
    want = {}
    for doc, text in rows:
        gone = set()
        for i in range(len(text) - 49):
            if any(text[i:i + 50] in other for smaller, other in rows if smaller < doc):
                gone.update(range(i, i + 50))
        left = "".join(c for i, c in enumerate(text) if i not in gone)
        want[doc] = (len(gone), hashlib.sha256(left.encode()).hexdigest())
    assert found == want
    parser = suffix_dedup._Parser(4)
    parser.add(1, 1, b"z" * 1_000_000)
    assert sum(len(part) for row in parser.flush() for part in row[2:] if isinstance(part, bytes)) < 200_000


def test_long_texts_are_parsed_in_strides(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRIDE", 256)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 2000)
    rng = random.Random(7)
    long = prose(rng, 400)
    rows = [(3, long), (4, long[100:1500] + prose(rng, 20)), (5, prose(rng, 90) + long[700:760]), (1, long[900:1000])]
    assert ordered(map(tuple, suffix_dedup.deduplicated(frame(spark, rows)).collect())) == brute_digests(rows)


def test_texts_of_one_id_whose_hashes_share_32_bits(spark):
    passage = "The same passage stands in two documents, and one of them says nothing else. "
    one, other = passage + "261846", "Number 155841 is another text, which shares no long string with any other one."
    hashes = spark.createDataFrame([(one,), (other,)], "text string").select(F.xxhash64("text").alias("h")).collect()
    assert (hashes[0].h ^ hashes[1].h) & 0xFFFFFFFF == 0
    rows = [(1, passage), (7, one), (7, other), (None, "short")]
    assert ordered(map(tuple, suffix_dedup.deduplicated(frame(spark, rows)).collect())) == brute_digests(rows)
    got = ordered((r.doc_id, r.text) for r in suffix_dedup.keep_unrepeated(frame(spark, rows)).collect())
    assert got == ordered([(1, passage), (7, "261846"), (7, other), (None, "short")])


def test_rows_of_many_shards_are_small():
    """With more shards than a document has phrases, what says whose a phrase is takes fewer bytes than the phrase's hashes."""
    rng = random.Random(3)
    parser = suffix_dedup._Parser(600)
    for doc in range(400):
        parser.add(doc, rng.getrandbits(63), prose(rng, 300).encode())
    rows = parser.flush()
    phrases = sum(len(r[-1]) for r in rows if r[1] == suffix_dedup.PHRASES) // 10
    assert phrases > 10_000
    assert sum(len(part) for r in rows for part in r[2:] if isinstance(part, bytes)) < 25 * phrases


def test_rows_between_the_steps_come_back():
    """Ids from the least to the largest, hot starts and strings without ends, below and above the size that is compressed."""
    rng = np.random.default_rng(4)
    for n in (1, 3, 500):
        docs = np.sort(rng.choice([-2**63, -5, 0, 7, 2**40, 2**63 - 1], n))
        keys = np.where(docs == 7, np.arange(n) // 3, docs)
        starts = rng.integers(0, 2**31 - 300, n)
        ends = starts + rng.integers(0, 255, n) | np.where(np.arange(n) % 2, 1 << 31, 0)
        h1, h2 = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        for kind in (suffix_dedup.ASKED, suffix_dedup.STRINGS):
            names = ["h1", "h2", *["ends"] * (kind == suffix_dedup.ASKED)]
            row = suffix_dedup._row(0, kind, docs, keys, starts, ends, h1, h2)
            found = suffix_dedup._columns([dict(zip(["shard", "kind", *suffix_dedup.PARTS], row))] * 2, names)
            for name, want in {"docs": docs, "keys": keys, "starts": starts, "h1": h1, "h2": h2, "ends": ends}.items():
                assert name not in names[2:] and name == "ends" or found[name].tolist() == [*want.tolist()] * 2


def test_written_steps_leave_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    rows = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "step")
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:  # they are deleted in the background
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(setting, None) == was
    assert rows.count() == 7


def test_unrepeated_texts_are_shuffled_once(spark, docs):
    """What follows the cutting of the texts shuffles nothing."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = suffix_dedup.keep_unrepeated(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, was)
    assert "ArrowEvalPython" in plan and "Exchange" not in plan.split("ArrowEvalPython")[0]


def test_unrepeated_rows_keep_their_columns(docs):
    got = suffix_dedup.keep_unrepeated(docs)
    assert got.columns == docs.columns
    want = ordered((d, kept.decode("utf-8", "ignore")) for d, _, _, _, kept in brute_strings(corpus()))
    assert ordered((r.doc_id, r.text) for r in got.collect()) == want


# Quality rules

def brute_measures(text):
    data = (text or "").encode()
    words = data.split()
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    at = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(at))


def test_quality_measures(spark):
    rows = [r for r in corpus() if not r[1] or len(r[1]) < 4000] + [(500, "a a a a b a a a"), (501, "#x |y| a\nb\n#x |y| a\n\n\n")]
    got = quality_rules.ledger(frame(spark, rows)).collect()
    assert ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == ordered(
        (d, *brute_measures(t)) for d, t in rows)
    assert quality_rules.ledger(empty(spark)).collect() == []
    assert quality_rules.ablation(quality_rules.ledger(empty(spark))).first().kept_without == 0


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (2, "few words"), (3, good.upper()), (4, "the same " * 40), (5, "%$# few"), (6, None)]
    rows = quality_rules.apply_policy(quality_rules.ledger(frame(spark, rows)))
    assert {r.doc_id: r.kept for r in rows.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    base = quality_rules.apply_policy(rows, "base-1", "by_base")
    assert {r.doc_id for r in base.where("by_base").collect()} == {1, 3}
    found = {r.rule: r for r in quality_rules.ablation(rows).collect()}
    assert (found["capitals"].failed, found["capitals"].failed_alone, found["capitals"].kept_without) == (1, 1, 2)
    assert found["few_words"].failed == 3 and found["symbols"].failed_alone == 0


# Quality classifier

def junk(rng, i):
    words = prose(rng, 60).split()
    return [" ".join(w for w in words[:6] for _ in range(12)), prose(rng, 60).upper().replace(" ", "!! "), " | ".join(words),
            " ".join(w + "%%$" for w in words), "\n".join(["again the same line stands here"] * 20)][i % 5]


def test_classifier_on_held_out_labels(spark):
    rng, rows, labels = random.Random(9), [], {}
    for i in range(400):
        bad = i % 6 == 0
        text = junk(rng, i // 6) if bad else ". ".join(prose(rng, 9) + " the of and" for _ in range(rng.randint(1, 20)))
        rows.append((i, text))
        labels[i] = not bad
    weights = quality_classifier.fit(frame(spark, rows[:300]))
    got = {r.doc_id: r.kept for r in quality_classifier.classify(frame(spark, rows[300:]), weights).collect()}
    assert sum(got[i] == labels[i] for i in got) >= 0.97 * len(got)
    assert all(got[i] for i in got if labels[i])
    kept = quality_classifier.keep_good(frame(spark, rows[300:]), weights)
    assert kept.columns == DOCS.names and {r.doc_id for r in kept.collect()} == {i for i in got if got[i]}


def test_estimates_find_the_wrong_labeller():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    n = len(quality_classifier.LABELLERS)
    seen = np.where(good[:, None], 1, 2) * np.ones((1, n), int)
    flip = rng.random(seen.shape) < np.where(np.arange(n) == 3, 0.4, 0.05)
    seen = np.where(flip, 3 - seen, seen)
    seen[rng.random(seen.shape) < 0.3] = 0
    patterns, counts = np.unique(seen, axis=0, return_counts=True)
    _, tables, share = quality_classifier.estimate(patterns, counts.astype(float))
    right = [(tables[i, 0, 1] + tables[i, 1, 0]) / 2 for i in range(n)]
    assert int(np.argmin(right)) == 3 and abs(share - 0.8) < 0.04


def test_classifier_edges(spark, docs):
    weights = quality_classifier.fit(empty(spark))
    assert quality_classifier.classify(empty(spark), weights).collect() == []
    rows = quality_classifier.classify(docs, quality_classifier.fit(docs)).collect()
    assert len(rows) == len(corpus()) and len({r.score for r in rows if r.doc_id == 413}) == 2


def test_classifier_of_rows_without_ids(spark):
    rng = random.Random(4)
    texts = [junk(rng, i // 6) if i % 6 == 0 else ". ".join(prose(rng, 9) + " the of and" for _ in range(3)) for i in range(12000)]
    for ids in (None, 5):
        weights = quality_classifier.fit(frame(spark, [(ids, t) for t in texts]))
        assert weights.any()
        kept = [quality_classifier.score(weights, t.encode()) >= quality_classifier.KEEP for t in texts[:600]]
        assert sum(k == (i % 6 != 0) for i, k in enumerate(kept)) >= 0.97 * 600
    # Most rows are equal: the others train all the same, in any order.
    rows = [(None, "")] * 2000 + [(None, t) for t in texts[:60]]
    weights = quality_classifier.fit(frame(spark, rows), training_docs=50)
    assert weights.any() and (weights == quality_classifier.fit(frame(spark, rows[::-1]).repartition(7), training_docs=50)).all()


# Byte-level BPE

def test_bpe_against_tiktoken():
    coder = bpe.ByteBPE(MULTI, PATTERN)
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(1)
    letters = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ü", "中文", "日", "🙂", "1", "23", "!", "\x1c", "\x85", "\xa0",
               "'s", "'ll", "ing", "tion", "\x00", "ß", "Жа", "ا", "한국", "\u3000", "\u200b"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, "é" * 2000, " " * 4000, "the" * 1500, "中" * 3000]
    for text in texts:
        ids = coder.encode(text)
        assert ids == other.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_bpe_rows(spark, docs):
    coded = bpe.encode_texts(docs, MULTI, PATTERN)
    assert ordered((r.doc_id, bytes(r.data)) for r in bpe.decode_ids(coded, MULTI, PATTERN).collect()) == ordered(
        (d, (t or "").encode()) for d, t in corpus())
    ids = {(r.doc_id, tuple(r.ids)) for r in coded.collect()}
    want = {(d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for d, i in ids}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.round_trip(docs, MULTI, PATTERN).collect()} == want
    assert bpe.round_trip(empty(spark), MULTI, PATTERN).collect() == []


# Fingerprints

def test_fingerprints(spark, docs):
    rows = sorted(((d, t or "") for d, t in corpus()), key=lambda r: (-sort_key(r[0]), r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 3] + following[:len(t) // 3]
        left, right = merkle.Tree.of(t), merkle.Tree.of(edited)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), left.fingerprint(), right.fingerprint(),
                     merkle.likeness(left, right), merkle.likeness(left, merkle.Tree.of(following))))
    assert ordered(map(tuple, merkle.compare_with_edits(docs).collect())) == ordered(want)
    assert merkle.compare_with_edits(empty(spark)).collect() == []
    one = merkle.compare_with_edits(frame(spark, [(5, "alone in the table")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alone in thealone ").hexdigest()


def test_trees():
    rng = random.Random(2)
    text = "\n".join(prose(rng, 40) for _ in range(30))
    tree = merkle.Tree.of(text)
    parsed = merkle.Tree.parse(tree.fingerprint())
    assert (parsed.root, parsed.size, parsed.sections) == (tree.root, tree.size, tree.sections)
    assert parsed.sketch.tolist() == tree.sketch.tolist()
    lines = text.split("\n")
    lines[11] = lines[11].replace(" ", " changed ", 1)
    edited = merkle.Tree.of("\n".join(lines))
    assert merkle.edited_paragraphs(tree.fingerprint(), edited.fingerprint()) == [11]
    assert 0.95 < merkle.likeness(tree, edited) < 1
    assert merkle.likeness(tree, merkle.Tree.of("new first line\n" + text)) > 0.97
    assert merkle.likeness(tree, merkle.Tree.of(prose(rng, 1000))) < 0.05
    assert len({merkle.Tree.of(t).root for t in ("", "a", "a\n", "\n", "\n\n", "a\na", "aa")}) == 7


@pytest.mark.parametrize("size", [40, 120, 250, 256, 300, 2000])
def test_pieces_do_not_depend_on_the_length_of_the_text(size):
    rng = random.Random(size)
    texts = [prose(rng, size).replace("é", "e")[:size] for _ in range(30)]
    trees = [merkle.Tree.of(t) for t in texts]
    longer = [merkle.likeness(tree, merkle.Tree.of(t + " and more.")) for t, tree in zip(texts, trees)]
    assert sum(longer) / 30 > 1 - 12 / size
    wider = [merkle.likeness(tree, merkle.Tree.of(t[:-size // 10] + "é" * (size // 10))) for t, tree in zip(texts, trees)]
    assert sum(wider) / 30 > 0.6
    assert sum(merkle.likeness(a, b) for a, b in zip(trees, trees[1:])) / 29 < 0.05


def test_fingerprints_of_near_copies_across_256_bytes(spark):
    text = prose(random.Random(8), 90).replace("é", "e")[:250]
    short, long = merkle.compare_with_edits(frame(spark, [(2, text), (1, text + " and more.")])).collect()
    assert short.near_next == long.near_next > 0.9 and min(short.near_edited, long.near_edited) > 0.6


def brute_likeness(left, right):
    """Shared pieces of two texts counted one by one, each different piece once."""
    def pieces(text):
        data, found, begin, start = text.encode(), set(), 0, 0
        for end in [*merkle._piece_ends(data), len(data)]:
            found.add(zlib.crc32(data[max(begin, min(start, end - merkle.CONTEXT)):end]))
            start = end
            begin = end if data[end - 1] == 10 else begin
        return found
    left, right = pieces(left), pieces(right)
    return 2 * len(left & right) / (len(left) + len(right))


@pytest.mark.parametrize("words", [60, 400, 4000, 40_000])
def test_sketches_tell_likeness_at_a_bounded_size(words):
    rng = random.Random(words)
    errors = []
    for part in (0.02, 0.1, 0.3, 0.5, 0.8):
        text = prose(rng, words).split()
        at, n = rng.randrange(len(text)), int(part * len(text))
        changed = text[:]
        changed[at:at + n] = prose(rng, n).split()
        left, right = " ".join(text), " ".join(changed)
        trees = merkle.Tree.of(left), merkle.Tree.of(right)
        errors.append(abs(merkle.likeness(*trees) - brute_likeness(left, right)))
        assert merkle.likeness(*trees) < 1
        assert len(trees[0].fingerprint()) < 32 + 8 * merkle.SKETCH + 60
    assert max(errors) < 0.1 and sum(errors) / 5 < 0.04
    if words == 60:
        assert max(errors) < 0.01  # all pieces are known


def test_fingerprint_of_a_very_long_text(spark):
    """Ten MB of lines, one of which is changed, and many rows without an id."""
    rng = random.Random(1)
    lines = [prose(rng, 12) for _ in range(1000)] * 120
    text = "\n".join(lines)
    lines[70_000] += " changed"
    left, right = merkle.Tree.of(text), merkle.Tree.of("\n".join(lines))
    assert 0.99 < merkle.likeness(left, right) < 1
    assert merkle.edited_paragraphs(left.fingerprint(), right.fingerprint()) == [70_000]
    assert len(left.fingerprint()) < 0.2 * len(text)
    found = merkle.compare_with_edits(frame(spark, [(None, f"text {i % 50}") for i in range(3000)] + [(1, text)])).collect()
    assert len(found) == 3001 and {r.near_next for r in found if r.near_next == 1.0}


# WARC

def page_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, origin long")


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    rng = random.Random(3)
    pages = [(i, f"https://a.example/{i}", prose(rng, rng.choice([3, 40, 900]))) for i in range(40)]
    pages += [(100, None, None), (99, "", ""), (101, "http://x/\r\nWARC-Type: resource", pages[5][2]), (3000, "u", pages[5][2]),
              (102, "http://x", "WARC/1.1\r\n\r\n0\r\n\r\n"), (103, "u", "é\r\n" * 4000), (None, "u", pages[5][2]), (104, "u", "a"), (104, "u", "a")]
    path = work_dir(spark, "warc-test")
    warc.write_archives(page_frame(spark, [(*p, "x", None) for p in pages]).repartition(3), path, segment_bytes=700)
    first = {}
    for number, _, html in pages:
        data = (html or "").encode()
        first[data] = min(first.get(data, 2**63), 2**63 if number is None else number)
    want = []
    for number, _, html in pages:
        data = (html or "").encode()
        again = first[data] != number
        want.append((number, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if again else "response", first[data] if again else None, None if again else data))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)
            if r.payload is not None else None) for r in warc.read_archives(spark, path, payloads=True).collect()]
    got = [(*g[:5], b"" if g[5] is None and g[3] == "response" else g[5]) for g in got]
    assert ordered(got) == ordered(want)


def test_small_payloads_are_not_revisits(spark):
    path = work_dir(spark, "warc-test")
    warc.write_archives(page_frame(spark, [(i, "u", h, None, None) for i, h in enumerate(["ab", "ab", "abc", "abc"])]), path, 3)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, path).collect()} == {
        0: "response", 1: "response", 2: "response", 3: "revisit"}
    path = work_dir(spark, "warc-test")
    warc.write_archives(page_frame(spark, []), path)
    assert warc.read_archives(spark, path).collect() == []


def test_missing_segment_is_an_error(spark):
    records = warc.page_records(0, 1, "u", b"x" * 2000, warc.base32(hashlib.sha1(b"x" * 2000).hexdigest()), None, 500)
    path = work_dir(spark, "warc-test")
    spark.createDataFrame([(r[:-1].decode(),) for i, r in enumerate(records) if i != 2], "value string").write.option(
        "compression", "gzip").option("lineSep", "\n").text(path)
    with pytest.raises(Exception, match="segment 3 is missing"):
        warc.read_archives(spark, path).collect()


def test_segmented_response_without_chunks(spark):
    payload = b"<p>\r\n\r\n" + bytes(range(32, 127)) * 20
    digest = warc.base32(hashlib.sha1(payload).hexdigest())
    block = warc.HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    parts = [block[i:i + 50] for i in range(0, len(block), 50)]  # the head takes two
    records = []
    for i, part in enumerate(parts, 1):
        headers = [("WARC-Type", "continuation" if i > 1 else "response"), ("WARC-Record-ID", f"<urn:page:4:0{f':{i}' * (i > 1)}>"),
                   ("WARC-Target-URI", "u"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Segment-Number", str(i))]
        headers += [("WARC-Segment-Origin-ID", "<urn:page:4:0>")] * (i > 1)
        headers += [("WARC-Segment-Total-Length", str(len(block)))] * (i == len(parts))
        records.append(warc.record(headers, part))
    path = work_dir(spark, "warc-test")
    spark.createDataFrame([(r[:-1].decode(),) for r in records], "value string").write.option(
        "compression", "gzip").option("lineSep", "\n").text(path)
    assert [tuple(r) for r in warc.read_archives(spark, path, payloads=True).collect()] == [
        (4, "u", len(payload), digest, "response", None, payload)]


def test_dechunker_takes_any_parts():
    payload = bytes(range(256)) * 40
    framed = warc.chunked(payload, 300)
    for size in (1, 2, 3, 7, 299, 301, 100000):
        reader = warc.Dechunker()
        assert b"".join(reader.feed(framed[i:i + size]) for i in range(0, len(framed), size)) == payload and reader.done


# HTML

ARTICLE = ("The quick brown fox of the village was seen by the people who live in the house on the hill, and it is said that "
           "they were not afraid of it at all.")


def test_main_text_of_marked_articles():
    page = f"""<html><head><title>No</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- <p>no</p> --><div class="ad">{ARTICLE}</div>
    <article><h1>Title &amp; more</h1><p><b>{ARTICLE}<br><p>One  two\n three&nbsp;four &lt;b&gt; &#233; a<span class="share">no</span>b</p>
    <div class="comments"><p>{ARTICLE}</p></div><aside>{ARTICLE}</aside><form>{ARTICLE}<input value="a>b"></form>
    <p title="x > y">Last.</p></article><footer>&copy; no</footer></body></html>"""
    assert html_extract.main_text(page) == f"Title & more\n{ARTICLE}\nOne two three four <b> é a\nb\nLast."


def test_main_text_without_marks():
    page = (f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div>Short note</div><h2>Heading</h2><div>{ARTICLE}</div>"
            f"<div>Short inside.</div><div>{ARTICLE} {ARTICLE}</div><div>Copyright</div><div><a href=z>{ARTICLE}</a></div></body>")
    assert html_extract.main_text(page) == f"Heading\n{ARTICLE}\nShort inside.\n{ARTICLE} {ARTICLE}"


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>a<b", "</", "<!--", "<script>", "<a href='", "plain", "<p>" * 3000, "<" * 3000,
                                  "&", "&am", "<![CDATA[x", "<p a=\"" + "x" * 5000, "<td><li></p></td>" * 500, "\x00<p>\x00"])
def test_broken_pages_are_read_as_far_as_they_go(page):
    assert isinstance(html_extract.main_text(page), str)


def test_pages(spark):
    rows = [(1, "u", f"<article><p>{ARTICLE}</article>"), (2, None, None), (None, "v", ""), (1, "u", f"<article><p>{ARTICLE}</article>")]
    got = html_extract.extract_main_text(spark.createDataFrame([(*r, "t", 5) for r in rows],
                                                               "page_id long, url string, html string, text string, n_chars int"))
    assert ordered(map(tuple, got.collect())) == ordered([(1, "u", ARTICLE, len(ARTICLE)), (2, None, "", 0), (None, "v", "", 0),
                                                          (1, "u", ARTICLE, len(ARTICLE))])


# Packing

def check_packing(rows, pieces):
    """Every id in one piece, sequences without gaps and never over the window; returns the padding."""
    coder = Tokenizer.from_file(JSON)
    coder.encode_special_tokens = True
    tokens = collections.Counter((d, tuple(coder.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in rows)
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
    for (d, ids), times in tokens.items():
        same = [t for (e, t), n in tokens.items() for _ in range(n) if e == d and len(t) == len(ids)]
        got = sorted(by_doc[d, len(ids)])
        assert sum(len(p) for _, p in got) == len(ids) * len(same)
        if len(same) == 1:
            assert [x for _, p in got for x in p] == list(ids) and [s for s, _ in got] == list(
                np.cumsum([0, *(len(p) for _, p in got[:-1])]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark, docs):
    rows = corpus() + [(600, "word " * 4095), (601, "word " * 4096), (602, "<|endoftext|>")]
    assert check_packing(rows, packing.pack(frame(spark, rows).repartition(3), JSON, PATTERN).collect()) == 0
    assert packing.pack(empty(spark), JSON, PATTERN).collect() == []


def test_plan_places_every_rank():
    rng = random.Random(1)
    for histogram in ({5: 3}, {1024: 7, 512: 4}, {n: rng.randint(1, 40) for n in rng.sample(range(1, 2048), 300)}, {2047: 5, 1: 9}, {}):
        plan = packing.plan_windows(histogram)
        taken = collections.defaultdict(list)
        for length, count in histogram.items():
            for rank in range(count):
                at = 0
                for start, size, sequence, offset in plan.places(length, rank):
                    assert start == at
                    at += size
                    taken[sequence].append((offset, size))
                assert at == length
        for parts in taken.values():
            end = 0
            for offset, size in sorted(parts):
                assert offset == end
                end += size
            assert end <= 2048 and (end == 2048 or end & (end - 1) == 0)
        assert set(taken) == set(range(plan.n_planned + plan.n_left))


def test_least_squares():
    rows, columns = np.array([0, 1, 1, 2, 0, 2]), np.array([0, 0, 1, 1, 2, 2])
    got = packing.nonnegative_least_squares(rows, columns, np.array([5.0, 3.0, 4.0]), 3)
    assert np.allclose(got, [2, 1, 3], atol=1e-3)
    assert (packing.nonnegative_least_squares(rows[:4], columns[:4], np.array([9.0, 1.0, 0.0]), 2) >= 0).all()


def test_coder_is_the_tokenizer():
    coder = Tokenizer.from_file(JSON)
    coder.encode_special_tokens = True
    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "the", "é", "\n", "12", "中", "🙂", "'s", "\x1f", "\x85", "<|endoftext|>", "  "]) for _ in range(30))
        assert packing.coder(JSON, PATTERN).encode_ordinary(text) == coder.encode(text, add_special_tokens=False).ids


# Pipeline

def test_pipeline(spark):
    """Every stage on what the one before kept, followed by brute force."""
    rng = random.Random(12)
    written = lambda t: "\n".join(" ".join(w + (" the", "", " of", ".")[i % 4] for i, w in enumerate(line.split(" ")))
                                  for line in t.split("\n"))
    rows = [(d, written(t)) for d, t in corpus() if d is not None and d < 400]
    rows += [(1000 + i, junk(rng, i)) for i in range(25)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    given = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], schema)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    (_, classify), (_, lines), (_, near), (_, strings), (_, pack) = corpus_pipeline.STAGES
    rows_of = lambda f: sorted((r.doc_id, r.text) for r in f.collect())

    kept = classify(spark, given, None).cache()
    assert kept.schema == given.schema
    weights = quality_classifier.fit(given)
    assert rows_of(kept) == sorted((d, t) for d, t in rows if quality_classifier.score(weights, t.encode()) >= quality_classifier.KEEP)
    assert not any(d >= 1000 for d, _ in rows_of(kept)) and len(rows_of(kept)) == sum(d < 400 for d, _ in rows)

    left = lines(spark, kept, None).cache()
    assert left.columns == given.columns and all(r.n_chars == len(r.text) and r.lang == "en" for r in left.collect())
    assert rows_of(left) == sorted((d, t) for d, _, _, t in brute_lines(rows_of(kept)))

    single = near(spark, left, None).cache()
    before = rows_of(left)
    _, roots = brute_groups(before, 5)
    first = {}
    for (d, t), r in zip(before, roots):
        first.setdefault(r if t.split() else ("none", d), (d, t))
    assert single.columns == given.columns and rows_of(single) == sorted(first.values())

    cut = strings(spark, single, None).cache()
    assert cut.columns == given.columns and all(r.n_chars == len(r.text) for r in cut.collect())
    assert rows_of(cut) == sorted((d, k.decode("utf-8", "ignore")) for d, _, _, _, k in brute_strings(rows_of(single)))

    pieces = packing.pack(cut, JSON, PATTERN).collect()
    assert check_packing(rows_of(cut), pieces) == 0
    last = pack(spark, cut, None)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in last.collect()) == sorted(
        (p.doc_id, p.start, p.length, zlib.crc32(p.ids)) for p in pieces)


def test_run_writes_each_stage(spark, tmp_path):
    docs = [(i, f"The text number {i} of the table is written with words {i * 7} and {i * 31} in it.", "en", "s", 9) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))


def test_one_long_text_in_time_that_grows_with_it(spark):
    """200,000 lines, half of which two other documents have too."""
    import time
    shared = [f"a line that others have as well {i}" for i in range(100_000)]
    long = [line for i, line in enumerate(shared) for line in (line, f"a line of its own with the number {i}")]
    rows = [(1, "\n".join(long)), (2, "\n".join(shared)), (3, "\n".join(shared)), (4, "short")]
    started = time.time()
    found = {r.row.doc_id: r for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    assert time.time() - started < 60
    assert found[1].n_dropped == 100_000 and found[1].kept_text == "\n".join(long[1::2])
    assert (found[2].n_dropped, found[2].kept_text, found[3].n_dropped, found[3].kept_text) == (100_000, "", 0, rows[2][1])


def test_archives_of_one_member_a_record(spark):
    import gzip
    bodies = [b"first page", b"", b"third " * 5000]
    path = work_dir(spark, "members")
    os.makedirs(path.removeprefix("file:"))
    records = []
    for number, body in enumerate(bodies):
        digest = warc.base32(hashlib.sha1(body).hexdigest())
        records += warc.page_records(number, 10 + number, "http://x", body, digest, None, 8000)
    with open(f"{path.removeprefix('file:')}/part-0.warc.gz", "wb") as out:
        out.write(b"".join(gzip.compress(record) for record in records))
    found = {r.page_id: r.payload for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert found == {10 + number: bytearray(body) for number, body in enumerate(bodies)}
    whole = b"".join(gzip.compress(record) for record in records)
    with pytest.raises(Exception):
        list(warc.members(whole + b"tail"))
    with pytest.raises(ValueError):
        list(warc.members(whole[:-9]))
