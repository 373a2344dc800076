"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import functions as F

from ..session import work_dir
from . import (bpe, collocations, hard_negatives, html_extract, line_dedup, merkle, near_dedup, packing, quality_classifier, quality_rules,
               sharding, suffix_dedup, warc)
from .common import table


def op1_html_extract(spark, folder):
    return html_extract.extract_main_text(table(spark, folder, "pages"))


def op2_quality_rules(spark, folder):
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, folder, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.POLICIES["base-1"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), "kept", "failed", "n_full_lines", "n_capitals", "n_letters")


def op3_byte_bpe(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op4_fingerprints(spark, folder):
    return merkle.compare_with_edits(table(spark, folder, "documents"))


def op5_warc(spark, folder):
    path = work_dir(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_dedup(spark, folder):
    return suffix_dedup.deduplicated(table(spark, folder, "documents"))


def op7_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op8_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_classifier.classify(docs, quality_classifier.fit(docs))


def op9_near_dedup(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op10_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_hard_negatives(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    mixed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", mixed), F.col("vec_id") % 100 == 0)


def op12_sharding(spark, folder):
    text = F.col("row.text")
    none = F.lit(None).cast("int")
    return sharding.shuffled(table(spark, folder, "documents").select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "size", F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"), "shard", "slot", none.alias("grown_shard"))


def op13_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents").select("text", "lang"))


QUERIES = {q.__name__: q for q in (op1_html_extract, op2_quality_rules, op3_byte_bpe, op4_fingerprints, op5_warc,
                                   op6_suffix_dedup, op7_packing, op8_quality_classifier, op9_near_dedup,
                                   op10_line_dedup, op11_hard_negatives, op12_sharding, op13_collocations)}

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

SQL = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
often AS (SELECT doc_id, a, b, c FROM grams GROUP BY ALL HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM
             (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM grams JOIN often USING (doc_id, a, b, c)) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(lines.again, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(lines.n, 0) AS BIGINT) AS n_full_lines,
             CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS BIGINT) AS n_letters
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
        + 4 * (100 * n_symbols > 15 * n_words)::INT + 8 * (100 * n_dup_lines > 50 * n_full_lines)::INT
        + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
        + 32 * (100 * n_capitals > 50 * n_letters)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed,
       failed = 0 AS kept, failed, n_full_lines, n_capitals, n_letters FROM f
""",
    "op6_suffix_dedup": r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS string
      FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
firsts AS (SELECT string, min(doc_id) AS first_doc FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS opens
      FROM s JOIN firsts USING (string) WHERE doc_id > first_doc WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b
         FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
borders AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS removed FROM runs GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(len(starts), 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE list_aggregate(list_transform(range(0, len(starts) + 1), lambda k:
           substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * ends[k] + 1 END,
                  (CASE WHEN k = len(starts) THEN len(h) // 2 ELSE starts[k + 1] END
                   - CASE WHEN k = 0 THEN 0 ELSE ends[k] END) * 2)), 'string_agg', '') END)) AS kept_sha256
FROM d LEFT JOIN borders USING (doc_id)
""",
    "op9_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS words
                     FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + least(4, len(words)) - 1], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, CASE WHEN len(words) = 0 THEN 1 ELSE greatest(len(words) - 2, 2) END)) AS i
            FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (shingle)
           WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents
          UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n USING (doc_id)
""",
    "op10_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM d),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key
          FROM lines),
often AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key
          HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, i, line, coalesce(doc_id < last_doc, false) AS goes FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op11_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS "rank",
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
""",
    "op13_collocations": rf"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS words
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
w AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
f AS (SELECT lang, len(g) AS size, g, count(*) AS f
      FROM (SELECT lang, words[i:i + k - 1] AS g FROM w, range(1, 5) t(k) WHERE i + k - 1 <= len(words))
      GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM p GROUP BY lang),
covered AS (SELECT lang, g[i:i + k - 1] AS g, max(f) AS longer
            FROM (SELECT f.*, k, unnest(range(1, size - k + 2)) AS i FROM f, range(2, 4) t(k) WHERE k < size) GROUP BY ALL),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r,
                CAST(2000000::HUGEINT * c.f // (x.f + y.f) AS BIGINT) AS score
         FROM f c LEFT JOIN covered ON covered.lang = c.lang AND covered.g = c.g CROSS JOIN range(1, 4) t(k)
         JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]
         WHERE c.size >= 2 AND k < c.size AND coalesce(100 * longer < 80 * c.f, true)),
best AS (SELECT *, array_to_string(g, ' ') AS phrase FROM cuts
         QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, a, l, r, n, score
FROM best JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
}
