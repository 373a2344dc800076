"""Indicators, reputation scores, their cache and its misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.basic import epoch_micros, epoch_seconds, first_per_key, floor_div
from ..functions.ip import is_public_ip
from ..model import ABUSE_RESPONSE, PULSE_RESPONSE
from .periods import following_time
from .selection import CELLS, with_place

MALICIOUS_SCORE = 80

# Indicator spellings, cache lives and what each service answers.
DOMAIN = r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"
HASH = r"(?i)^[a-f0-9]+$"
HASH_TYPES = {32: "md5", 40: "sha1", 64: "sha256"}
ABSOLUTE_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"
CACHE_SECONDS = {"malicious": 7 * 86400, "not_found": 24 * 3600, "clean": 3600}
PROVIDER_TYPES = {
    "AbuseIPDB": ["ipv4", "ipv6"],
    "OTX": ["ipv4", "ipv6", "domain", "url", "file_hash"],
}
INDICATOR = "struct<type:string,hash_type:string,value:string,enrichment_key:string>"


# ------------------------------------------------------------------ indicators
def ip_type(ip: Column) -> Column:
    return F.when(F.contains(ip, F.lit(":")), F.lit("ipv6")).otherwise(F.lit("ipv4"))


def hash_type(text: Column) -> Column:
    """By length, which is asked first because few texts have one of these."""
    kind = F.lit(None).cast("string")
    for length, name in HASH_TYPES.items():
        kind = F.when(F.length(text) == length, F.lit(name)).otherwise(kind)
    return F.when(F.length(text).isin(list(HASH_TYPES)) & text.rlike(HASH), kind)


def metadata_key(key: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), r"[^\p{L}\p{Nd}]", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit("unknown")).otherwise(cleaned)


def _indicator(kind: Column, value: Column, key: Column, hashed: Column | None = None) -> Column:
    return F.struct(
        kind.alias("type"), (hashed if hashed is not None else F.lit(None).cast("string")).alias("hash_type"),
        F.lower(F.trim(value)).alias("value"), key.alias("enrichment_key"))


def classify_value(value: Column, key: Column) -> Column:
    """Indicators of one metadata value: public address, else hash, else
    absolute URL (host and URL), else domain; an empty array otherwise."""
    text = F.trim(value)
    label = lambda kind: F.concat(F.lit("metadata."), metadata_key(key), F.lit(f".{kind}"))
    hashed = hash_type(text)
    host = F.try_parse_url(text, F.lit("HOST"))
    return (
        F.when(is_public_ip(text), F.array(_indicator(ip_type(text), text, label("ip"))))
        .when(hashed.isNotNull(), F.array(_indicator(F.lit("file_hash"), text, label("hash"), hashed)))
        .when(text.rlike(ABSOLUTE_URL) & host.isNotNull(), F.array(
            _indicator(F.lit("domain"), host, label("domain")), _indicator(F.lit("url"), text, label("url"))))
        .when(text.rlike(DOMAIN), F.array(_indicator(F.lit("domain"), text, label("domain"))))
        .otherwise(F.array().cast(f"array<{INDICATOR}>"))
    )


def address_indicator(ip: Column, key: str) -> Column:
    return F.when(is_public_ip(ip), F.array(_indicator(ip_type(ip), ip, F.lit(key)))) \
        .otherwise(F.array().cast(f"array<{INDICATOR}>"))


def extract_indicators(events: DataFrame, id_column: str = "event_id",
                       metadata: str | None = "metadata") -> DataFrame:
    """One row per event and distinct indicator, first place of finding kept.

    Distinctness is per event, so it is settled inside the row's own array and
    needs no shuffle.
    """
    found = [address_indicator(F.col("source_ip"), "source_ip"),
             address_indicator(F.col("destination_ip"), "destination_ip")]
    if metadata:
        found.append(F.flatten(F.transform(
            F.map_entries(F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))),
            lambda e: F.when(F.trim(e["value"]) != "", classify_value(e["value"], e["key"]))
            .otherwise(F.array().cast(f"array<{INDICATOR}>")))))
    everything = F.concat(*found)
    identity = lambda i: F.concat_ws(":", i["type"], F.coalesce(i["hash_type"], F.lit("")), i["value"])
    distinct = F.filter(F.col("_all"), lambda x, i: F.array_position(F.col("_ids"), identity(x)) == i + 1)
    return (
        events.select(id_column, everything.alias("_all"))
        .withColumn("_ids", F.transform("_all", identity))
        .select(id_column, F.inline(distinct))
    )


def text_indicators(documents: DataFrame, id_column: str, text: Column) -> DataFrame:
    """Distinct public IPv4 addresses and file hashes named in free text, one
    row per document and indicator. Whole texts are searched."""
    tokens = F.regexp_extract_all(text, F.lit(TEXT_TOKEN), F.lit(1))
    pieces = documents.select(id_column, F.explode(F.array_distinct(F.transform(tokens, F.lower))).alias("value"))
    hashed = hash_type(F.col("value"))
    kind = F.when(hashed.isNotNull(), F.lit("file_hash")).when(is_public_ip(F.col("value")), F.lit("ipv4"))
    return pieces.select(id_column, kind.alias("type"), hashed.alias("hash_type"), "value") \
        .filter(F.col("type").isNotNull())


TEXT_TOKEN = r"\b([0-9A-Fa-f]{32,64}|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"


def cache_key(kind: Column, value: Column, hashed: Column) -> Column:
    label = F.when(kind == "file_hash", F.lit("hash")).otherwise(kind)
    return F.concat_ws(":", F.lit("threatintel"), label, F.when(kind == "file_hash", hashed),
                       F.lower(F.trim(value)))


# ---------------------------------------------------------------- score lookups
def join_scores(indicators: DataFrame, scores: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Known scores of each event as a map from enrichment key to score.

    An event has a handful of indicators, so the grouping by event id stays
    small and even; the hot indicator side is a join, which adaptive execution
    splits.
    """
    known = indicators.join(scores.select("type", "value", "is_malicious", "score"), ["type", "value"])
    entries = F.array_sort(F.collect_list(F.struct(
        F.col("enrichment_key").alias("key"), F.struct("is_malicious", "score").alias("value"))))
    return known.groupBy(id_column).agg(entries.alias("_entries")) \
        .select(id_column, F.map_from_entries(first_per_key(F.col("_entries"))).alias("threat_intel"))


def lookup_queue(indicators: DataFrame, scores: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Indicators without a score, once per event."""
    missing = indicators.join(scores.select("type", "value"), ["type", "value"], "left_anti")
    return missing.select(id_column, "type", "hash_type", "value").dropDuplicates()


def valid_spans(cache: DataFrame, keys: list[str], tiebreak: str) -> DataFrame:
    """Cache entries with the span in which each answers: from its writing to
    its expiry or the next writing of the key, whichever comes first."""
    life = cache_seconds(F.col("is_malicious"), F.col("score"), F.col("status"))
    return following_time(cache, keys, "cached_at", [tiebreak], "_rewritten") \
        .withColumn("valid_until", F.least(F.col("cached_at") + F.make_interval(secs=life), F.col("_rewritten"))) \
        .drop("_rewritten")


def cache_seconds(is_malicious: Column, score: Column, status: Column) -> Column:
    return (
        F.when(is_malicious | (score >= MALICIOUS_SCORE), F.lit(CACHE_SECONDS["malicious"]))
        .when(F.lower(status) == "not_found", F.lit(CACHE_SECONDS["not_found"]))
        .otherwise(F.lit(CACHE_SECONDS["clean"]))
    )


def join_valid_scores(requests: DataFrame, cache: DataFrame, keys: list[str], tiebreak: str, ts: str = "ts",
                      cell_seconds: int = 6 * 3600) -> DataFrame:
    """The cache entry that answers each request at its own time, or nulls.

    Spans of one key do not overlap, so a request matches at most once. Spans
    are repeated per time cell (at most 29 for the longest life) to make the
    join an equality on key and cell: a hot key is split along time.
    """
    spans = valid_spans(cache, keys, tiebreak)
    cells = F.sequence(floor_div(epoch_seconds(F.col("cached_at")), cell_seconds),
                       floor_div(epoch_seconds(F.col("valid_until")), cell_seconds))
    spans = spans.select(
        *[F.col(key).alias(f"_{key}") for key in keys], "cached_at", "valid_until", "is_malicious", "score", "status",
        F.explode(cells).alias("_span_cell"))
    asked = requests.withColumn("_cell", floor_div(epoch_seconds(F.col(ts)), cell_seconds))
    same = F.col("_cell") == F.col("_span_cell")
    for key in keys:
        same = same & (F.col(key) == F.col(f"_{key}"))
    return asked.join(spans, same & (F.col(ts) >= F.col("cached_at")) & (F.col(ts) < F.col("valid_until")), "left") \
        .drop("_cell", "_span_cell", "valid_until", *[f"_{key}" for key in keys])


# ------------------------------------------------------------------- providers
def provider_requests(requests: DataFrame, providers: DataFrame, support: DataFrame) -> DataFrame:
    """Which enabled provider is asked about which indicator. Only the first
    configuration of a provider counts."""
    first = Window.partitionBy("provider").orderBy("position")
    active = providers.withColumn("_rank", F.row_number().over(first)) \
        .filter((F.col("_rank") == 1) & F.col("enabled")).select("provider")
    return requests.join(support.join(active, "provider"), "type")


def provider_support(spark) -> DataFrame:
    rows = [(name, kind) for name, kinds in PROVIDER_TYPES.items() for kind in kinds]
    return spark.createDataFrame(rows, "provider string, type string")


def daily_quota(calls: DataFrame, quota: int, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """The first ``quota`` calls of each provider and UTC day; all when it is
    zero or less. A day is cut into time cells; those behind the quota are not
    read again, and only a cell's calls are put in order."""
    if quota <= 0:
        return calls
    at = epoch_micros(F.col(ts))
    return with_place(calls.withColumn("_day", F.to_date(F.col(ts))), ["provider", "_day"], at, 86_400_000_000 // CELLS,
                      [ts, tiebreak], "_place", last=quota).drop("_place", "_day")


def merge_scores(results: DataFrame, keys: list[str]) -> DataFrame:
    """One score per indicator out of all provider answers: highest score, any
    malicious verdict, newest sighting, details by provider, and how many feeds
    and providers name it, case-blind. The names themselves are outside input
    without a bound and stay rows: ``merged_feeds``. The answers are read once
    and folded to one row per name before an indicator's are brought together."""
    folded = _named_by(results, keys, ["score", "is_malicious", "last_seen", "details"]) \
        .groupBy(*keys, "_folded", "_own").agg(
            F.max("score").alias("score"), F.max("is_malicious").alias("is_malicious"),
            F.max("last_seen").alias("last_seen"), F.max(F.when(F.col("_own").isNotNull(), F.col("details"))).alias("_text"))
    detail = F.when(F.col("_text").isNotNull(), F.struct(F.col("_own").alias("provider"), F.col("_text").alias("details")))
    return folded.groupBy(*keys).agg(
        F.max("score").alias("score"),
        (F.max("is_malicious") | (F.max("score") >= MALICIOUS_SCORE)).alias("is_malicious"),
        F.max("last_seen").alias("last_seen"), F.count_distinct("_folded").alias("feed_count"),
        F.map_from_entries(F.array_sort(F.collect_list(detail))).alias("details"),
    ).withColumn("status", F.when(F.col("is_malicious"), F.lit("malicious")).otherwise(F.lit("clean")))


def merged_feeds(results: DataFrame, keys: list[str]) -> DataFrame:
    """The feeds and providers that name each indicator, one row each, case-blind."""
    return _named_by(results, keys, []).groupBy(*keys, "_folded").agg(F.min("feed").alias("feed")).drop("_folded")


def _named_by(results: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Answers repeated per feed and for the provider itself, which alone fills ``_own``."""
    nobody = F.lit(None).cast("string")
    feeds = F.transform(F.coalesce("feeds", F.array().cast("array<string>")),
                        lambda feed: F.struct(feed.alias("feed"), nobody.alias("_own")))
    itself = F.struct(F.col("provider").alias("feed"), F.col("provider").alias("_own"))
    return results.select(*keys, *kept, F.inline(F.array_append(feeds, itself))) \
        .withColumn("_folded", F.lower("feed"))


def score_or_not_found(requests: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Merged score of each request; an unanswered one reads ``not_found``."""
    return requests.join(merged, keys, "left").withColumns({
        "score": F.coalesce("score", F.lit(0)), "is_malicious": F.coalesce("is_malicious", F.lit(False)),
        "status": F.coalesce("status", F.lit("not_found")),
    })


def parse_abuse_response(body: Column) -> Column:
    """Score struct of a landed abuse-report answer; null without ``data``."""
    data = F.from_json(body, ABUSE_RESPONSE, {"mode": "PERMISSIVE"})["data"]
    score = F.coalesce(data["abuseConfidenceScore"], F.lit(0))
    return F.when(data.isNotNull(), F.struct(
        (score >= MALICIOUS_SCORE).alias("is_malicious"), score.alias("score"),
        F.array(F.lit("AbuseIPDB")).alias("feeds"),
        data["lastReportedAt"].try_cast("timestamp").alias("last_seen"),
        F.coalesce(data["totalReports"], F.lit(0)).alias("total_reports"),
        F.when(score > 0, F.lit("suspicious")).otherwise(F.lit("clean")).alias("status"),
    ))


def parse_pulse_response(body: Column) -> Column:
    """Score struct of a landed pulse-list answer."""
    info = F.from_json(body, PULSE_RESPONSE, {"mode": "PERMISSIVE"})["pulse_info"]
    score = F.when(F.coalesce(info["count"], F.lit(0)) > 0, F.lit(90)).otherwise(F.lit(0))
    names = F.filter(F.transform(info["pulses"], lambda p: p["name"]), lambda n: F.trim(n) != "")
    named = F.concat(F.array(F.lit("OTX")), F.coalesce(names, F.array().cast("array<string>")))
    folded = F.transform(named, F.lower)
    return F.struct(
        (score >= MALICIOUS_SCORE).alias("is_malicious"), score.alias("score"),
        F.filter(named, lambda n, i: F.array_position(folded, F.lower(n)) == i + 1).alias("feeds"),
        F.array_max(F.transform(info["pulses"], lambda p: p["modified"].try_cast("timestamp"))).alias("last_seen"),
        info["count"].alias("pulse_count"),
        F.when(info["count"] == 0, F.lit("clean")).alias("status"),
    )
