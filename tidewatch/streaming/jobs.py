"""The streaming jobs: ingest, rules, windows, state, joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.basic import epoch_seconds
from ..operators.correlation import group_key, having_column, measure, v2_having, v2_value, window_seconds
from ..operators.enrichment import ASSET_KEYS, GEO_KEYS, join_assets, join_geo, write_enrichment
from ..operators.fields import EventFields
from ..operators.parsing import normalize_envelopes
from ..operators.risk import USER_RISK_CAP, USER_RISK_DAYS
from ..operators.rules import CompiledRule, match_rules, v2_group_value, v2_match
from ..operators.threat_intel import extract_indicators, join_scores, lookup_queue

DEFAULT_DELAY = "10 minutes"


# ---------------------------------------------------------------------- ingest
def ingest(raw: DataFrame, ranges: DataFrame | None = None, assets: DataFrame | None = None,
           delay: str = DEFAULT_DELAY) -> DataFrame:
    """Raw envelopes to normalized envelopes with places and assets in their
    ``enrichment``. Repeats of an event id inside the watermark are dropped."""
    fresh = raw.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    return enrich(normalize_envelopes(fresh), ranges, assets)


def enrich(envelopes: DataFrame, ranges: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """Normalized envelopes with places and assets in their ``enrichment``."""
    events = envelopes.withColumns({
        "source_ip": F.col("normalized.source_ip"), "destination_ip": F.col("normalized.destination_ip")})
    if ranges is not None:
        events = join_geo(events, ranges, {"source_ip": "source_geo", "destination_ip": "destination_geo"})
    if assets is not None:
        events = join_assets(events, assets)
    return write_enrichment(events, GEO_KEYS | ASSET_KEYS).drop("source_ip", "destination_ip")


def enrich_batches(spark: SparkSession, ranges: Callable[[], DataFrame], assets: Callable[[], DataFrame],
                   store: Callable[[DataFrame, int], None], folder: str) -> Callable[[DataFrame, int], None]:
    """Body of a foreachBatch after ``ingest`` without tables: every batch meets the places and
    assets of its own time; ``store`` gets enriched envelopes and the batch number.

    The batch is written to ``folder``, where the next one replaces it, and read by ``spark``: a session
    of a stream with state plans without measuring, and would send tables to the driver.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(folder)
        store(enrich(spark.read.schema(batch.schema).parquet(folder), ranges(), assets()), batch_id)
    return body


def envelope_indicators(envelopes: DataFrame) -> DataFrame:
    return extract_indicators(envelopes.select(
        "event_id", "normalized.source_ip", "normalized.destination_ip", "normalized.metadata"))


def attach_scores(envelopes: DataFrame, scores: DataFrame,
                  indicators: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A batch of normalized envelopes with the known reputation scores of their
    indicators in ``enrichment``, and the indicators still to be looked up. Both read the
    ``indicators``, which cost more to find than to keep: give those of the batch if kept."""
    indicators = envelope_indicators(envelopes) if indicators is None else indicators
    scored = envelopes.join(join_scores(indicators, scores), "event_id", "left")
    return write_enrichment(scored, {"threat_intel": "threat_intel"}), lookup_queue(indicators, scores)


def score_batches(scores: Callable[[], DataFrame],
                  store: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Body of a foreachBatch after ``ingest``: every batch meets the scores of its
    own time; ``store`` gets enriched envelopes, the lookup queue and the batch number."""
    def body(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        found = envelope_indicators(kept).persist()
        try:
            enriched, queue = attach_scores(kept, scores(), found)
            store(enriched, queue, batch_id)
        finally:
            found.unpersist()
            kept.unpersist()
    return body


def rule_alerts(events: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """The rule set over a stream, exactly as over a table."""
    return match_rules(events, rules)


# --------------------------------------------------------------------- windows
def tumbling_counts(events: DataFrame, rule: dict, fields: EventFields, delay: str = DEFAULT_DELAY,
                    ts: str = "ts") -> DataFrame:
    """Counters of a second-format rule per tumbling window, for update mode, by any of its functions.
    Rows later than ``delay`` behind the newest event are dropped.

    Streams have no distinct aggregates. A rule that counts different values is two
    aggregates in a row, one counter for each value and then one for each window, so no
    state holds a set; such a chain needs append mode, which gives every window once, when it is over.
    """
    spec = rule["condition"]["aggregation"]
    size = f"{int(spec['window_seconds'])} seconds"
    matching = events.filter(v2_match(rule, fields)).withColumn(
        "group_value", v2_group_value(spec.get("group_by"), fields)).withWatermark(ts, delay)
    if "distinct" in (spec.get("function") or ""):
        item = fields.resolve(spec["field"]).text
        values = matching.groupBy(F.window(ts, size).alias("v"), "group_value", item.alias("item")).agg(F.count("*").alias("n"))
        counted = values.groupBy(F.window(F.window_time("v"), size).alias("w"), "group_value").agg(
            F.sum("n").alias("event_count"), F.count("item").cast("double").alias("aggregated_value"))
    else:
        counted = matching.groupBy(F.window(ts, size).alias("w"), "group_value") \
            .agg(F.count("*").alias("event_count"), v2_value(rule, fields).alias("aggregated_value"))
    return counted.select("group_value", F.col("w.start").alias("window_start"), "event_count", "aggregated_value") \
        .filter(v2_having(rule, F.col("aggregated_value")))


def sliding_rule(events: DataFrame, rule: CompiledRule, fields: EventFields, slide: str,
                 delay: str = DEFAULT_DELAY, ts: str = "ts") -> DataFrame:
    """An aggregation rule over sliding windows, for update mode."""
    aggregation = rule.aggregation or {}
    name = (aggregation.get("having") or {}).get("field") or "count"
    build = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}.get(aggregation.get("type"))
    value = build(measure(fields, name)) if build else F.count("*").cast("double")
    keyed = events.filter(rule.match).withColumn("group_key", group_key(fields, aggregation.get("groupBy")))
    return keyed.withWatermark(ts, delay) \
        .groupBy(F.window(ts, f"{window_seconds(aggregation)} seconds", slide).alias("w"), "group_key") \
        .agg(F.count("*").alias("event_count"), value.alias("aggregated_value")) \
        .select("group_key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "event_count", "aggregated_value") \
        .filter(having_column(aggregation.get("having"), F.col("aggregated_value")))


def user_risk_sessions(events: DataFrame, points: Column, delay: str = DEFAULT_DELAY, ts: str = "ts") -> DataFrame:
    """Capped user scores in sessions that end after seven silent days. An event
    id counts once however often it is delivered."""
    return events.filter(F.trim("username") != "").withColumn("_points", points) \
        .withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"]) \
        .groupBy(F.session_window(ts, f"{USER_RISK_DAYS} days").alias("w"), "username") \
        .agg(F.least(F.sum("_points"), F.lit(USER_RISK_CAP)).alias("score"), F.count("*").alias("event_count")) \
        .select("username", F.col("w.start").alias("session_start"), "score", "event_count")


# ------------------------------------------------------------------ dedup state
DEDUP_OUTPUT = T.StructType([
    T.StructField("dedup_key", T.StringType()), T.StructField("opened_at", T.LongType()),
    T.StructField("last_at", T.LongType()), T.StructField("alert_count", T.LongType()),
])


class DedupPeriods(StatefulProcessor):
    """Periods of one dedup key, equal to those of a batch whatever the order of
    arrival. Up to the watermark all is settled and only the open period is held;
    seconds after it may still get earlier company, so they are held as counts,
    one per second of the delay, and their periods are worked out anew."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "periods", "opened long, last_at long, n long, seconds array<long>, counts array<long>")

    def periods(self, settled: tuple | None, seconds: dict[int, int]) -> list[tuple]:
        """(opened, last, n) in order: the settled period as it goes on, then those after it."""
        found = [settled] if settled else []
        for second in sorted(seconds):
            if not found or second >= found[-1][0] + self.ttl:
                found.append((second, second, 0))
            opened, last, n = found[-1]
            found[-1] = (opened, max(last, second), n + seconds[second])
        return found

    def held(self) -> tuple[tuple | None, dict[int, int]]:
        if not self.state.exists():
            return None, {}
        opened, last, n, seconds, counts = self.state.get()
        return None if opened is None else (opened, last, n), dict(zip(seconds, counts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled, waiting = self.held()
        before = {period[0]: period for period in self.periods(settled, waiting)}
        for batch in rows:
            for second, n in batch.groupby("sec")["n"].sum().items():
                waiting[int(second)] = waiting.get(int(second), 0) + int(n)
        now = {period[0]: period for period in self.periods(settled, waiting)}
        self.handle.registerTimer((max(waiting) + self.ttl) * 1000)
        passed = {s: n for s, n in waiting.items() if s * 1000 <= timerValues.getCurrentWatermarkInMs()}
        settled = next(reversed(self.periods(settled, passed)), None)
        waiting = {s: n for s, n in waiting.items() if s not in passed}
        self.state.update((*(settled or (None, None, None)), list(waiting), list(waiting.values())))
        # A period that an earlier alert has moved comes once more, with no alerts.
        gone = [(opened, opened, 0) for opened in before.keys() - now.keys()]
        changed = [period for opened, period in now.items() if before.get(opened) != period]
        yield pd.DataFrame([(key[0], *period) for period in gone + changed], columns=DEDUP_OUTPUT.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled, waiting = self.held()
        newest = max([*waiting, settled[0] if settled else 0])
        if (newest + self.ttl) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def combine_seconds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: alerts of one key and second become one counted row
    before the stateful shuffle, so a hot key does not flood its task."""
    for batch in batches:
        yield batch.groupby(["dedup_key", "ts", "sec"], as_index=False)["n"].sum()


def dedup_alerts(alerts: DataFrame, ttl_seconds: int, ts: str = "triggered_at",
                 delay: str = DEFAULT_DELAY) -> DataFrame:
    """Dedup periods over an alert stream, for update mode: each batch gives the
    periods it changed with their count so far. The last word on a period counts;
    one that ends with no alerts was moved by an alert that came late."""
    second = F.date_trunc("second", F.col(ts)).cast("timestamp")
    combined = alerts.select("dedup_key", second.alias("ts"), epoch_seconds(F.col(ts)).alias("sec"),
                             F.lit(1).cast("bigint").alias("n")) \
        .mapInPandas(combine_seconds, "dedup_key string, ts timestamp, sec bigint, n bigint")
    return combined.withWatermark("ts", delay).groupBy("dedup_key").transformWithStateInPandas(
        statefulProcessor=DedupPeriods(ttl_seconds), outputStructType=DEDUP_OUTPUT, outputMode="Update",
        timeMode="EventTime")


# ------------------------------------------------------------------------ joins
def packet_names(packets: DataFrame, names: DataFrame, within_seconds: int = 5,
                 delay: str = DEFAULT_DELAY) -> DataFrame:
    """Packets with the names seen on their address pair within the interval;
    a packet without a name comes out once the watermark has passed it. Both
    sides keep only rows the interval can still reach."""
    near = F.expr(f"interval {int(within_seconds)} seconds")
    left = packets.withWatermark("packet_ts", delay)
    right = names.select(F.col("src_ip").alias("_src"), F.col("dst_ip").alias("_dst"), "sni", "name_ts") \
        .withWatermark("name_ts", delay)
    return left.join(
        right,
        (F.col("src_ip") == F.col("_src")) & (F.col("dst_ip") == F.col("_dst"))
        & (F.col("name_ts") > F.col("packet_ts") - near) & (F.col("name_ts") < F.col("packet_ts") + near),
        "left_outer").drop("_src", "_dst")
