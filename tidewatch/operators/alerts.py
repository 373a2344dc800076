"""Alerts: creation, deduplication, lifecycle and reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.basic import case_map, epoch_seconds, floor_div
from ..model import ALERT_STATUSES, SEVERITIES, STATUS_MOVES
from .paging import rows_at
from .periods import fixed_periods

DEDUP_SECONDS = 60 * 60
STALE_HOURS = 24
AUTO_RESOLVE_COMMENT = "Auto-resolved due to inactivity"

# One step up, the top stays.
BOOSTED = {"low": "medium", "medium": "high", "high": "critical", "critical": "critical"}


# -------------------------------------------------------------------- creation
def alert_id(rule_id: Column, event_id: Column) -> Column:
    """The same match always gets the same id, so a replay creates no copies."""
    return F.sha2(F.concat_ws("|", rule_id, event_id.cast("string")), 256)


def boost_severity(severity: Column, source_rank: Column, destination_rank: Column) -> Column:
    """One step up when an involved asset is of high criticality (rank 2) or more."""
    critical = F.coalesce(F.greatest(source_rank, destination_rank) >= 2, F.lit(False))
    return F.when(critical, case_map(severity, BOOSTED, severity)).otherwise(severity)


def dedup_key(rule_id: Column, source: Column, destination: Column) -> Column:
    """Digest of rule, source up to its first colon, and destination."""
    origin = F.when(F.coalesce(source, F.lit("")) == "", F.lit("unknown")) \
        .otherwise(F.substring_index(source, ":", 1))
    return F.concat(F.lit("dedup:"), F.sha2(F.concat_ws(
        ":", rule_id, origin, F.coalesce(destination, F.lit("unknown"))), 256))


def alert_context(event_columns: list[str], normalized_columns: list[str], metadata: str | None = None,
                  enrichment: str | None = None, assets: Column | None = None) -> Column:
    """Context JSON; null parts are left out."""
    parts = [F.col(name) for name in event_columns]
    normal = [F.col(name) for name in normalized_columns]
    if metadata:
        normal.append(F.when(F.size(metadata) > 0, F.col(metadata)).alias("metadata"))
    parts.append(F.struct(*normal).alias("normalized"))
    if enrichment:
        parts.append(F.when(F.size(enrichment) > 0, F.col(enrichment)).alias("enrichment"))
    if assets is not None:
        parts.append(assets.alias("asset_context"))
    return F.to_json(F.struct(*parts))


def create_alerts(matches: DataFrame, ts: str = "ts", source_rank: Column | None = None,
                  destination_rank: Column | None = None, source: str = "source_ip",
                  context: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One new alert per (event, rule) match from ``match_rules``. ``context`` is stored with it,
    ``keep`` names columns of the event to carry on, for scoring."""
    nothing = F.lit(None).cast("int")
    return matches.select(
        alert_id(F.col("rule_id"), F.col("event_id")).alias("alert_id"), "rule_id", "rule_name",
        boost_severity(F.col("rule_severity"), nothing if source_rank is None else source_rank,
                       nothing if destination_rank is None else destination_rank).alias("severity"),
        F.lit("new").alias("status"), F.col(ts).alias("triggered_at"), F.col(source).alias("source"),
        F.col("destination_ip").alias("destination"), "event_id",
        dedup_key(F.col("rule_id"), F.col(source), F.col("destination_ip")).alias("dedup_key"),
        F.col(ts).alias("created_at"), F.col(ts).alias("updated_at"),
        (F.lit(None).cast("string") if context is None else context).alias("context"),
        F.lit(None).cast("bigint").alias("aggregation_count"), F.lit(None).cast("double").alias("aggregated_value"),
        *keep,
    )


def create_group_alerts(groups: DataFrame, source: str | None = None, destination: str | None = None) -> DataFrame:
    """One new alert per satisfied group of ``aggregate_rule``, with the same columns. It is
    triggered by the group's last event; ``source`` and ``destination`` name group columns."""
    nothing = F.lit(None).cast("string")
    origin = F.col("group_key") if source is None else F.col(source)
    target = nothing if destination is None else F.col(destination)
    return groups.select(
        alert_id(F.col("rule_id"), F.concat_ws("|", F.col("group_key"), F.col("first_event_id").cast("string")))
        .alias("alert_id"), "rule_id", "rule_name", "severity", F.lit("new").alias("status"),
        F.col("last_seen").alias("triggered_at"), origin.alias("source"), target.alias("destination"),
        F.col("first_event_id").alias("event_id"), dedup_key(F.col("rule_id"), origin, target).alias("dedup_key"),
        F.col("last_seen").alias("created_at"), F.col("last_seen").alias("updated_at"),
        F.to_json(F.struct("group_key", "first_seen", "last_seen")).alias("context"),
        F.col("event_count").alias("aggregation_count"), F.col("aggregated_value").cast("double").alias("aggregated_value"))


def deduplicate(alerts: DataFrame, ttl_seconds: int = DEDUP_SECONDS) -> DataFrame:
    """One alert per dedup key and period. The first alert of a key opens a
    fixed period; later ones in it only raise its count and last sighting."""
    periods = fixed_periods(alerts, "dedup_key", F.col("triggered_at"), ttl_seconds,
                            first=F.struct("alert_id", "rule_id", "severity", "source", "destination"),
                            order=F.struct("triggered_at", "alert_id"))
    return periods.select("first.*", "dedup_key", F.col("n").alias("alert_count"), "first_seen", "last_seen")


# ------------------------------------------------------------------- lifecycle
def allowed_move(old: Column, new: Column) -> Column:
    moves = F.lit(False)
    for status, targets in STATUS_MOVES.items():
        moves = moves | ((old == status) & new.isin(targets))
    return (old == new) | moves


UNKNOWN = len(ALERT_STATUSES)  # the state of an alert nobody knows; commands leave it there
# A table that leads each state to another is one number: so many bits for each state.
_BITS = UNKNOWN.bit_length()
_PLACES = np.left_shift(np.int64(1), np.arange(UNKNOWN + 1, dtype=np.int64) * _BITS)


def apply_transitions(alerts: DataFrame, commands: DataFrame, chunk_seconds: int = 30 * 86400) -> DataFrame:
    """Every command to one of the alerts with the status it met, whether it was
    accepted, and the status after it.

    ``commands``: alert_id, at, seq, new_status, and optionally ``force``, which
    skips the transition table. Commands of one alert depend on each other, but
    what a run of commands does to each of the statuses is a small table,
    and such tables compose. So runs (one alert, one ``chunk_seconds`` stretch)
    are summed up in parallel, only those summaries pass through an alert's own
    order, and then all runs are replayed in parallel from their start status.
    Rows stream through in order; no run is ever gathered.

    What a status is at the beginning, of an alert or of a run, travels as a row that
    sorts before the commands, so nothing is joined: each step is one exchange.
    """
    codes = {name: code for code, name in enumerate(ALERT_STATUSES)}
    names = dict(enumerate(ALERT_STATUSES))
    force = F.coalesce(F.col("force"), F.lit(False)) if "force" in commands.columns else F.lit(False)
    run = ["alert_id", "_chunk"]
    coded = commands.withColumns({
        "force": force, "_code": case_map(F.col("new_status"), codes, -1),
        # Commands without a time come first.
        "_chunk": F.coalesce(floor_div(epoch_seconds(F.col("at")), chunk_seconds), F.lit(-(1 << 62)))}).where("alert_id IS NOT NULL")

    key_fields = [coded.schema["alert_id"], T.StructField("_chunk", T.LongType())]
    effects = coded.select(*run, "at", "seq", "_code", "force") \
        .repartition(*run).sortWithinPartitions(*run, "at", "seq") \
        .mapInArrow(_run_effects, T.StructType([*key_fields, T.StructField("_effect", T.LongType())]))
    # An alert begins with a table that leads every status to its own.
    begins = alerts.select(F.col("alert_id").cast(coded.schema["alert_id"].dataType).alias("alert_id"),
                           F.lit(None).cast("long").alias("_chunk"),
                           (case_map(F.col("status"), codes, 0).cast("long") * int(_PLACES.sum())).alias("_effect"))
    starts = effects.unionByName(begins).repartition("alert_id").sortWithinPartitions(*run) \
        .mapInArrow(_run_starts, T.StructType([*key_fields, T.StructField("_start", T.IntegerType())]))
    replay = coded.unionByName(starts, allowMissingColumns=True).withColumn("_is_command", F.col("_start").isNull()) \
        .repartition(*run).sortWithinPartitions(*run, "_is_command", "at", "seq")
    decided = replay.mapInArrow(_replay_runs, T.StructType([
        *replay.schema.fields, T.StructField("_old", T.IntegerType()), T.StructField("accepted", T.BooleanType())]))
    old = case_map(F.col("_old"), names)
    return decided.withColumns({
        "old_status": old, "status": F.when(F.col("accepted"), F.col("new_status")).otherwise(old),
    }).drop("_chunk", "_code", "_start", "_is_command", "_old")


def _moves() -> np.ndarray:
    """Status after wanting ``column`` in ``row``; a forbidden move stays put. The
    extra last column stands for a status nobody knows, the last row for such an alert."""
    table = [[ALERT_STATUSES.index(want) if want == have or want in STATUS_MOVES[have] else row
              for want in ALERT_STATUSES] + [row] for row, have in enumerate(ALERT_STATUSES)]
    return np.array([*table, [UNKNOWN] * (UNKNOWN + 1)], dtype=np.int32)


def _group_starts(*columns: pa.Array) -> np.ndarray:
    """First row of each stretch of equal values in sorted columns."""
    changed = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed |= codes[1:] != codes[:-1]
    return np.flatnonzero(np.append(True, changed))


def _steps(starts: np.ndarray, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, rows) for the first rows of all groups, then the second rows and
    so on, so sequential work on each group is done for all groups at once."""
    lengths = np.diff(np.append(starts, total))
    longest_first = np.argsort(-lengths, kind="stable")
    for step in range(int(lengths.max())):
        groups = longest_first[: int(np.count_nonzero(lengths > step))]
        yield groups, starts[groups] + step


def _commands(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Wanted status and force of each row; a row that is no command wants a status nobody knows."""
    return (batch.column("_code").fill_null(-1).to_numpy(zero_copy_only=False),
            batch.column("force").fill_null(False).to_numpy(zero_copy_only=False).astype(bool))


def _key(batch: pa.RecordBatch, row: int) -> tuple:
    return batch.column("alert_id")[row].as_py(), batch.column("_chunk")[row].as_py()


def _run_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up each run as the end status for every possible start status."""
    moves, unchanged = _moves(), np.arange(UNKNOWN + 1, dtype=np.int32)
    open_run, open_effect, alert_type = None, None, None

    def emit(alerts, chunks, effects) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([alerts, chunks, pa.array(effects.astype(np.int64) @ _PLACES)],
                                          names=["alert_id", "_chunk", "_effect"])

    def emit_open() -> pa.RecordBatch:
        return emit(pa.array([open_run[0]], alert_type), pa.array([open_run[1]], pa.int64()), open_effect[None, :])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        alert_type = batch.schema.field("alert_id").type
        codes, forced = _commands(batch)
        starts = _group_starts(batch.column("alert_id"), batch.column("_chunk"))
        effects = np.tile(unchanged, (len(starts), 1))
        if open_run == _key(batch, 0):
            effects[0] = open_effect
        elif open_run is not None:
            yield emit_open()
        for runs, rows in _steps(starts, batch.num_rows):
            wanted = codes[rows][:, None]
            after = np.where(forced[rows][:, None] & (wanted >= 0), wanted, moves[effects[runs], wanted])
            after[:, UNKNOWN] = UNKNOWN
            effects[runs] = after
        # The last run may go on in the next batch.
        done = pa.array(starts[:-1])
        if len(done):
            yield emit(batch.column("alert_id").take(done), batch.column("_chunk").take(done), effects[:-1])
        open_run, open_effect = _key(batch, int(starts[-1])), effects[-1]
    if open_run is not None:
        yield emit_open()


def _run_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carries an alert's status through the summaries of its runs, in order; the first leads to its own status."""
    current, state = None, UNKNOWN
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = _group_starts(batch.column("alert_id"))
        effects = batch.column("_effect").to_numpy(zero_copy_only=False)
        states = np.full(len(starts), UNKNOWN, dtype=np.int32)
        if batch.column("alert_id")[0].as_py() == current:
            states[0] = state
        result = np.empty(batch.num_rows, dtype=np.int32)
        for alerts, rows in _steps(starts, batch.num_rows):
            result[rows] = states[alerts]
            states[alerts] = effects[rows] >> (states[alerts] * _BITS) & ((1 << _BITS) - 1)
        current, state = batch.column("alert_id")[int(starts[-1])].as_py(), int(states[-1])
        made = pa.RecordBatch.from_arrays([batch.column("alert_id"), batch.column("_chunk"), pa.array(result)],
                                          names=["alert_id", "_chunk", "_start"])
        yield made.filter(pc.is_valid(batch.column("_chunk")))


def _replay_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays the commands of each run from its start status, which its first row tells."""
    moves, open_run, state = _moves(), None, UNKNOWN
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes, forced = _commands(batch)
        starts = _group_starts(batch.column("alert_id"), batch.column("_chunk"))
        states = batch.column("_start").fill_null(UNKNOWN).to_numpy(zero_copy_only=False)[starts].astype(np.int32)
        if open_run == _key(batch, 0):
            states[0] = state
        olds, accepted = np.empty(batch.num_rows, dtype=np.int32), np.empty(batch.num_rows, dtype=bool)
        for runs, rows in _steps(starts, batch.num_rows):
            old, wanted = states[runs], codes[rows]
            ok = (wanted >= 0) & (old != UNKNOWN) & (forced[rows] | (moves[old, wanted] == wanted))
            olds[rows], accepted[rows] = old, ok
            states[runs] = np.where(ok, wanted, old)
        open_run, state = _key(batch, int(starts[-1])), int(states[-1])
        made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(olds), pa.array(accepted)],
                                          names=[*batch.schema.names, "_old", "accepted"])
        yield made.filter(pc.and_(batch.column("_is_command"), pa.array(olds != UNKNOWN)))


def status_history(decided: DataFrame) -> DataFrame:
    """Accepted changes, one row each: the alert's history as a table."""
    return decided.filter("accepted").drop("accepted", "status")


# The column an accepted status stamps.
STAMPS = {
    "acknowledged": "acknowledged_at", "under_investigation": "investigation_started_at",
    "resolved": "resolved_at", "closed": "closed_at", "false_positive": "false_positive_at",
}


def alert_states(alerts: DataFrame, decided: DataFrame) -> DataFrame:
    """Alerts after their commands: status, stamps, comment, reason. All of it
    is partial aggregates over the decided commands."""
    order = F.struct("at", "seq")
    accepted = decided.filter("accepted")
    comment = F.col("comment") if "comment" in decided.columns else F.lit(None).cast("string")
    reason = F.col("reason") if "reason" in decided.columns else F.lit(None).cast("string")
    last = accepted.groupBy("alert_id").agg(
        F.max_by("status", order).alias("_status"), F.count("*").alias("change_count"), F.max("at").alias("updated_at"),
        F.max_by(comment, F.when(comment.isNotNull() | F.col("force"), order)).alias("resolution_comment"),
        F.max_by(reason, F.when(F.col("force"), order)).alias("resolution_reason"),
        *[F.max(F.when(F.col("status") == status, F.col("at"))).alias(column) for status, column in STAMPS.items()])
    kept = [c for c in alerts.columns if c not in {"status", *last.columns} or c == "alert_id"]
    return alerts.select(*kept, "status").join(last, "alert_id", "left") \
        .withColumns({"status": F.coalesce("_status", "status"), "change_count": F.coalesce("change_count", F.lit(0))}) \
        .drop("_status")


def update_status(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """New status where it differs, ignoring case; ``changed`` tells where."""
    wanted = updates.select("alert_id", F.col("new_status").alias("_wanted"))
    differs = F.coalesce(F.lower("_wanted") != F.lower("status"), F.lit(False))
    return alerts.join(wanted, "alert_id", "left").withColumn("changed", differs) \
        .withColumn("status", F.when(F.col("changed"), F.col("_wanted")).otherwise(F.col("status"))).drop("_wanted")


def upsert_alerts(alerts: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with the newest update of each id, updates naming no alert)."""
    newest = Window.partitionBy("alert_id").orderBy(F.desc("updated_at"), F.desc("status"))
    last = updates.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")
    fields = [c for c in updates.columns if c != "alert_id" and c in alerts.columns]
    renamed = last.select("alert_id", F.struct(*fields).alias("_new"))
    merged = alerts.join(renamed, "alert_id", "left").withColumns({
        name: F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)) for name in fields})
    return merged.drop("_new"), updates.join(alerts.select("alert_id"), "alert_id", "left_anti")


# ----------------------------------------------------------------------- reads
def recent_alerts(alerts: DataFrame, since: Column, severity: str | None = None) -> DataFrame:
    found = alerts.filter(F.col("triggered_at") >= since)
    if severity:
        found = found.filter(F.col("severity") == severity.lower())
    return found.orderBy(F.desc("triggered_at"), F.desc("created_at"), "alert_id")


def alerts_by_rule(alerts: DataFrame, rule_id: str, limit: int = 100) -> DataFrame:
    return alerts.filter(F.col("rule_id") == rule_id) \
        .orderBy(F.desc("triggered_at"), F.desc("created_at"), "alert_id").limit(limit if limit > 0 else 100)


def alert_page(alerts: DataFrame, page: int, size: int, severity: str | None = None) -> DataFrame:
    """One page, newest first, with the total count and number of pages. Page
    and count are two small jobs over the same filter, not one global window; a
    deep page is found by counts of time cells."""
    page, size = max(page, 1), max(size, 1)
    found = alerts.filter(F.col("severity") == severity.lower()) if severity else alerts
    total = found.agg(F.count("*").alias("n"))
    rows = rows_at(found, [F.desc("triggered_at"), F.desc("created_at"), F.asc("alert_id")], "triggered_at",
                   (page - 1) * size, size)
    return rows.withColumn("total_count", total.scalar()) \
        .withColumn("total_pages", F.ceil(F.col("total_count") / size).cast("bigint"))


def alerts_after(alerts: DataFrame, size: int, after: tuple[Column, str | int] | None = None,
                 severity: str | None = None) -> DataFrame:
    """The ``size`` newest alerts that follow a known (triggered_at, alert_id): each task keeps
    ``size`` rows however deep the page lies."""
    found = alerts.filter(F.col("severity") == severity.lower()) if severity else alerts
    if after is not None:
        at, last = after
        found = found.filter((F.col("triggered_at") <= at) & ((F.col("triggered_at") < at) | (F.col("alert_id") > last)))
    return found.orderBy(F.desc("triggered_at"), "alert_id").limit(max(size, 1))


def get_alert(alerts: DataFrame, alert_id: str | int | None = None, dedup_key: str | None = None) -> DataFrame:
    if alert_id is not None:
        return alerts.filter(F.col("alert_id") == alert_id)
    return alerts.filter(F.col("dedup_key") == dedup_key).orderBy(F.desc("triggered_at"), "alert_id").limit(1)


def stale_alerts(alerts: DataFrame, since: Column) -> DataFrame:
    return alerts.filter((F.col("status") == "new") & (F.col("last_seen") < since)) \
        .orderBy(F.desc("last_seen"), "alert_id")


def auto_resolve(alerts: DataFrame, as_of: Column, hours: int = STALE_HOURS) -> DataFrame:
    """New alerts without a sighting for ``hours`` become resolved."""
    stale = (F.col("status") == "new") & (F.col("last_seen") < as_of - F.make_interval(hours=F.lit(hours)))
    return alerts.withColumn("_stale", F.coalesce(stale, F.lit(False))).withColumns({
        "status": F.when(F.col("_stale"), F.lit("resolved")).otherwise(F.col("status")),
        "resolution_comment": F.when(F.col("_stale"), F.lit(AUTO_RESOLVE_COMMENT)),
    }).drop("_stale")


def at_least(severity: Column, lowest: str) -> Column:
    """Severity rank test as a list of names, which parquet can filter on."""
    return severity.isin(SEVERITIES[SEVERITIES.index(lowest):])
