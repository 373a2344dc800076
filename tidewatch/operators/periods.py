"""Ordered per-key state over time, safe for keys that hold much of the data.

Building blocks that rules, alerts, risk profiles and health checks share:

* ``rolling_totals``  trailing-window sums at every event time of a key
* ``running_totals``  sums from the start of a key's stretch up to each event
* ``following_time``  time of a key's next row
* ``fixed_periods``   first event of a key opens a period of fixed length
* ``asof_value``      the value that a key had at a row's time
* ``neighbours``      times before and after each row of one time line

None of them ever gathers all rows of a key. Rows are first folded to one per
(key, instant) by a map-side aggregate, then a key is cut along time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.basic import epoch_micros, epoch_seconds, floor_div
from ..session import stored


def rolling_totals(events: DataFrame, keys: list[str], ts: Column, window_seconds: int,
                   totals: dict[str, tuple[str, Column]], block_windows: int | None = None) -> DataFrame:
    """Totals over ``[t - window, t]`` for every key and every event time ``t``.

    ``totals`` maps an output name to ("count" | "sum" | "min" | "max", value).
    Each key is cut into blocks of ``block_windows`` windows; only events in
    the last window of a block are copied into the next block, so the copy
    costs 1/block_windows of the rows and a hot key spreads over all blocks. By
    default a block is as many windows as an hour holds, one at least.
    """
    block_windows = block_windows or max(1, 3600 // window_seconds)
    span = window_seconds * 1_000_000
    block = span * block_windows
    fold = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    instants = (
        events.withColumn("_at", epoch_micros(ts))
        .groupBy(*keys, "_at")
        .agg(*[fold[kind](value).alias(name) for name, (kind, value) in totals.items()])
    )
    own = floor_div(F.col("_at"), block)
    is_tail = (F.col("_at") - own * block) >= block - span
    spread = instants.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))))
    trailing = Window.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(-span, 0)
    return (
        spread
        .withColumns({name: again[kind](name).over(trailing) for name, (kind, _) in totals.items()})
        .filter(F.col("_own") == F.col("_block"))
        .select(*keys, F.timestamp_micros("_at").alias("at"), *totals)
    )


def fixed_periods(events: DataFrame, key: str, ts: Column, ttl_seconds: int,
                  first: Column, order: Column) -> DataFrame:
    """The first event of a key opens a period of ``ttl_seconds``; later events
    inside it are counted to it and do not extend it; the next event after its
    end opens another.

    Time is counted in whole seconds. Rows are folded to one per second, and
    those stay with their key's time block. Which seconds open a period is
    sequential by nature, but needs no rows: a key's blocks send the seconds at
    which something happened, at most one short number each, and get back the
    openings. So a key that holds most events is spread over all its blocks.
    ``first`` is what to keep of the opening event, the smallest by ``order``. Events
    without a time belong to no period.
    """
    # A block meets few openings, however short a period is.
    block = min(3600, 64 * ttl_seconds)
    folded = (
        events.withColumn("_sec", epoch_seconds(ts)).where(F.col("_sec").isNotNull())
        .groupBy(key, "_sec")
        .agg(F.count("*").alias("_n"), F.max(ts).alias("_last"),
             F.min_by(first, order).alias("_first"), F.min(ts).alias("_start"))
    )
    blocks = folded.groupBy(key, floor_div(F.col("_sec"), block).alias("_block")).agg(
        F.collect_list(F.struct("_sec", "_n", "_last", "_first", "_start")).alias("_rows"))
    begin = F.col("_block") * block
    seconds = blocks.select(key, "_block", F.array_sort(
        F.transform("_rows", lambda row: (row["_sec"] - begin).cast("short"))).alias("_seconds"))
    schema = T.StructType([T.StructField("_key", blocks.schema[key].dataType), T.StructField("_at", T.LongType()),
                           T.StructField("_openings", T.ArrayType(T.LongType()))])
    openings = seconds.repartition(key).sortWithinPartitions(key, "_block").mapInArrow(
        _openings(ttl_seconds, block), schema)
    # Null-safe on both sides: an inferred null test would make this branch's exchange another one than the openings'.
    spread = blocks.join(openings, blocks[key].eqNullSafe(openings["_key"]) & F.col("_block").eqNullSafe(F.col("_at"))) \
        .select(key, "_openings", F.inline("_rows"))
    opened = F.array_max(F.filter("_openings", lambda opening: opening <= F.col("_sec")))
    return (
        spread.groupBy(key, opened.alias("_opened"))
        .agg(F.sum("_n").alias("n"), F.min("_start").alias("first_seen"), F.max("_last").alias("last_seen"),
             F.min_by("_first", "_sec").alias("first"))
        .withColumn("opened_at", F.timestamp_seconds("_opened"))
        .drop("_opened")
    )


def _openings(ttl: int, block_seconds: int):
    """For each block of a key, in order: the last opening before it and those inside it."""
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, blocks, seconds = batch.columns
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = blocks.to_numpy() * block_seconds
            inside = seconds.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(seconds.value_lengths().to_numpy(zero_copy_only=False))
            found = []
            for row, (begin, end) in enumerate(zip([0, *ends[:-1]], ends)):
                if row == 0 or codes[row] != codes[row - 1]:
                    name = keys[row].as_py()
                    if row or name != current:
                        current, opened = name, None
                own, at = inside[begin:end], 0
                openings = [] if opened is None else [opened]
                if opened is not None:
                    at = int(np.searchsorted(own, opened + ttl - starts[row]))
                while at < len(own):
                    opened = int(starts[row]) + int(own[at])
                    openings.append(opened)
                    at += int(np.searchsorted(own[at:], opened + ttl - starts[row]))
                found.append(openings)
            yield pa.RecordBatch.from_arrays([keys, blocks, pa.array(found, pa.list_(pa.int64()))],
                                             names=["_key", "_at", "_openings"])
    return chain


def running_totals(events: DataFrame, key: str, ts: Column, tiebreak: str, value: Column,
                   gap_seconds: int, block_seconds: int = 3600) -> DataFrame:
    """``running``: sum of ``value`` up to each event since the key's last silence
    of ``gap_seconds`` or more. Also adds ``stretch``, the number of that stretch.

    Blocks shorter than the gap cannot hide one, so stretches are found on the
    small table of block totals; inside a block an ordinary window adds up.
    """
    if block_seconds > gap_seconds:
        raise ValueError("a block must not be longer than the gap")
    marked = events.withColumns({
        "_at": epoch_micros(ts), "_value": value,
        "_block": floor_div(epoch_micros(ts), block_seconds * 1_000_000),
    })
    blocks = block_stretches(
        marked.groupBy(key, "_block").agg(
            F.min("_at").alias("_start"), F.max("_at").alias("_end"), F.sum("_value").alias("_sum")),
        key, gap_seconds)
    before = Window.partitionBy(key, "stretch").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(key, "_block", "stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy("_at", tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [key, "_block"])
        .withColumn("running", F.col("_before") + F.col("_inside"))
        .drop("_at", "_value", "_block", "_inside", "_before")
    )


def block_stretches(blocks: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Number the stretches of each key over its blocks (``_start``, ``_end`` in
    microseconds): a new one begins after a silence of ``gap_seconds`` or more."""
    in_order = Window.partitionBy(key).orderBy("_block")
    silence = F.col("_start") - F.lag("_end").over(in_order)
    return blocks.withColumn("_new", F.coalesce((silence >= gap_seconds * 1_000_000).cast("int"), F.lit(0))) \
        .withColumn("stretch", F.sum("_new").over(in_order)).drop("_new")


def following_time(rows: DataFrame, keys: list[str], ts: str, tiebreak: list[str], output: str,
                   block_seconds: int = 3600) -> DataFrame:
    """Adds the time of the same key's next row, null for the last.

    Looked up inside a key's time block; only the last row of a block needs the
    first time of the next block, which comes from the table of blocks.
    """
    marked = rows.withColumn("_block", floor_div(epoch_seconds(F.col(ts)), block_seconds))
    block_order = Window.partitionBy(*keys).orderBy("_block")
    blocks = marked.groupBy(*keys, "_block").agg(F.min(ts).alias("_first")) \
        .withColumn("_next_block", F.lead("_first").over(block_order)).drop("_first")
    inside = Window.partitionBy(*keys, "_block").orderBy(ts, *tiebreak)
    return marked.withColumn("_next", F.lead(ts).over(inside)).join(blocks, [*keys, "_block"]) \
        .withColumn(output, F.coalesce("_next", "_next_block")).drop("_block", "_next", "_next_block")


_TIME_RANGE = 1 << 36  # seconds on either side of 1970 that a time line can cover, some 2000 years


def neighbours(rows: DataFrame, ts: str, tiebreak: list[str] | None = None, block_seconds: int = 86400,
               fan: int = 2048) -> DataFrame:
    """Adds ``previous`` and ``next``: the times before and after each row of one time line.

    A tree of time blocks with one root: a row looks inside its block, a block
    inside its parent, and what lies beyond an end comes from the level above. No level puts
    more than ``fan`` rows, or those of one block, in order; a line by days has two levels. The rows are
    stored, for each level reads the one below.
    """
    place = floor_div(epoch_seconds(F.col(ts)) + _TIME_RANGE, block_seconds)
    marked = stored(rows.withColumn("_0", place), "time-line")

    def beside(table: DataFrame, parent: str, order: list[str], first: str, last: str) -> DataFrame:
        window = Window.partitionBy(parent).orderBy(*order)
        return table.withColumns({"_before": F.lag(last).over(window), "_after": F.lead(first).over(window)})

    levels, blocks = 0, -(-2 * _TIME_RANGE // block_seconds)
    while blocks > 1:
        levels, blocks = levels + 1, -(-blocks // fan)
    tables, first, last = [], ts, ts
    for level in range(levels):
        below = tables[-1] if tables else marked
        tables.append(below.groupBy(f"_{level}").agg(F.min(first).alias("_first"), F.max(last).alias("_last"))
                      .withColumn(f"_{level + 1}", floor_div(F.col(f"_{level}"), fan)))
        first, last = "_first", "_last"
    above = None
    for level in reversed(range(levels)):
        found = beside(tables[level], f"_{level + 1}", [f"_{level}"], "_first", "_last")
        found = found.withColumns({"_sooner": F.col("_before"), "_later": F.col("_after")}) if above is None else \
            found.join(above, f"_{level + 1}").withColumns({
                "_sooner": F.coalesce("_before", "_sooner"), "_later": F.coalesce("_after", "_later")})
        above = found.select(f"_{level}", "_sooner", "_later")
    return beside(marked, "_0", [ts, *(tiebreak or [])], ts, ts).join(above, "_0").withColumns({
        "previous": F.coalesce("_before", "_sooner"), "next": F.coalesce("_after", "_later")}) \
        .drop("_0", "_before", "_after", "_sooner", "_later")


def asof_value(rows: DataFrame, changes: DataFrame, key: str, ts: str, changed_at: str, value: str, output: str,
               for_seconds: int | None = None, block_seconds: int = 86400) -> DataFrame:
    """Adds ``output``: the latest ``value`` that ``changes`` gives the row's key up to its time, null
    without one or, with ``for_seconds``, if it is that old.

    Both sides meet by key and time block, so a key that holds most rows is spread over its
    blocks; what an earlier block left is carried over the small table of blocks. Of
    changes at one instant the greatest value counts. Rows without a key get null.
    """
    at = lambda column: epoch_micros(F.col(column))
    block = lambda column: floor_div(epoch_seconds(F.col(column)), block_seconds)
    payload = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    known = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), block(changed_at).alias("_block"),
                                                          at(changed_at).alias("_at")).agg(F.max(value).alias("_value"))
    # A row without a key belongs to no key's block, and is dealt out.
    asked = rows.select(F.col(key).alias("_key"), F.coalesce(
        F.when(F.col(key).isNotNull(), block(ts)), F.xxhash64(F.col(ts))).alias("_block"), at(ts).alias("_at"),
        payload.alias("_row"))
    found = F.struct(F.col("_at").alias("at"), F.col("_value").alias("value"))
    both = asked.withColumn("_found", F.lit(None).cast(known.select(found).schema[0].dataType)).unionByName(
        known.select("_key", "_block", "_at", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), found.alias("_found")))
    ends = known.groupBy("_key", "_block").agg(F.max(found).alias("_end")).unionByName(
        asked.where(F.col("_key").isNotNull()).select("_key", "_block", F.lit(None).cast(
            known.select(found).schema[0].dataType).alias("_end")).distinct()) \
        .groupBy("_key", "_block").agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"),
                          F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    # At one instant a change comes before the rows that ask for it.
    inside = Window.partitionBy("_key", "_block").orderBy("_at", F.col("_row").isNotNull()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = both.withColumn("_latest", F.last("_found", ignorenulls=True).over(inside)).where(F.col("_row").isNotNull()) \
        .join(carried, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b")), "left") \
        .withColumn("_latest", F.when(F.col("_key").isNotNull(), F.coalesce("_latest", "_carried")))
    fresh = F.lit(True) if for_seconds is None else F.col("_at") - F.col("_latest.at") < for_seconds * 1_000_000
    return latest.select("_row.*", F.when(fresh, F.col("_latest.value")).alias(output))
