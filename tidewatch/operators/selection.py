"""Rows and values at a given place of a group's order, without putting the group in order.

A group is cut into cells along the order. Counts of cells and their running
totals, a small table, say which cell holds a place; only rows of one cell are
ever compared with each other. So a group that holds most rows is spread over
its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.basic import all_of, floor_div
from ..session import stored

CELLS = 4096


def same_keys(left: list[str], right: list[str]) -> Column:
    """Equality of keys in which null equals null."""
    return all_of([F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def with_place(rows: DataFrame, keys: list[str], at: Column, cell_size: int, order: list[str], output: str,
               first: int | None = None, last: int | None = None) -> DataFrame:
    """Adds ``output``, a row's place (from 1) in the order of its group, keeping only places
    from ``first`` to ``last``.

    ``at`` is a whole number that grows along ``order``; rows whose numbers agree
    after division by ``cell_size`` are one cell. Cells that lie outside the wanted places
    are left out before anything is sorted.
    """
    marked = rows.withColumn("_cell", floor_div(at, cell_size))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = marked.groupBy(*keys, "_cell").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    wanted = [F.col("_upto") >= first] if first else []
    if last:
        wanted.append(F.col("_upto") - F.col("_n") < last)
    named = [f"_{key}" for key in keys]
    cells = cells.where(all_of(wanted)).select(
        *[F.col(key).alias(name) for key, name in zip(keys, named)], F.col("_cell").alias("_at"),
        (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    placed = marked.join(cells, same_keys([*keys, "_cell"], [*named, "_at"])) \
        .withColumn(output, F.col("_before") + F.row_number().over(inside)).drop("_cell", "_at", "_before", *named)
    if first:
        placed = placed.where(F.col(output) >= first)
    return placed.where(F.col(output) <= last) if last else placed


def values_at(counted: DataFrame, keys: list[str], value: str, count: str, ranks: dict[str, Column],
              passes: int = 2, cells: int = CELLS) -> DataFrame:
    """(keys, ``_size``, one column for each of ``ranks``): a group's value at a rank (from 0).

    ``counted`` has each value of a group once with its count; ranks may use ``_size``, the
    group's total. Every pass cuts what is left of a group into ``cells`` between
    its least and greatest value and keeps the cells that hold a wanted rank. Only after
    the last pass are the values of a cell put in order.
    """
    asked = [f"_rank_{name}" for name in ranks]
    sizes = counted.groupBy(*keys).agg(F.sum(count).alias("_size"))
    # The scope of a value is the cell it lies in so far; ``_base`` counts what lies before the scope.
    sizes = stored(sizes.withColumns(dict(zip(asked, ranks.values()))), "sizes")
    wanted = sizes.select(*[F.col(key).alias(f"_{key}") for key in keys], F.array(*asked).alias("_wanted"))
    named = [f"_{key}" for key in keys]
    left = counted.where(F.col(count) > 0).select(*keys, value, count, F.lit("").alias("_scope"), F.lit(0).cast("long").alias("_base"))
    for _ in range(passes):
        left = stored(left, "values")
        ends = left.groupBy(*keys, "_scope").agg(F.min(value).alias("_low"), F.max(value).alias("_high")).select(
            *[F.col(key).alias(name) for key, name in zip(keys, named)], F.col("_scope").alias("_in"), "_low", "_high")
        # A scope of one value is one cell; rounding can move a value to a neighbouring cell, never out of order.
        share = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
        cell = F.when(F.col("_high") > F.col("_low"), F.floor(share * (cells - 1)).cast("int")).otherwise(F.lit(0))
        marked = left.join(ends, same_keys([*keys, "_scope"], [*named, "_in"])).withColumn("_cell", cell) \
            .drop(*named, "_in", "_low", "_high")
        upto = Window.partitionBy(*keys, "_scope").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = marked.groupBy(*keys, "_scope", "_cell").agg(F.sum(count).alias("_n"), F.max("_base").alias("_base")) \
            .withColumn("_upto", F.col("_base") + F.sum("_n").over(upto))
        holds = F.exists("_wanted", lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")))
        kept = totals.join(wanted, same_keys(keys, named)).where(holds).select(
            *named, F.col("_scope").alias("_in"), F.col("_cell").alias("_at"), (F.col("_upto") - F.col("_n")).alias("_before"))
        left = marked.drop("_base").join(kept, same_keys([*keys, "_scope", "_cell"], [*named, "_in", "_at"])).select(
            *keys, value, count, F.concat_ws("/", "_scope", F.col("_cell").cast("string")).alias("_scope"),
            F.col("_before").alias("_base"))
    inside = Window.partitionBy(*keys, "_scope").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumnsRenamed(dict(zip(keys, named)))
    placed = left.withColumn("_upto", F.col("_base") + F.sum(count).over(inside)).join(sizes, same_keys(keys, named))
    here = lambda rank: (F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col(count))
    found = placed.groupBy(*keys).agg(*[F.min(F.when(here(rank), F.col(value))).alias(name) for rank, name in zip(asked, ranks)])
    # A group without a value has a size of 0 and no value at any rank.
    return sizes.join(found, same_keys(named, keys), "left").select(
        *[F.col(name).alias(key) for key, name in zip(keys, named)], "_size", *ranks)
