"""Small helpers every other module uses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction; true without conditions."""
    return reduce(and_, conditions or [F.lit(True)])


def any_of(conditions: Sequence[Column]) -> Column:
    """Disjunction; false without conditions."""
    return reduce(or_, conditions or [F.lit(False)])


def case_map(key: Column, table: Mapping, default=None) -> Column:
    """CASE over a small fixed table."""
    branches = None
    for name, value in table.items():
        branches = F.when(key == F.lit(name), F.lit(value)) if branches is None \
            else branches.when(key == F.lit(name), F.lit(value))
    return branches.otherwise(default if isinstance(default, Column) else F.lit(default))


def rank_of(name: Column, ordered: list[str]) -> Column:
    """Position of a stored enumeration value, null for anything else."""
    return case_map(F.lower(name), {value: rank for rank, value in enumerate(ordered)})


def name_of(rank: Column, ordered: list[str]) -> Column:
    return case_map(rank, dict(enumerate(ordered)))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def floor_div(value: Column, size: int) -> Column:
    """Exact integer division rounding down (``/`` would go through doubles)."""
    return F.call_function("div", value - F.pmod(value, F.lit(size)), F.lit(size))


def floor_div_by(value: Column, size: Column) -> Column:
    """``floor_div`` by a column."""
    return F.call_function("div", value - F.pmod(value, size), size)


def micros_to_ntz(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def number_or_null(text: Column) -> Column:
    """Loose number reading: outer blanks and thousands commas are allowed."""
    cleaned = F.trim(F.regexp_replace(text.cast("string"), ",", ""))
    return F.when(cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cleaned.try_cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for long expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_per_key(entries: Column) -> Column:
    """Array of (key, value) entries without later repeats of a key."""
    def keep(all_entries: Column) -> Column:
        return let(F.transform(all_entries, lambda e: e["key"]), lambda keys: F.filter(
            all_entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))
    return let(entries, keep)


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")
