"""Pages of a long list, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import epoch_micros, floor_div

SHALLOW = 10_000  # rows that a task may hold for a page
CELLS = 4096


def rows_at(rows: DataFrame, order: list[Column], at: str, offset: int, size: int) -> DataFrame:
    """``size`` rows from ``offset`` of ``rows`` in an ``order`` that begins with the time ``at``, newest first.

    A page near the top is a top-k, of which every task holds as much as the
    page asks for. A deeper one is looked up: the time line is cut into cells, their counts
    say which of them hold the page, and again inside these, until what is left
    is as short as a shallow page; only those rows are read and put in order.
    """
    offset, size = max(offset, 0), max(size, 0)
    if offset + size <= SHALLOW:
        return rows.orderBy(*order).offset(offset).limit(size)
    micros = epoch_micros(F.col(at))
    low, high, missing, n = rows.agg(F.min(micros), F.max(micros), F.count_if(F.col(at).isNull()), F.count("*")).first()
    if missing or n <= offset:  # a row without a time has no cell
        return rows.orderBy(*order).offset(offset).limit(size)
    before = 0  # rows newer than ``high``
    moment = lambda value: F.timestamp_micros(F.lit(value)).cast(rows.schema[at].dataType)
    while high > low and n > SHALLOW + size:
        width = (high - low) // CELLS + 1
        inside = rows.where((F.col(at) >= moment(low)) & (F.col(at) <= moment(high)))
        counts = inside.groupBy(floor_div(micros - low, width).alias("cell")).agg(F.count("*").alias("n")).collect()
        newest = sorted(((cell, count) for cell, count in counts), reverse=True)
        upto, wanted = before, []
        for cell, count in newest:
            if upto + count > offset and upto < offset + size:
                wanted.append((cell, upto, count))
            upto += count
        if not wanted:
            break
        before, n = wanted[0][1], sum(count for _, _, count in wanted)
        low, high = low + wanted[-1][0] * width, min(high, low + wanted[0][0] * width + width - 1)
        if width == 1:  # one instant cannot be cut
            break
    found = rows.where((F.col(at) >= moment(low)) & (F.col(at) <= moment(high)))
    return found.orderBy(*order).offset(offset - before).limit(size)
