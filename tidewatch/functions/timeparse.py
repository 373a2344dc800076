"""Timestamp reading through a list of known spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings, tried in this order.
ACCESS_LOG_FORMATS = ["dd/MMM/yyyy:HH:mm:ss Z", "dd/MMM/yyyy:HH:mm:ss"]
COMMON_FORMATS = ["yyyy-MM-dd HH:mm:ss"]
# What a text must look like to be tried: a spelling that fails costs far more than the look.
SHAPES = {"dd/MMM/yyyy:HH:mm:ss Z": r"^\d{2}/[A-Za-z]{3}/\d{4}:[\d:]+ ", "dd/MMM/yyyy:HH:mm:ss": r"^\d{2}/[A-Za-z]{3}/\d{4}:[\d:]+$",
          "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} [\d:]+$"}
YEARLESS_FORMAT = "yyyy MMM d HH:mm:ss"


def parse_timestamp(text: Column, year: int | Column | None = None) -> Column:
    """UTC timestamp of ``text``, null when no spelling fits.

    Syslog stamps carry no year, so it is passed in; without it they are null.
    """
    trimmed = F.trim(text)
    tries = [F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}T"), trimmed.try_cast("timestamp"))]
    tries += [F.when(trimmed.rlike(SHAPES[fmt]), F.try_to_timestamp(trimmed, F.lit(fmt)))
              for fmt in ACCESS_LOG_FORMATS + COMMON_FORMATS]
    if year is not None:
        stamp = F.concat_ws(" ", (F.lit(year) if isinstance(year, int) else year).cast("string"),
                            F.regexp_replace(trimmed, r"\s+", " "))
        tries.append(F.when(trimmed.rlike(r"^[A-Za-z]{3}\s"), F.try_to_timestamp(stamp, F.lit(YEARLESS_FORMAT))))
    # Free reading last, but only of something that names a full date.
    tries.append(F.when(trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), trimmed.try_cast("timestamp")))
    return F.coalesce(*tries)
