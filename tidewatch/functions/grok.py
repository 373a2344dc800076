"""Named-group extraction in a single regex pass per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEPARATOR = "\x01"
# How a separator inside the text is written while the groups are joined.
_ESCAPES = [("\x02", "\x02\x03"), ("\x01", "\x02\x04")]


def group_names(pattern: str) -> list[str]:
    return re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern)


def grok_parts(text: Column, pattern: str) -> Column:
    """Array of all named groups in pattern order; one element when unmatched.

    The whole text is rewritten to ``group1 SEP group2 SEP ...`` and split, so
    ten groups cost one regex run, not ten ``regexp_extract`` calls.
    """
    has_separator = F.contains(text, F.lit(_SEPARATOR))
    escaped = text
    for sign, code in _ESCAPES:
        escaped = F.replace(escaped, F.lit(sign), F.lit(code))

    def plain(part: Column) -> Column:
        for sign, code in reversed(_ESCAPES):
            part = F.replace(part, F.lit(code), F.lit(sign))
        return part

    return F.when(has_separator, F.transform(_rewritten(escaped, pattern), plain)).otherwise(_rewritten(text, pattern))


def _rewritten(text: Column, pattern: str) -> Column:
    whole = rf"(?is)^(?:{pattern[1:]}).*$" if pattern.startswith("^") else rf"(?is)^.*?(?:{pattern}).*$"
    rewritten = F.regexp_replace(text, whole, _SEPARATOR.join(f"${{{n}}}" for n in group_names(pattern)))
    return F.split(rewritten, _SEPARATOR)


def grok_fields(parts: Column, pattern: str) -> dict[str, Column]:
    """Named groups of an already computed ``grok_parts`` array, null where the
    group is empty or nothing matched."""
    names = group_names(pattern)
    matched = F.size(parts) == len(names)
    return {
        name: F.when(matched, F.nullif(F.get(parts, F.lit(i)), F.lit("")))
        for i, name in enumerate(names)
    }


def grok_extract(frame: DataFrame, text: Column, pattern: str, stage: str) -> tuple[DataFrame, dict[str, Column]]:
    """Named groups of ``text`` and the frame that carries them.

    The array of groups becomes the column ``stage``, so the regex runs once per
    row however many groups are read; unread stages are pruned.
    """
    names = group_names(pattern)
    if len(names) == 1:
        # One group alone cannot be told from an unmatched text by its part count.
        frame = frame.withColumn(stage, F.regexp_extract(text, f"(?i){pattern}", 1))
        return frame, {names[0]: F.nullif(F.col(stage), F.lit(""))}
    return frame.withColumn(stage, grok_parts(text, pattern)), grok_fields(F.col(stage), pattern)
