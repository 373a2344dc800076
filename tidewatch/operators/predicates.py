"""The fifteen rule predicates as two-valued columns.

Every leaf is true or false, never null, so negation is safe. Null checks are
written as ``isNotNull AND test`` instead of ``coalesce`` because Catalyst can
push that form down to the parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.basic import any_of, number_or_null
from .fields import Field

_NUMBER = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def as_number(value) -> float | int | None:
    """Rule value as a number, or None when it does not read as one."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return value
    text = str(value).replace(",", "").strip()
    return float(text) if _NUMBER.match(text) else None


def as_text(value) -> str:
    if isinstance(value, bool):
        return "True" if value else "False"
    return str(value)


def numeric(field: Field) -> Column:
    return field.column if field.kind == "number" else number_or_null(field.column)


def two_valued(subject: Column, test: Column) -> Column:
    return subject.isNotNull() & test


def _fold(column: Column, text: str, case_sensitive: bool) -> tuple[Column, Column]:
    return (column, F.lit(text)) if case_sensitive else (F.lower(column), F.lit(text.lower()))


def equals(field: Field, value, case_sensitive: bool = True) -> Column:
    if value is None:
        return field.column.isNull()
    if field.kind == "missing":
        return F.lit(False)
    number = as_number(value)
    left, right = _fold(field.text, as_text(value), case_sensitive)
    if number is None:
        return two_valued(field.text, left == right)
    if field.kind == "number":
        return two_valued(field.column, field.column == F.lit(number))
    parsed = numeric(field)
    return two_valued(field.text, F.when(parsed.isNotNull(), parsed == F.lit(float(number)))
                      .otherwise(left == right))


def is_in(field: Field, values, case_sensitive: bool = True) -> Column:
    if values is None or field.kind == "missing":
        return F.lit(False)
    members = list(values) if isinstance(values, (list, tuple, set)) else [values]
    members = ["" if member is None else member for member in members]
    numbers = [as_number(m) for m in members if as_number(m) is not None]
    texts = [as_text(m) if case_sensitive else as_text(m).lower() for m in members]
    words = [t for m, t in zip(members, texts) if as_number(m) is None]
    text = field.text if case_sensitive else F.lower(field.text)
    if field.kind == "number":
        tests = ([field.column.isin(numbers)] if numbers else []) + ([text.isin(words)] if words else [])
        return two_valued(field.column, any_of(tests))
    if not numbers:
        return two_valued(field.text, text.isin(texts))
    parsed = numeric(field)
    as_numeric = parsed.isin([float(n) for n in numbers])
    if words:
        as_numeric = as_numeric | text.isin(words)
    return two_valued(field.text, F.when(parsed.isNotNull(), as_numeric).otherwise(text.isin(texts)))


def _text_test(test: Callable[[Column, Column], Column]):
    def build(field: Field, value, case_sensitive: bool = True) -> Column:
        if value is None or field.kind == "missing":
            return F.lit(False)
        left, right = _fold(field.text, as_text(value), case_sensitive)
        return two_valued(field.text, test(left, right))
    return build


contains = _text_test(lambda left, right: F.contains(left, right))
starts_with = _text_test(lambda left, right: F.startswith(left, right))
ends_with = _text_test(lambda left, right: F.endswith(left, right))


def _order_test(test: Callable[[Column, Column], Column]):
    def build(field: Field, value, case_sensitive: bool = True) -> Column:
        number = as_number(value)
        if number is None or field.kind == "missing":
            return F.lit(False)
        left = numeric(field)
        return two_valued(left, test(left, F.lit(number)))
    return build


greater_than = _order_test(lambda left, right: left > right)
greater_than_or_equal = _order_test(lambda left, right: left >= right)
less_than = _order_test(lambda left, right: left < right)
less_than_or_equal = _order_test(lambda left, right: left <= right)


def matches_regex(field: Field, value, case_sensitive: bool = False) -> Column:
    """Unanchored and always case-insensitive; a broken pattern matches nothing."""
    if value is None or field.kind == "missing" or not valid_regex(as_text(value)):
        return F.lit(False)
    return two_valued(field.text, field.text.rlike(f"(?i){as_text(value)}"))


def valid_regex(pattern: str) -> bool:
    """Checked by the JVM that will run it, since dialects differ."""
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - PatternSyntaxException arrives as a gateway error
        return False
    return True


def _negated(build):
    return lambda field, value, case_sensitive=True: ~build(field, value, case_sensitive)


PREDICATES = {
    "equals": equals,
    "not_equals": _negated(equals),
    "contains": contains,
    "not_contains": _negated(contains),
    "starts_with": starts_with,
    "ends_with": ends_with,
    "greater_than": greater_than,
    "greater_than_or_equal": greater_than_or_equal,
    "less_than": less_than,
    "less_than_or_equal": less_than_or_equal,
    "in": is_in,
    "not_in": _negated(is_in),
    "regex": matches_regex,
    "exists": lambda field, value=None, case_sensitive=True: field.column.isNotNull(),
    "not_exists": lambda field, value=None, case_sensitive=True: field.column.isNull(),
}


def predicate(field: Field, operator: str, value=None, case_sensitive: bool = True,
              negate: bool = False) -> Column:
    test = PREDICATES[operator](field, value, case_sensitive)
    return ~test if negate else test
