"""Text cleaning, limits and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EVENT_BYTES = 65536
MAX_FIELD_CHARS = 10000

# Control characters other than tab, line feed and carriage return.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"

# What is masked must stay the same, the bar among the last letters included.
_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"@([A-Za-z0-9.-])[A-Za-z0-9.-]*\.([A-Z|a-z]{2,})\b"
LONG_EMAIL = rf"\b({_LOCAL}){_LOCAL}+({_LOCAL}){_DOMAIN}"
SHORT_EMAIL = rf"\b{_LOCAL}{{1,2}}{_DOMAIN}"

URL_TOKEN = r"(https?://\S+|www\.\S+)"


def clean_ascii(text: Column) -> Column:
    """Printable ASCII only."""
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def sanitize_ascii(text: Column, max_length: int = 255) -> Column:
    """Printable ASCII only, cut at ``max_length``."""
    return F.left(clean_ascii(text), F.lit(max_length))


def sanitize(text: Column, max_length: int = MAX_FIELD_CHARS) -> Column:
    return F.left(F.regexp_replace(text, CONTROL_CHARS, ""), F.lit(max_length))


def has_control_chars(text: Column) -> Column:
    return text.rlike(CONTROL_CHARS)


def mask_email(text: Column) -> Column:
    """``joanna@corp.example.org`` becomes ``j***a@c***@***org``.

    A local part of one or two characters is hidden whole. Texts without an
    ``@`` are passed on without running the patterns.
    """
    masked = F.regexp_replace(text, LONG_EMAIL, "$1***$2@$3***@***$4")
    masked = F.regexp_replace(masked, SHORT_EMAIL, "***@$1***@***$2")
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)


def find_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL_TOKEN), F.lit(1))
