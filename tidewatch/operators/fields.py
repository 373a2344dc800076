"""Rule field paths resolved to columns of an event frame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basic import first_per_key, let

# ---------------------------------------------------------------- fixed values
# Rule field names with a meaning of their own: stored column or metadata keys.
COLUMN_FIELDS = [
    "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "event_type", "severity",
    "payload", "device_name", "sensor_id", "source",
]
METADATA_FIELDS = {
    "username": ["username"],
    "failure_reason": ["failure_reason"],
    "process_name": ["process_name"],
    "process_path": ["process_path"],
    "file_path": ["file_path"],
    "user_role": ["user_role"],
    "digital_signature": ["digital_signature"],
    "query_name": ["query_name", "queryName"],
    "queryname": ["queryName", "query_name"],
    "bytes_sent": ["bytes_sent"],
    "bytesent": ["bytes_sent"],
    "bytes_received": ["bytes_received"],
}
TIME_COLUMNS = ["event_timestamp", "ts", "timestamp"]


def normalize_key(name: str) -> str:
    for mark in ".- ":
        name = name.replace(mark, "_")
    return name.strip().lower()


def normalized_key(name: Column) -> Column:
    return F.lower(F.trim(F.translate(name, ".- ", "___")))


def key_variants(key: str) -> list[str]:
    """Spellings of a metadata key, the given one first."""
    base = normalize_key(key)
    pascal = "".join(word[0].upper() + word[1:] for word in base.split("_") if word)
    camel = pascal[:1].lower() + pascal[1:]
    return list(dict.fromkeys([key, base, base.replace("_", ""), camel, pascal]))


@dataclass
class Field:
    """A resolved field: its column and how rule values compare with it."""

    column: Column
    kind: str  # "number", "text", "time" or "missing"

    @cached_property
    def text(self) -> Column:
        return self.column.cast("string")




class EventFields:
    """Resolves rule field paths against the columns of one event frame.

    ``loose_keys`` also finds metadata keys that differ in case, dots, dashes
    or blanks. That walks the whole map for each row, so streams that have run
    ``canonical_metadata`` at ingest switch it off.
    """

    def __init__(self, schema: T.StructType, loose_keys: bool = True):
        self.types = {field.name: field.dataType for field in schema.fields}
        self.loose_keys = loose_keys
        self.time_column = next((name for name in TIME_COLUMNS if name in self.types), None)
        self._resolved: dict[str, Field] = {}

    @property
    def missing(self) -> Field:
        return Field(F.lit(None).cast("string"), "missing")

    @property
    def ts(self) -> Column:
        if self.time_column is None:
            raise ValueError(f"no time column among {sorted(self.types)}")
        return F.col(self.time_column)

    def resolve(self, path: str) -> Field:
        if path not in self._resolved:
            self._resolved[path] = self._resolve(path)
        return self._resolved[path]

    def _resolve(self, path: str) -> Field:
        segments = [part for part in path.split(".") if part]
        if not segments:
            return self.missing
        if len(segments) > 1:
            prefix, rest = normalize_key(segments[0]), ".".join(segments[1:])
            if prefix == "metadata":
                return self._from_map("metadata", [rest])
            if prefix == "enrichment":
                return self._from_map("enrichment", [rest])
            if prefix == "normalized":
                return self.resolve(rest)
        return self._simple(path)

    def _simple(self, name: str) -> Field:
        key = normalize_key(name)
        plain = key.replace("_", "")
        for column in COLUMN_FIELDS:
            if plain == column.replace("_", ""):
                return self._column(column)
        if plain == "timestamp":
            return Field(self.ts, "time")
        if plain == "hourofday":
            return Field(F.hour(self.ts), "number")
        if plain == "dayofweek":
            return Field(F.date_format(self.ts, "EEEE"), "text")
        keys = METADATA_FIELDS.get(key) or next(
            (keys for known, keys in METADATA_FIELDS.items() if known.replace("_", "") == plain), [name])
        found = self._from_map("metadata", keys)
        stored = self._column(key)
        if found.kind == "missing":
            return stored
        if stored.kind == "missing":
            return found
        return Field(F.coalesce(found.column, stored.text), "text")

    def _column(self, name: str) -> Field:
        kind = self.types.get(name)
        if kind is None or isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
            return self.missing
        if isinstance(kind, T.NumericType):
            return Field(F.col(name), "number")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return Field(F.col(name), "time")
        return Field(F.col(name).cast("string"), "text")

    def _from_map(self, column: str, keys: list[str]) -> Field:
        if not isinstance(self.types.get(column), T.MapType):
            return self.missing
        source = F.col(column)
        spellings = list(dict.fromkeys(v for key in keys for v in key_variants(key)))
        found = [F.try_element_at(source, F.lit(spelling)) for spelling in spellings]
        if self.loose_keys:
            wanted = list(dict.fromkeys(normalize_key(spelling) for spelling in spellings))
            found.append(F.get(F.map_values(F.map_filter(
                source, lambda k, v: normalized_key(k).isin(wanted))), F.lit(0)))
        return Field(F.coalesce(*found).cast("string"), "text")


def canonical_metadata(metadata: Column) -> Column:
    """Rewrite metadata keys once at ingest; the first of equal keys is kept."""
    entries = F.transform(F.map_entries(metadata), lambda e: F.struct(
        normalized_key(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(first_per_key(entries))


def merge_maps(*maps: Column) -> Column:
    """One map out of several; a later map wins on equal keys."""
    merged = maps[0]
    for newer in maps[1:]:
        merged = _overlay(merged, newer)
    return merged


def _overlay(older: Column, newer: Column) -> Column:
    def join(over: Column) -> Column:
        return let(F.map_keys(over), lambda keys: F.map_concat(
            F.map_filter(older, lambda k, v: ~F.array_contains(keys, k)), over))
    return let(newer, join)
