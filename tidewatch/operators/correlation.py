"""Aggregation rules: windows, groups, having."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import case_map, epoch_micros, epoch_seconds, floor_div
from ..session import stored
from .fields import EventFields, normalize_key
from .periods import fixed_periods, rolling_totals
from .predicates import as_number, numeric
from .rules import (TIME_UNITS, CompiledRule, match_rule, match_rules, tested_by_type, v2_group_value, v2_match,
                    v2_operator)
from .selection import CELLS, with_place


# ------------------------------------------------------------------ first format
def window_seconds(aggregation: dict) -> int | None:
    size, unit = aggregation.get("size") or 0, TIME_UNITS.get(aggregation.get("unit", ""))
    return size * unit if size > 0 and unit else None


def trailing_window(matched: DataFrame, ts: Column, seconds: int | None) -> DataFrame:
    """Matched events no older than ``seconds`` before the newest matched one.

    The newest time is a scalar subquery, so the bound is pushed to the scan
    like a literal; there is no join.
    """
    if seconds is None:
        return matched
    newest = matched.agg(F.max(ts).alias("newest"))
    bound = newest.select(F.col("newest") - F.make_interval(secs=F.lit(seconds))).scalar()
    return matched.filter(ts >= bound)


def group_key(fields: EventFields, group_by: list[str] | None) -> Column:
    """Group values joined by ``|``; a missing value reads ``null``."""
    if not group_by:
        return F.lit("all")
    return F.concat_ws("|", *[F.coalesce(fields.resolve(name).text, F.lit("null")) for name in group_by])


def measure(fields: EventFields, name: str) -> Column:
    """Numeric value of a field; missing or unreadable counts as zero."""
    return F.coalesce(numeric(fields.resolve(name)).cast("double"), F.lit(0.0))


def aggregate_value(fields: EventFields, aggregation: dict) -> Column:
    name = (aggregation.get("having") or {}).get("field") or "count"
    builders = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}
    build = builders.get(aggregation.get("type"))
    return build(measure(fields, name)) if build else F.count("*").cast("double")


def having_column(having: dict | None, value: Column) -> Column:
    if not having:
        return value > 0
    wanted = having.get("value")
    members = [float(n) for n in map(as_number, wanted if isinstance(wanted, (list, tuple)) else [wanted])
               if n is not None]
    bound = float(as_number(wanted) or 0) if not isinstance(wanted, (list, tuple)) else 0.0
    tests = {
        "greater_than": value > bound, "greater_than_or_equal": value >= bound,
        "less_than": value < bound, "less_than_or_equal": value <= bound,
        "equals": value == bound, "not_equals": value != bound,
        "in": value.isin(members) if members else F.lit(False),
        "not_in": ~value.isin(members) if members else F.lit(True),
        "exists": value > 0, "not_exists": value <= 0,
    }
    return tests.get(having.get("operator"), F.lit(False))


def group_columns(fields: EventFields, group_by: list[str] | None) -> dict[str, Column]:
    return {normalize_key(name.split(".")[-1]): fields.resolve(name).column for name in group_by or []}


def aggregate_rule(events: DataFrame, rule: CompiledRule, fields: EventFields,
                   tiebreak: str = "event_id") -> DataFrame:
    """All groups of an aggregation rule that satisfy its having clause.

    One hash aggregate with map-side partials: a hot group reaches its reducer
    as one row per task, whatever its size.
    """
    aggregation = rule.aggregation or {}
    inside = trailing_window(match_rule(events, rule), fields.ts, window_seconds(aggregation))
    groups = group_columns(fields, aggregation.get("groupBy"))
    keyed = inside.withColumn("group_key", group_key(fields, aggregation.get("groupBy")))
    result = keyed.groupBy("group_key").agg(
        *[F.first(column, ignorenulls=True).alias(f"group_{name}") for name, column in groups.items()],
        F.count("*").alias("event_count"),
        aggregate_value(fields, aggregation).alias("aggregated_value"),
        F.min(fields.ts).alias("first_seen"),
        F.max(fields.ts).alias("last_seen"),
        F.min(F.struct(fields.ts.alias("ts"), F.col(tiebreak).alias("id"))).alias("_first"),
    )
    return (
        result.filter(having_column(aggregation.get("having"), F.col("aggregated_value")))
        .withColumns({"rule_id": F.lit(rule.id), "rule_name": F.lit(rule.name), "severity": F.lit(rule.severity),
                      "first_event_id": F.col("_first.id")})
        .drop("_first")
    )


def first_group(groups: DataFrame) -> DataFrame:
    """Only the satisfying group that was seen first."""
    return groups.orderBy("first_seen", "first_event_id").limit(1)


def rolling_rule(events: DataFrame, rule: CompiledRule, fields: EventFields) -> DataFrame:
    """Every instant at which a group's trailing window satisfies the rule."""
    aggregation = rule.aggregation or {}
    seconds = window_seconds(aggregation)
    if seconds is None:
        raise ValueError("a rolling rule needs a window")
    name = (aggregation.get("having") or {}).get("field") or "count"
    kind = {"sum": "sum", "average": "sum", "min": "min", "max": "max"}.get(aggregation.get("type"), "count")
    value = F.lit(1) if kind == "count" else measure(fields, name)
    matched = match_rule(events, rule).withColumn("group_key", group_key(fields, aggregation.get("groupBy")))
    totals = rolling_totals(matched, ["group_key"], fields.ts, seconds, {
        "event_count": ("count", F.lit(1)), "aggregated_value": (kind, value)})
    if aggregation.get("type") == "average":
        totals = totals.withColumn("aggregated_value", F.col("aggregated_value") / F.col("event_count"))
    totals = totals.withColumn("aggregated_value", F.col("aggregated_value").cast("double"))
    return totals.filter(having_column(aggregation.get("having"), F.col("aggregated_value"))) \
        .withColumn("rule_id", F.lit(rule.id))


# ----------------------------------------------------------------- second format
def v2_value(rule: dict, fields: EventFields, strict: bool = False) -> Column:
    """Aggregate of a second-format rule; ``strict`` always counts."""
    spec = rule["condition"]["aggregation"]
    function = "count" if strict else (spec.get("function") or "count").lower()
    if function == "count":
        return F.count("*").cast("double")
    if function in ("distinct", "count_distinct", "distinct_count"):
        return F.count_distinct(fields.resolve(spec["field"]).text).cast("double")
    builders = {"sum": F.sum, "avg": F.avg, "average": F.avg, "min": F.min, "max": F.max}
    return builders[function](measure(fields, spec["field"]))


def v2_having(rule: dict, value: Column, strict: bool = False) -> Column:
    condition = rule["condition"]
    operator = "greater_than_or_equal" if strict else v2_operator(condition.get("operator") or "gte")
    return having_column({"operator": operator, "value": condition.get("value")}, value)


def v2_keyed(events: DataFrame, rule: dict, fields: EventFields, strict: bool = False) -> DataFrame:
    """Matching events with their counter key and tumbling window number."""
    spec = rule["condition"]["aggregation"]
    return events.filter(v2_match(rule, fields, strict)).withColumns({
        "group_value": v2_group_value(spec.get("group_by"), fields),
        "window_id": floor_div(epoch_seconds(fields.ts), int(spec["window_seconds"])),
    })


def tumbling_rule(events: DataFrame, rule: dict, fields: EventFields, strict: bool = False) -> DataFrame:
    """One row per counter and tumbling window that reaches the threshold."""
    seconds = int(rule["condition"]["aggregation"]["window_seconds"])
    counted = v2_keyed(events, rule, fields, strict).groupBy("group_value", "window_id").agg(
        F.count("*").alias("event_count"), v2_value(rule, fields, strict).alias("aggregated_value"),
        F.min(fields.ts).alias("first_seen"), F.max(fields.ts).alias("last_seen"))
    return counted.filter(v2_having(rule, F.col("aggregated_value"), strict)).withColumns({
        "rule_id": F.lit(rule["id"]), "window_start": F.timestamp_seconds(F.col("window_id") * seconds)})


def tumbling_fires(events: DataFrame, rule: dict, fields: EventFields, tiebreak: str = "event_id",
                   strict: bool = False) -> DataFrame:
    """Every event at or past the threshold of its counter and window.

    A counter's window is cut into time cells; only cells that reach the
    threshold are read for their events, and only a cell's events are put in order.
    """
    threshold = max(int(float(rule["condition"]["value"])), 1)
    window = int(rule["condition"]["aggregation"]["window_seconds"])
    keyed = v2_keyed(events, rule, fields, strict).withColumn("_ts", fields.ts)
    fired = with_place(keyed, ["group_value", "window_id"], epoch_micros(fields.ts), max(1, window * 1_000_000 // CELLS),
                       ["_ts", tiebreak], "_place", first=threshold)
    return fired.drop("_ts", "_place").withColumn("rule_id", F.lit(rule["id"]))


def expiring_counters(events: DataFrame, rule: dict, fields: EventFields, ttl_seconds: int = 3600,
                      tiebreak: str = "event_id", strict: bool = False) -> DataFrame:
    """Counters that live ``ttl_seconds`` from their first increment."""
    keyed = v2_keyed(events, rule, fields, strict).withColumn(
        "counter", F.concat_ws(":", F.lit(rule["id"]), "group_value", F.col("window_id").cast("string")))
    lives = fixed_periods(keyed, "counter", fields.ts, ttl_seconds,
                          first=F.struct("group_value", "window_id"), order=F.col(tiebreak))
    return lives.select("counter", "first.group_value", "first.window_id", F.col("n").alias("event_count"),
                        "first_seen", "last_seen",
                        F.timestamp_seconds(F.unix_seconds("opened_at") + ttl_seconds).alias("expires_at"))


# ------------------------------------------------------------------- both kinds
_KINDS = {"count": "count", "sum": "sum", "avg": "average", "average": "average", "min": "min", "max": "max",
          "distinct": "distinct", "count_distinct": "distinct", "distinct_count": "distinct"}


def aggregate_rules(events: DataFrame, rules: list[CompiledRule], fields: EventFields,
                    event_id: str = "event_id") -> DataFrame:
    """All groups that satisfy the aggregating ones among ``rules``, in the columns of ``aggregate_rule``.

    Every event is read once, whatever the number of rules: it gives a narrow
    row for each rule that it matches, and one aggregate with map-side partials
    folds them by rule, group and window. The window of the first format is
    trailing; its end, one time for each rule, is read off the stored narrow rows, so
    such rules cost one write of what they match. Rules of the second format
    have tumbling windows. What a rule asks of its groups is looked up by the
    rule's number, so the plan does not grow with the set.
    """
    rules = [rule for rule in rules if rule.enabled and rule.aggregation]
    specs = [_spec(rule, fields) for rule in rules]
    if not rules:
        kinds = [("group_key", "string"), ("event_count", "long"), ("aggregated_value", "double"),
                 ("first_seen", events.select(fields.ts).dtypes[0][1]), ("last_seen", events.select(fields.ts).dtypes[0][1]),
                 ("rule_id", "string"), ("rule_name", "string"), ("severity", "string"),
                 ("first_event_id", dict(events.dtypes)[event_id])]
        return events.filter(F.lit(False)).select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds])
    entries = [F.struct(F.lit(number).alias("rule"), spec["group"].alias("group_key"), spec["window"].alias("window"),
                        spec["value"].alias("value"), spec["item"].alias("item")) for number, spec in enumerate(specs)]
    rows = tested_by_type(events, rules, entries, "_hit").select("_hit.*", fields.ts.alias("ts"), F.col(event_id).alias("id"))
    trailing = {number: spec["seconds"] for number, spec in enumerate(specs) if spec["seconds"]}
    if trailing:
        rows = stored(rows, "rule-matches")
        newest = rows.where(F.col("rule").isin(list(trailing))).groupBy("rule").agg(
            F.max(epoch_micros(F.col("ts"))).alias("newest")).collect()
        since = {rule: at - trailing[rule] * 1_000_000 for rule, at in newest if at is not None}
        bound = F.get(F.array(*[F.lit(since.get(number)).cast("long") for number in range(len(rules))]), F.col("rule"))
        rows = rows.where(~F.col("rule").isin(list(trailing)) | (epoch_micros(F.col("ts")) >= bound))

    # Values are told apart before they are counted, where a rule counts different ones; elsewhere the item is null.
    parts = rows.groupBy("rule", "group_key", "window", "item").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min(F.struct("ts", "id")).alias("first"))
    groups = parts.groupBy("rule", "group_key", "window").agg(
        F.sum("n").alias("event_count"), F.sum("total").alias("total"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.count("item").alias("items"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.min("first").alias("first"))
    of_rule = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("rule"))
    count = F.col("event_count").cast("double")
    value = case_map(of_rule([spec["kind"] for spec in specs], "string"), {
        "sum": F.col("total"), "average": F.col("total") / count, "min": F.col("least"), "max": F.col("most"),
        "distinct": F.col("items").cast("double")}, count)
    wanted = [_wanted(spec["having"]) for spec in specs]
    members = F.get(F.array(*[F.array(*map(F.lit, w[2])).cast("array<double>") for w in wanted]), F.col("rule"))
    satisfied = _satisfied(F.col("aggregated_value"), of_rule([w[0] for w in wanted], "string"),
                           of_rule([w[1] for w in wanted], "double"), members)
    return groups.withColumn("aggregated_value", value).where(satisfied).select(
        "group_key", "event_count", "aggregated_value", "first_seen", "last_seen",
        of_rule([rule.id for rule in rules], "string").alias("rule_id"),
        of_rule([rule.name for rule in rules], "string").alias("rule_name"),
        of_rule([rule.severity for rule in rules], "string").alias("severity"), F.col("first.id").alias("first_event_id"))


def _spec(rule: CompiledRule, fields: EventFields) -> dict:
    """Group, window, value and having of an aggregating rule of either format."""
    nothing = F.lit(None)
    if "condition" in rule.source:
        condition = rule.source["condition"]
        spec = condition["aggregation"]
        kind, having = _KINDS[(spec.get("function") or "count").lower()], {
            "operator": v2_operator(condition.get("operator") or "gte"), "value": condition.get("value")}
        group, name, seconds = v2_group_value(spec.get("group_by"), fields), spec.get("field"), None
        window = floor_div(epoch_seconds(fields.ts), int(spec["window_seconds"]))
    else:
        spec = rule.aggregation
        having, seconds, window = spec.get("having"), window_seconds(spec), nothing.cast("long")
        kind = _KINDS.get(spec.get("type"), "count") if spec.get("type") in ("sum", "average", "min", "max") else "count"
        group, name = group_key(fields, spec.get("groupBy")), (having or {}).get("field") or "count"
    return {"kind": kind, "having": having, "group": group, "seconds": seconds, "window": window,
            "value": measure(fields, name) if kind in ("sum", "average", "min", "max") else nothing.cast("double"),
            "item": fields.resolve(name).text if kind == "distinct" else nothing.cast("string")}


def _wanted(having: dict | None) -> tuple[str, float, list[float]]:
    """Operator, bound and members of a having clause; without one, a value above zero is enough."""
    if not having:
        return "greater_than", 0.0, []
    value = having.get("value")
    many = isinstance(value, (list, tuple))
    members = [float(n) for n in map(as_number, value if many else [value]) if n is not None]
    return having.get("operator") or "", 0.0 if many else float(as_number(value) or 0), members


def _satisfied(value: Column, operator: Column, bound: Column, members: Column) -> Column:
    """``having_column`` with operator, bound and members in columns."""
    return case_map(operator, {
        "greater_than": value > bound, "greater_than_or_equal": value >= bound, "less_than": value < bound,
        "less_than_or_equal": value <= bound, "equals": value == bound, "not_equals": value != bound,
        "in": F.array_contains(members, value), "not_in": ~F.array_contains(members, value),
        "exists": value > 0, "not_exists": value <= 0}, False)


def run_rules(events: DataFrame, rules: list[CompiledRule], fields: EventFields, event_id: str = "event_id") -> DataFrame:
    """What a mixed set of rules finds, each rule by the evaluator of its kind.

    A rule without an aggregation gives a row for each event that matches it.
    An aggregating rule gives a row for each group that satisfies it: over the
    trailing window for the first format, for each tumbling window for the second.
    Events are read once for each of the two kinds.
    """
    ts = fields.ts
    once = match_rules(events, rules).select(
        "rule_id", "rule_name", F.col("rule_severity").alias("severity"), F.col(event_id).cast("string").alias("event_id"),
        F.lit(None).cast("string").alias("group_key"), ts.alias("first_seen"), ts.alias("last_seen"),
        F.lit(1).cast("long").alias("event_count"), F.lit(None).cast("double").alias("aggregated_value"))
    groups = aggregate_rules(events, rules, fields, event_id).select(
        "rule_id", "rule_name", "severity", F.lit(None).cast("string").alias("event_id"), "group_key", "first_seen",
        "last_seen", "event_count", "aggregated_value")
    return once.unionByName(groups)
