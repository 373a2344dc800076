"""Detection rules compiled to columns.

A rule is a plain dict (the JSON form). Compiling happens once on the driver;
afterwards a rule is only Spark expressions, so one pass over the events
evaluates the whole rule set inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import all_of, any_of, empty_map
from ..model import EVENT_TYPE_ALIASES, EVENT_TYPES, RULE_SEVERITIES
from .fields import EventFields, merge_maps, normalize_key
from .predicates import PREDICATES, as_number, as_text, equals, numeric, predicate

# Words a rule may use.
AGGREGATIONS = ["count", "sum", "average", "min", "max", "time_window"]
TIME_UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
OPERATOR_SHORTHAND = {
    "gt": "greater_than", "gte": "greater_than_or_equal", "lt": "less_than", "lte": "less_than_or_equal",
}
_STORED_TYPE = {name.replace("_", ""): name for name in EVENT_TYPES}
_STORED_TYPE |= {alias.replace("_", ""): name for alias, name in EVENT_TYPE_ALIASES.items()}


class RuleError(ValueError):
    """A rule that cannot be compiled; ``problems`` lists every reason."""

    def __init__(self, rule_id: str, problems: list[str]):
        super().__init__(f"rule {rule_id}: " + "; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class CompiledRule:
    id: str
    name: str
    severity: str
    enabled: bool
    event_types: frozenset[str] | None  # None: every type can match
    trigger: Column
    conditions: list[tuple[str, Column]]
    aggregation: dict[str, Any] | None = None
    source: dict[str, Any] = field(default_factory=dict)

    @property
    def match(self) -> Column:
        if not self.enabled:
            return F.lit(False)
        return self.trigger & all_of([test for _, test in self.conditions])


# ------------------------------------------------------------------- compiling
def stored_event_type(name: str) -> str | None:
    return _STORED_TYPE.get(normalize_key(name).replace("_", ""))


def check_rule(rule: dict) -> list[str]:
    """Every reason a rule would be refused."""
    problems = [f"missing {key}" for key in ("id", "name") if not rule.get(key)]
    if str(rule.get("severity", "")).lower() not in RULE_SEVERITIES:
        problems.append(f"unknown severity {rule.get('severity')!r}")
    for condition in rule.get("conditions") or []:
        if not str(condition.get("field") or "").strip():
            problems.append("condition without a field")
        if condition.get("operator") not in PREDICATES:
            problems.append(f"unknown operator {condition.get('operator')!r}")
    aggregation = rule.get("aggregation")
    if aggregation:
        if aggregation.get("type") not in AGGREGATIONS:
            problems.append(f"unknown aggregation {aggregation.get('type')!r}")
        if aggregation.get("size", 0) < 0:
            problems.append("negative window size")
        if aggregation.get("unit") is not None and aggregation["unit"] not in TIME_UNITS:
            problems.append(f"unknown time unit {aggregation['unit']!r}")
        having = aggregation.get("having")
        if having and having.get("operator") not in PREDICATES:
            problems.append(f"unknown having operator {having.get('operator')!r}")
    return problems


def compile_rule(rule: dict, fields: EventFields) -> CompiledRule:
    problems = check_rule(rule)
    if problems:
        raise RuleError(rule.get("id", "?"), problems)
    triggers = rule.get("triggers") or []
    return CompiledRule(
        id=rule["id"], name=rule["name"], severity=rule["severity"].lower(), enabled=rule.get("enabled", True),
        event_types=trigger_types(triggers), trigger=trigger_column(triggers, fields),
        conditions=[condition_column(c, fields) for c in rule.get("conditions") or []],
        aggregation=rule.get("aggregation"), source=rule,
    )


def compile_v2_rule(rule: dict, fields: EventFields) -> CompiledRule:
    """A second-format rule: what it is called comes from the conversion, what it matches from its own
    trigger and condition, all source types included."""
    converted = convert_v2_rule(rule)
    problems = check_rule(converted)
    if problems:
        raise RuleError(rule.get("id", "?"), problems)
    wanted = (rule.get("trigger") or {}).get("source_types") or []
    stored = [stored_event_type(name) for name in wanted]
    by_type = bool(wanted) and None not in stored and "source_type" not in fields.types
    condition = rule.get("condition") or {}
    test = v2_condition(condition, fields)
    return CompiledRule(
        id=converted["id"], name=converted["name"], severity=converted["severity"], enabled=converted["enabled"],
        event_types=frozenset(stored) if by_type else None, trigger=v2_trigger(rule.get("trigger") or {}, fields),
        conditions=[(condition_column(c, fields)[0], test) for c in converted["conditions"]],
        aggregation=condition.get("aggregation"), source=rule)


def compile_rules(rules: list[dict], fields: EventFields) -> tuple[list[CompiledRule], list[RuleError]]:
    """Compile a set; a rule that is refused does not stop the others."""
    compiled, refused = [], []
    for rule in rules:
        try:
            compiled.append((compile_v2_rule if "condition" in rule else compile_rule)(rule, fields))
        except RuleError as error:
            refused.append(error)
    return compiled, refused


def trigger_types(triggers: list[dict]) -> frozenset[str] | None:
    """Stored event types the triggers can match, None when unrestricted."""
    events = [t for t in triggers if t.get("type", "event") == "event"]
    if not triggers or any(not (t.get("eventType") or "").strip() for t in events):
        return None
    return frozenset(filter(None, (stored_event_type(t["eventType"]) for t in events)))


def trigger_column(triggers: list[dict], fields: EventFields) -> Column:
    """No triggers match everything; otherwise any event trigger may match."""
    if not triggers:
        return F.lit(True)
    options = []
    for trigger in triggers:
        if trigger.get("type", "event") != "event":
            continue
        tests = []
        wanted = (trigger.get("eventType") or "").strip()
        if wanted:
            stored = stored_event_type(wanted)
            tests.append(equals(fields.resolve("event_type"), stored) if stored else F.lit(False))
        for name, value in (trigger.get("filters") or {}).items():
            tests.append(F.lit(False) if value is None
                         else equals(fields.resolve(name), value, case_sensitive=False))
        options.append(all_of(tests))
    return any_of(options)


def condition_column(condition: dict, fields: EventFields) -> tuple[str, Column]:
    value = condition.get("value")
    test = predicate(fields.resolve(condition["field"]), condition["operator"], value,
                     condition.get("caseSensitive", True), condition.get("negate", False))
    label = f"{condition['field']} {condition['operator']}"
    if value is not None:
        label += " " + (",".join(as_text(v) for v in value) if isinstance(value, (list, tuple)) else as_text(value))
    return label, test


# ---------------------------------------------------------------- stateless use
def match_rule(events: DataFrame, rule: CompiledRule) -> DataFrame:
    """Events that satisfy one rule."""
    return events.filter(rule.match)


def match_rules(events: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """One row per (event, matching rule), in a single pass over the events.

    Aggregating rules say nothing about one event and are left out; ``run_rules`` evaluates both kinds.

    Rules are grouped by trigger type, so an event is only tested against rules
    that could fire for its type; events of types no rule names are dropped by
    a filter that reaches the scan.
    """
    rules = [rule for rule in rules if rule.enabled and not rule.aggregation]
    if not rules:
        return events.withColumns({c: F.lit(None).cast("string") for c in RULE_COLUMNS}).filter(F.lit(False))
    matched = tested_by_type(events, rules, [F.lit(position) for position in range(len(rules))], "_rule")
    literal = lambda values: F.get(F.array(*map(F.lit, values)), F.col("_rule"))
    return matched.withColumns({
        "rule_id": literal([rule.id for rule in rules]),
        "rule_name": literal([rule.name for rule in rules]),
        "rule_severity": literal([rule.severity for rule in rules]),
    }).drop("_rule")


RULE_COLUMNS = ["rule_id", "rule_name", "rule_severity"]


def tested_by_type(events: DataFrame, rules: list[CompiledRule], found: list[Column], output: str) -> DataFrame:
    """One row per (event, rule that matches it), with what ``found`` says of that rule as ``output``.

    An event is only tested against the rules of its type.
    """
    typed = frozenset().union(*(rule.event_types or frozenset() for rule in rules))
    if all(rule.event_types is not None for rule in rules):
        events = events.filter(F.col("event_type").isin(sorted(typed)))
    hits = None
    for event_type in sorted(typed):
        able = _hit_array(rules, found, event_type)
        is_type = F.col("event_type") == event_type
        hits = F.when(is_type, able) if hits is None else hits.when(is_type, able)
    untyped = _hit_array(rules, found, None)
    hits = untyped if hits is None else hits.otherwise(untyped)
    return events.withColumn(output, F.explode(hits))


def _hit_array(rules: list[CompiledRule], found: list[Column], event_type: str | None) -> Column:
    """What is found of the rules that match an event of this type."""
    hits = [F.when(rule.match, entry) for rule, entry in zip(rules, found)
            if rule.event_types is None or event_type in rule.event_types]
    # A lambda is evaluated outside whole-stage code, whose methods would grow with the rules.
    return F.filter(F.array(*(hits or [F.when(F.lit(False), found[0])])), lambda entry: entry.isNotNull())


def matched_conditions(rule: CompiledRule) -> Column:
    """Labels of the satisfied conditions, up to the first that fails."""
    tests = [test for _, test in rule.conditions]
    if not tests:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[
        F.when(all_of(tests[: i + 1]), F.lit(label)) for i, (label, _) in enumerate(rule.conditions)
    ]))


def match_context(fields: EventFields) -> Column:
    """Alert context: addresses, time, type, all metadata, prefixed enrichment."""
    text = lambda path: fields.resolve(path).text
    context = F.create_map(
        F.lit("sourceIp"), text("source_ip"), F.lit("destinationIp"), text("destination_ip"),
        F.lit("timestamp"), text("timestamp"), F.lit("eventType"), text("event_type"),
    )
    if "metadata" in fields.types:
        context = merge_maps(context, F.coalesce(F.col("metadata"), empty_map()))
    if "enrichment" in fields.types:
        context = merge_maps(context, F.transform_keys(
            F.coalesce(F.col("enrichment"), empty_map()), lambda k, v: F.concat(F.lit("enrichment."), k)))
    return context


# ------------------------------------------------------------ second rule format
def v2_match(rule: dict, fields: EventFields, strict: bool = False) -> Column:
    """Trigger and basic condition of a second-format rule.

    Comparison ignores case and reads null as the empty string. ``strict``
    keeps to the source types alone and ignores the trigger's ``match`` values.
    """
    if not rule.get("enabled", True):
        return F.lit(False)
    return v2_trigger(rule.get("trigger") or {}, fields, strict) & v2_condition(rule.get("condition") or {}, fields)


def v2_trigger(trigger: dict, fields: EventFields, strict: bool = False) -> Column:
    wanted = [name.lower() for name in trigger.get("source_types") or []]
    tests = []
    if wanted:
        stored = [stored_event_type(name) or name for name in wanted]
        options = [equals(fields.resolve("event_type"), name, False) for name in stored]
        if not strict and "source_type" in fields.types:
            options += [F.lower(F.col("source_type")) == name for name in wanted]
        tests.append(any_of(options))
    if not strict:
        tests += [equals(fields.resolve(name), value, False) for name, value in (trigger.get("match") or {}).items()]
    return all_of(tests)


def v2_condition(condition: dict, fields: EventFields) -> Column:
    if not condition.get("field") or condition.get("aggregation"):
        return F.lit(True)
    operator, value = condition.get("operator", "equals").lower(), condition.get("value")
    field_ = fields.resolve(condition["field"])
    if value is None:
        return {"exists": field_.column.isNotNull(), "not_exists": field_.column.isNull()}.get(operator, F.lit(False))
    left = F.coalesce(F.upper(field_.text), F.lit(""))
    right = as_text(value).upper() if not isinstance(value, (list, tuple)) else None
    if operator in ("in", "not_in"):
        if right is not None:
            return F.lit(False)
        listed = left.isin([as_text(v).upper() for v in value])
        return listed if operator == "in" else ~listed
    if right is None:
        return F.lit(False)
    orders = {
        "greater_than": lambda a, b: a > b, "greater_than_or_equal": lambda a, b: a >= b,
        "less_than": lambda a, b: a < b, "less_than_or_equal": lambda a, b: a <= b,
    }
    if operator in orders:
        compare, number = orders[operator], as_number(value)
        as_words = compare(left, F.lit(right))
        if number is None:
            return as_words
        parsed = numeric(field_)
        return F.when(parsed.isNotNull(), compare(parsed, F.lit(number))).otherwise(as_words)
    texts = {
        "equals": left == right, "not_equals": left != right,
        "contains": F.contains(left, F.lit(right)), "not_contains": ~F.contains(left, F.lit(right)),
        "starts_with": F.startswith(left, F.lit(right)), "ends_with": F.endswith(left, F.lit(right)),
    }
    return texts.get(operator, F.lit(False))


def convert_v2_rule(rule: dict) -> dict:
    """A second-format rule rewritten in the first format."""
    trigger, condition = rule.get("trigger") or {}, rule.get("condition") or {}
    severity = str(rule.get("severity", "")).lower()
    source_types = trigger.get("source_types") or []
    converted = {
        "id": rule["id"], "name": rule.get("name", rule["id"]), "enabled": rule.get("enabled", True),
        "severity": severity if severity in RULE_SEVERITIES else "medium",
        "triggers": [{"type": "event", "eventType": source_types[0] if source_types else "",
                      "filters": dict(trigger.get("match") or {})}],
        "conditions": [],
        "metadata": rule.get("metadata") or {},
    }
    if condition.get("field"):
        converted["conditions"].append({
            "field": condition["field"], "operator": v2_operator(condition.get("operator", "equals")),
            "value": condition.get("value"),
        })
    return converted


def v2_operator(name: str) -> str:
    name = OPERATOR_SHORTHAND.get(name.lower(), name.lower())
    return name if name in PREDICATES else "equals"


def v2_group_value(group_by: str | None, fields: EventFields) -> Column:
    """Counter key of an event: the field, ``unknown`` without it, or ``default``."""
    if not group_by:
        return F.lit("default")
    return F.coalesce(fields.resolve(group_by).text, F.lit("unknown"))
