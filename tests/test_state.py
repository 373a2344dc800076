"""Ordered per-key operators against plain Python, with one hot key."""
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.model import ALERT_STATUSES, STATUS_MOVES
from tidewatch.operators import alerts as A
from tidewatch.operators.periods import fixed_periods, following_time, rolling_totals, running_totals
from tidewatch.operators.risk import user_profiles

EPOCH = datetime(2024, 1, 1)


def seconds(value):
    return (value.replace(tzinfo=timezone.utc) - EPOCH.replace(tzinfo=timezone.utc)).total_seconds()


@pytest.fixture(scope="module")
def rows():
    """A third of all rows belong to one key, many at the same instant."""
    random.seed(11)
    made = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{random.randrange(25)}"
        at = random.choice([random.randrange(200_000), random.randrange(50) * 1000])
        made.append((i, key, at + random.choice([0, 0, 0.25]), random.randrange(1, 9)))
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, k, EPOCH + timedelta(seconds=s), v) for i, k, s, v in rows],
                                 "id int, key string, ts timestamp_ntz, v int").cache()


def by_key(rows):
    groups = defaultdict(list)
    for i, key, at, value in rows:
        groups[key].append((at, i, value))
    return {key: sorted(group) for key, group in groups.items()}


@pytest.mark.parametrize("block_windows", [1, 3, 24])
def test_rolling_totals(frame, rows, block_windows):
    found = rolling_totals(frame, ["key"], F.col("ts"), 3000, {
        "n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))},
        block_windows).collect()
    got = {(r.key, seconds(r["at"])): (r.n, r.s, r.lo, r.hi) for r in found}
    want = {}
    for key, group in by_key(rows).items():
        for at, _, _ in group:
            inside = [v for t, _, v in group if at - 3000 <= t <= at]
            want[key, at] = (len(inside), sum(inside), min(inside), max(inside))
    assert got == want and len(found) == len(want)


@pytest.mark.parametrize("ttl", [60, 3600, 40_000])
def test_fixed_periods(frame, rows, small_batches, ttl):
    found = fixed_periods(frame, "key", F.col("ts"), ttl, F.col("id"), F.struct("ts", "id")).collect()
    want = set()
    for key, group in by_key(rows).items():
        opened = None
        for at, i, _ in group:
            if opened is None or int(at) >= opened[0] + ttl:
                if opened:
                    want.add((key, *opened[1:]))
                opened = (int(at), i, at, at, 0)
            opened = (*opened[:3], at, opened[4] + 1)
        want.add((key, *opened[1:]))
    assert {(r.key, r["first"], seconds(r.first_seen), seconds(r.last_seen), r.n) for r in found} == want


def test_running_totals(frame, rows):
    gap = 9000
    found = running_totals(frame, "key", F.col("ts"), "id", F.col("v"), gap, block_seconds=5000).collect()
    got = {r.id: r.running for r in found}
    want = {}
    for group in by_key(rows).values():
        total, last = 0, None
        for at, i, value in group:
            total = value if last is not None and at - last >= gap else total + value
            last = at
            want[i] = total
    assert got == want
    with pytest.raises(ValueError):
        running_totals(frame, "key", F.col("ts"), "id", F.col("v"), 10, block_seconds=100)


def test_following_time(frame, rows):
    found = following_time(frame, ["key"], "ts", ["id"], "next", block_seconds=4000).collect()
    got = {r.id: None if r.next is None else seconds(r.next) for r in found}
    want = {}
    for group in by_key(rows).values():
        for here, there in zip(group, group[1:] + [None]):
            want[here[1]] = there[0] if there else None
    assert got == want


def test_user_profiles_cap_and_forget(spark):
    day = lambda n, h=0: EPOCH + timedelta(days=n, hours=h)
    rows = [(1, "a", day(0)), (2, "a", day(6)), (3, "a", day(13)), (4, "a", day(13, 1)), (5, "b", day(0)), (6, "", day(0))]
    events = spark.createDataFrame(rows, "event_id int, username string, ts timestamp_ntz") \
        .withColumn("event_type", F.lit("x"))
    profile = lambda points, as_of: {
        r.username: (r.score, r.event_count) for r in user_profiles(events, F.lit(points), as_of).collect()}
    # Event 3 comes exactly seven days after event 2: the record has expired.
    assert profile(4.0, None) == {"a": (8.0, 2), "b": (4.0, 1)}
    assert profile(40.0, None)["a"] == (50.0, 2)
    assert profile(4.0, F.lit(day(13, 2)).cast("timestamp_ntz")) == {"a": (8.0, 2)}


@pytest.mark.parametrize("chunk", [1, 500, 10_000_000])
def test_transitions_with_a_hot_alert(spark, small_batches, chunk):
    random.seed(chunk)
    alerts = [(i, random.choice(ALERT_STATUSES)) for i in range(12)]
    commands = [(0 if n % 3 == 0 else random.randrange(13), random.randrange(3000), n,
                 random.choice(ALERT_STATUSES + ["no_such_status"]), random.random() < 0.1) for n in range(300)]
    frame = spark.createDataFrame([(a, EPOCH + timedelta(seconds=s), n, w, f) for a, s, n, w, f in commands],
                                  "alert_id int, at timestamp_ntz, seq int, new_status string, force boolean")
    table = spark.createDataFrame(alerts, "alert_id int, status string")
    found = A.apply_transitions(table, frame, chunk).collect()
    want, state = {}, dict(alerts)
    for alert, _, n, wanted, force in sorted(commands, key=lambda c: (c[0], c[1], c[2])):
        if alert not in state:
            continue
        old = state[alert]
        ok = wanted in ALERT_STATUSES and (force or wanted == old or wanted in STATUS_MOVES[old])
        state[alert] = wanted if ok else old
        want[n] = (old, ok, state[alert])
    assert {r.seq: (r.old_status, r.accepted, r.status) for r in found} == want
    final = {r.alert_id: r.status for r in A.alert_states(table, A.apply_transitions(table, frame, chunk)).collect()}
    assert final == state


def test_dedup_key_matches_its_recipe(spark):
    import hashlib
    row = spark.range(1).select(
        A.dedup_key(F.lit("r"), F.lit("1.2.3.4:99"), F.lit("5.6.7.8")).alias("a"),
        A.dedup_key(F.lit("r"), F.lit(""), F.lit(None).cast("string")).alias("b")).first()
    digest = lambda text: "dedup:" + hashlib.sha256(text.encode()).hexdigest()
    assert row.a == digest("r:1.2.3.4:5.6.7.8") and row.b == digest("r:unknown:unknown")


def test_percentiles_count_values_and_ignore_nulls(spark):
    import numpy as np

    from tidewatch.operators.rollups import latency_percentiles

    values = [5, 5, 5, 1, 9, 9, 2, None, 40]
    rows = [("a", datetime(2024, 1, 1), v) for v in values] + [("b", datetime(2024, 1, 1), None)]
    samples = spark.createDataFrame(rows, "service string, ts timestamp, v int")
    got = {r.service: (r.p50, r.p95, r.p99) for r in latency_percentiles(samples, "service", "v").collect()}
    want = np.percentile([v for v in values if v is not None], [50, 95, 99])
    assert got["a"] == pytest.approx(tuple(want)) and got["b"] == (None, None, None)


def test_groups_of_a_rule_become_alerts(spark):
    from tidewatch.operators.alerts import create_alerts, create_group_alerts

    at = datetime(2024, 1, 1)
    groups = spark.createDataFrame([("g", "10.0.0.1", 7, 7.5, at, at + timedelta(minutes=5), "r", "Rule", "high", 3)],
                                   "group_key string, group_ip string, event_count bigint, aggregated_value double, "
                                   "first_seen timestamp, last_seen timestamp, rule_id string, rule_name string, "
                                   "severity string, first_event_id int")
    alert = create_group_alerts(groups, source="group_ip")
    row = alert.first()
    assert (row.status, row.source, row.destination, row.aggregation_count, row.aggregated_value) == \
        ("new", "10.0.0.1", None, 7, 7.5)
    assert row.triggered_at == row.created_at == at + timedelta(minutes=5) and '"group_key":"g"' in row.context
    match = spark.createDataFrame([("r", "Rule", "low", at, "10.0.0.1", None, 1)],
                                  "rule_id string, rule_name string, rule_severity string, ts timestamp, "
                                  "source_ip string, destination_ip string, event_id int")
    assert set(create_alerts(match).columns) == set(alert.columns)


def test_rates_held_above_a_ceiling(spark):
    from tidewatch.operators.rollups import held_above

    base = datetime(2024, 1, 1)
    rows = [(base + timedelta(minutes=m), float(m in (1, 2, 3, 6, 8, 9))) for m in range(12)]
    rates = spark.createDataFrame(rows, "step_start timestamp, rate double")
    runs = {((r.held_from - base).seconds // 60, (r.held_until - base).seconds // 60)
            for r in held_above(rates, "rate", 0.5, 120).collect()}
    assert runs == {(1, 4), (8, 10)}
