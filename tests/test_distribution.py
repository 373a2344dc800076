"""Operators on keys that hold most rows: results against plain Python, and how the work is spread."""
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.basic import epoch_micros
from tidewatch.operators import alerts as A
from tidewatch.operators import history as HI
from tidewatch.operators.correlation import aggregate_rule, aggregate_rules, tumbling_fires, tumbling_rule
from tidewatch.operators.fields import EventFields
from tidewatch.operators.periods import _openings, asof_value, fixed_periods, neighbours
from tidewatch.operators.rollups import event_rates, held_above, latency_percentiles, silent_stretches
from tidewatch.operators.rules import compile_rules
from tidewatch.operators.selection import with_place
from tidewatch.operators.threat_intel import daily_quota
from tidewatch.session import work_dir

EPOCH = datetime(2024, 1, 1)


def at(seconds):
    return EPOCH + timedelta(seconds=seconds)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# --------------------------------------------------------------------- periods
@pytest.fixture(scope="module")
def heartbeat(spark):
    """A key with 90 % of all rows, one every few seconds over thirty days."""
    rows = [("hot", s) for s in range(0, 30 * 86400, 40)]
    rng = random.Random(2)
    rows += [(f"k{rng.randrange(400)}", rng.randrange(30 * 86400)) for _ in range(len(rows) // 9)]
    return spark.createDataFrame([(k, at(s)) for k, s in rows], "key string, ts timestamp_ntz").cache(), rows


@pytest.mark.parametrize("ttl", [100, 3600, 7 * 86400])
def test_periods_of_a_key_with_most_rows(heartbeat, ttl):
    frame, rows = heartbeat
    found = fixed_periods(frame, "key", F.col("ts"), ttl, F.col("ts"), F.col("ts")).collect()
    seconds = defaultdict(list)
    for key, second in rows:
        seconds[key].append(second)
    want = set()
    for key, group in seconds.items():
        opened = None
        for second in sorted(group):
            if opened is None or second >= opened + ttl:
                opened = second
                want.add((key, at(opened)))
    assert {(r.key, r.first_seen) for r in found} == want and sum(r.n for r in found) == len(rows)


def test_periods_send_seconds_and_not_rows_through_a_key(heartbeat):
    """What reaches the task of the hot key are its blocks: well below a tenth of the rows."""
    frame, rows = heartbeat
    blocks = frame.where("key = 'hot'").select(F.floor(epoch_micros(F.col("ts")) / 3_600_000_000).alias("b")).distinct().count()
    assert blocks < 0.1 * len(rows)
    text = plan(fixed_periods(frame, "key", F.col("ts"), 3600, F.col("ts"), F.col("ts")))
    by_key = [line for line in text.split("\n") if "hashpartitioning(key#" in line and "REPARTITION" in line]
    assert by_key and "_seconds" in text and "_rows" not in by_key[0]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_openings_carry_over_batches(size):
    import pyarrow as pa
    rng = random.Random(size)
    seconds = sorted({rng.randrange(5000) for _ in range(300)})
    blocks = defaultdict(list)
    for second in seconds:
        blocks[second // 100].append(second % 100)
    table = pa.table({"key": ["a"] * len(blocks), "block": list(blocks), "seconds": pa.array(list(blocks.values()), pa.list_(pa.int16()))})
    found = [opening for batch in _openings(70, 100)(iter(table.to_batches(max_chunksize=size)))
             for openings in batch.column(2).to_pylist() for opening in openings]
    want = []
    for second in seconds:
        if not want or second >= want[-1] + 70:
            want.append(second)
    assert sorted(set(found)) == want


def test_value_at_a_rows_time(spark):
    rng = random.Random(5)
    changes = [(rng.choice(["a", "b", "b", "b"]), rng.randrange(400_000), float(rng.randrange(50))) for _ in range(300)]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([rng.randrange(450_000), changes[i % 300][1]])) for i in range(400)]
    left = spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], "id int, key string, ts timestamp_ntz")
    right = spark.createDataFrame([(k, at(s), v) for k, s, v in changes], "key string, since timestamp_ntz, value double")
    for life in (None, 30_000):
        found = {r.id: r.found for r in asof_value(left, right, "key", "ts", "since", "value", "found", life, 20_000).collect()}
        assert len(found) == len(rows)
        for i, key, second in rows:
            known = [(s, v) for k, s, v in changes if k == key and s <= second]
            want = max(known) if known else None
            if want and life and second - want[0] >= life:
                want = None
            assert found[i] == (want[1] if want else None)


def test_neighbours_on_a_time_line(spark):
    rng = random.Random(9)
    times = sorted({rng.choice([rng.randrange(10_000), rng.randrange(40_000_000)]) for _ in range(300)})
    times = [-1_800_000_000, *times]  # before 1970 too
    frame = spark.createDataFrame([(at(s),) for s in times], "ts timestamp_ntz")
    found = neighbours(frame, "ts", block_seconds=3000, fan=300)
    assert "SinglePartition" not in plan(found)
    got = {r.ts: (r.previous, r.next) for r in found.collect()}
    want = {at(s): (at(times[i - 1]) if i else None, at(times[i + 1]) if i + 1 < len(times) else None) for i, s in enumerate(times)}
    assert got == want


def test_runs_and_silences_without_a_single_partition(spark):
    rng = random.Random(4)
    busy = sorted({rng.randrange(400) for _ in range(250)})
    frame = spark.createDataFrame([(at(60 * m + s),) for m in busy for s in range(3)], "ts timestamp_ntz")
    runs = held_above(event_rates(frame, "1 minute", 60, empty=False), "rate", 0.01, 120)
    silent = silent_stretches(frame, "1 minute", 60, 180)
    assert "SinglePartition" not in plan(runs) + plan(silent)
    want_runs, want_silent, start = set(), set(), busy[0]
    for a, b in zip(busy, [*busy[1:], None]):
        if b != a + 1:
            if a + 1 - start >= 2:
                want_runs.add((at(60 * start), at(60 * (a + 1))))
            if b is not None and (b - a - 1) * 60 >= 180:
                want_silent.add((at(60 * (a + 1)), at(60 * b), b - a - 1))
            start = b
    assert {(r.held_from, r.held_until) for r in runs.collect()} == want_runs
    assert {(r.silent_from, r.silent_until, r.steps) for r in silent.collect()} == want_silent


# ------------------------------------------------------------------- selection
def test_threshold_and_quota_beyond_any_group_limit(spark):
    """The 5000th row of a group with most rows, some of them at one instant, and no sort of the group."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 10 else f"k{i % 7}", rng.choice([rng.randrange(86_400), 4000])) for i in range(20_000)]
    frame = spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], "event_id int, source_ip string, ts timestamp_ntz") \
        .withColumn("event_type", F.lit("dns_query"))
    groups = defaultdict(list)
    for i, key, second in rows:
        groups[key].append((second, i))
    rule = {"id": "r", "name": "r", "severity": "low", "trigger": {"source_types": ["dns_query"]}, "condition": {
        "operator": "gte", "value": 5000, "aggregation": {"function": "count", "group_by": "source_ip", "window_seconds": 86400}}}
    fired = tumbling_fires(frame, rule, EventFields(frame.schema))
    want = {i for group in groups.values() for _, i in sorted(group)[4999:]}
    assert {r.event_id for r in fired.select("event_id").collect()} == want and want
    calls = daily_quota(frame.withColumnRenamed("source_ip", "provider"), 5000)
    assert {r.event_id for r in calls.select("event_id").collect()} == {i for g in groups.values() for _, i in sorted(g)[:5000]}
    for text in (plan(fired), plan(calls)):
        windows = [line for line in text.split("\n") if "row_number()" in line]
        assert windows and all("_cell" in line.split("row_number()")[1] for line in windows)


def test_places_of_groups_with_null_keys(spark):
    rows = [(None, 3), (None, 1), ("a", 5), ("a", 2), ("a", 2)]
    frame = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v long, i int")
    found = with_place(frame, ["k"], F.col("v"), 2, ["v", "i"], "place").collect()
    assert {(r.k, r.v, r.i, r.place) for r in found} == {(None, 1, 1, 1), (None, 3, 0, 2), ("a", 2, 3, 1), ("a", 2, 4, 2), ("a", 5, 2, 3)}


@pytest.mark.parametrize("make", [lambda rng: float(rng.randrange(100)), lambda rng: rng.random() ** 9 * 1e12,
                                  lambda rng: rng.choice([1e9, rng.gauss(0, 1), -1e15]), lambda rng: 7.5])
def test_percentiles_without_sorting_a_group(spark, make):
    rng = random.Random(6)
    rows = [("one", make(rng)) for _ in range(4000)] + [("few", make(rng)) for _ in range(3)] + [("none", None)]
    frame = spark.createDataFrame([(s, v, at(5)) for s, v in rows], "s string, v double, ts timestamp_ntz")
    found = latency_percentiles(frame, "s", "v", step="1 day")
    windows = [line for line in plan(found).split("\n") if "windowspecdefinition" in line]
    assert windows and all("_scope" in line for line in windows)
    got = {r.service: (r.p50, r.p95, r.p99) for r in found.collect()}
    for service in ("one", "few"):
        values = [v for s, v in rows if s == service]
        assert got[service] == pytest.approx(tuple(np.percentile(values, [50, 95, 99])), rel=1e-9)
    assert got["none"] == (None, None, None)


# ------------------------------------------------------------------- rule sets
@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(12)
    types = ["dns_query", "http_request", "network_traffic"]
    rows = [(i, at(rng.randrange(9 * 86400)), rng.choice(types), rng.choice(["u1", "u2", "", None]), rng.choice(["1.1.1.1", "2.2.2.2"]),
             rng.randrange(90), rng.randrange(5000)) for i in range(700)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, username string, source_ip string, "
                                       "destination_port int, bytes_sent long").cache()


def rule_dicts():
    rules = []
    for n, kind in enumerate(["count", "sum", "average", "min", "max", "time_window"] * 2):
        rules.append({"id": f"t{n}", "name": f"T{n}", "severity": "high", "enabled": n != 7,
                      "triggers": [{"type": "event", "eventType": "dns_query"}] if n % 3 else [],
                      "conditions": [{"field": "bytes_sent", "operator": "greater_than", "value": 100 * n}],
                      "aggregation": {"type": kind, "groupBy": [["username"], ["username", "source_ip"], None][n % 3],
                                      **({"size": 2, "unit": "days"} if n % 2 else {}),
                                      "having": [None, {"field": "bytes_sent", "operator": "greater_than_or_equal", "value": 20},
                                                 {"field": "bytes_sent", "operator": "in", "value": [3, 41, 4999]},
                                                 {"field": "bytes_sent", "operator": "not_in", "value": [3]},
                                                 {"field": "bytes_sent", "operator": "exists"}][n % 5]}})
    for n, function in enumerate(["count", "sum", "avg", "min", "max", "distinct"]):
        rules.append({"id": f"w{n}", "name": f"W{n}", "severity": "low", "trigger": {"source_types": ["http_request"]},
                      "condition": {"operator": "gte", "value": 3 + n, "aggregation": {
                          "function": function, "field": "destination_port", "group_by": [None, "username"][n % 2],
                          "window_seconds": 86400 * (1 + n)}}})
    return rules


def test_rule_set_finds_what_each_rule_finds(events):
    fields = EventFields(events.schema)
    rules, refused = compile_rules(rule_dicts(), fields)
    assert not refused
    found = aggregate_rules(events, rules, fields)
    got = sorted((r.rule_id, r.group_key, r.event_count, round(r.aggregated_value, 6), r.first_seen, r.last_seen)
                 for r in found.collect())
    want = []
    for rule in rules:
        if "condition" in rule.source:
            groups = tumbling_rule(events, rule.source, fields).withColumn("group_key", F.col("group_value"))
        else:
            groups = aggregate_rule(events, rule, fields)
        want += [(rule.id, r.group_key, r.event_count, round(r.aggregated_value, 6), r.first_seen, r.last_seen)
                 for r in groups.collect()]
    assert got == sorted(want) and len({rule for rule, *_ in got}) > 12
    assert dict(found.dtypes) == dict(aggregate_rule(events, rules[0], fields).drop("group_username").dtypes)


def test_rule_set_reads_events_once(spark, events):
    """A hundred rules, one scan: of the events, or of what the rules stored of them."""
    path = work_dir(spark, "events")
    events.write.parquet(path)
    stored = spark.read.parquet(path)
    fields = EventFields(stored.schema)
    many = [rule | {"id": f"{rule['id']}-{n}"} for n in range(6) for rule in rule_dicts()]
    rules, _ = compile_rules(many, fields)
    assert plan(aggregate_rules(stored, rules, fields)).count("FileScan") == 1
    tumbling = [rule for rule in rules if "condition" in rule.source]
    assert plan(aggregate_rules(stored, tumbling, fields)).count("FileScan") == 1


def test_rule_set_without_aggregating_rules(events):
    fields = EventFields(events.schema)
    rules, _ = compile_rules([{"id": "e", "name": "e", "severity": "low", "conditions": [], "triggers": []}], fields)
    assert aggregate_rules(events, rules, fields).collect() == []


# --------------------------------------------------------------------- history
def test_history_of_batches_is_that_of_one_run(spark):
    rng = random.Random(3)
    names = ["acknowledged", "under_investigation", "resolved", "closed", "false_positive", "pending_score", "odd"]
    alerts = spark.createDataFrame([(i, "new") for i in range(30)], "alert_id int, status string")
    rows = [(rng.randrange(33), at(86400 * rng.randrange(90)), n, rng.choice(names), f"c{n}") for n in range(400)]
    commands = spark.createDataFrame(rows, "alert_id int, at timestamp_ntz, seq int, new_status string, comment string")
    once = A.status_history(A.apply_transitions(alerts, commands)).select("alert_id", "at", "seq", "old_status", "new_status", "comment")
    root = work_dir(spark, "history")
    cuts = [at(0), at(86400 * 20), at(86400 * 55), at(86400 * 100)]
    for number in (0, 1, 1, 2):  # a repeated batch replaces itself
        part = commands.where((F.col("at") >= F.lit(cuts[number])) & (F.col("at") < F.lit(cuts[number + 1])))
        HI.append_batch(root, alerts, part, number)
    stored = HI.read_history(spark, root).select(once.columns)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, once.collect()))
    last = {r.alert_id: r.new_status for r in sorted(once.collect(), key=lambda r: (r.at, r.seq))}
    assert {r.alert_id: r.status for r in HI.read_statuses(root, alerts, 2).collect()} == {i: last.get(i, "new") for i in range(30)}
    some = HI.read_history(spark, root, F.lit(cuts[1]), F.lit(cuts[2]))
    assert some.count() == once.where((F.col("at") >= F.lit(cuts[1])) & (F.col("at") < F.lit(cuts[2]))).count()
    assert "PartitionFilters: [isnotnull(month" in plan(some)


# --------------------------------------------------------------- pages, erasure
@pytest.mark.parametrize("make", [lambda rng: rng.randrange(90 * 86400), lambda rng: rng.choice([5, 5, 5, rng.randrange(10**8)]),
                                  lambda rng: 7])
def test_deep_pages_are_found_by_counts(spark, monkeypatch, make):
    from tidewatch.operators import paging
    monkeypatch.setattr(paging, "SHALLOW", 50)
    monkeypatch.setattr(paging, "CELLS", 16)
    rng = random.Random(8)
    rows = [(i, make(rng)) for i in range(2000)]
    frame = spark.createDataFrame([(i, at(s)) for i, s in rows], "id int, ts timestamp_ntz")
    want = [i for _, i in sorted((-s, i) for i, s in rows)]
    for offset, size in ((0, 20), (40, 30), (700, 25), (1990, 40), (2500, 10)):
        found = paging.rows_at(frame, [F.desc("ts"), F.asc("id")], "ts", offset, size)
        assert [r.id for r in found.collect()] == want[offset:offset + size]
    if len({s for _, s in rows}) > 1000:
        found = paging.rows_at(frame, [F.desc("ts"), F.asc("id")], "ts", 1500, 25)
        read = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Offset" in read and int(read.split("Offset ")[1].split("\n")[0].split()[0]) < 200


def test_pages_of_rows_without_a_time(spark, monkeypatch):
    from tidewatch.operators import paging
    monkeypatch.setattr(paging, "SHALLOW", 5)
    frame = spark.createDataFrame([(i, None if i % 3 else at(i)) for i in range(60)], "id int, ts timestamp_ntz")
    want = [r.id for r in frame.orderBy(F.desc("ts"), F.asc("id")).collect()]
    assert [r.id for r in paging.rows_at(frame, [F.desc("ts"), F.asc("id")], "ts", 30, 10).collect()] == want[30:40]


def test_erasure_touches_only_files_with_a_subject(spark):
    import os
    from tidewatch.operators import privacy as PR
    path = work_dir(spark, "erase")
    rows = spark.createDataFrame([(i, f"user_{i // 10}", "a" if i % 2 else "b") for i in range(200)], "id int, owner string, kind string")
    rows.repartitionByRange(10, "owner").write.partitionBy("kind").parquet(path)
    local = path.removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f.startswith("part-")}
    before = files()
    subjects = spark.createDataFrame([("user_3",), ("user_4",), ("user_4",)], "user_name string")
    erase = lambda found: PR.erase_rows(found, subjects, "owner")
    touched = PR.erase_in_files(spark, path, subjects, "owner", erase, ["kind"])
    assert 0 < len(touched) < len(before) / 2
    assert before - files() == {f.removeprefix("file:").replace("//", "/") for f in touched}
    left = {r.id for r in spark.read.parquet(path).collect()}
    assert left == {i for i in range(200) if i // 10 not in (3, 4)}
    assert not [f for f in os.listdir(local) if f.startswith(("_fresh", "_erasure"))]
    assert PR.erase_in_files(spark, path, subjects, "owner", erase, ["kind"]) == []


def test_erasure_of_everybody_leaves_an_empty_table(spark):
    from tidewatch.operators import privacy as PR
    path = work_dir(spark, "erase-all")
    rows = spark.createDataFrame([(i, f"user_{i % 3}", f"kind_{i % 2}") for i in range(30)], "id int, owner string, kind string")
    rows.write.partitionBy("kind").parquet(path)
    subjects = rows.select(F.col("owner").alias("user_name")).distinct()
    erase = lambda found: PR.erase_rows(found, subjects, "owner")
    assert PR.erase_in_files(spark, path, subjects, "owner", erase, ["kind"])
    assert spark.read.schema(rows.schema).parquet(path).collect() == []
    assert PR.erase_in_files(spark, path, subjects, "owner", erase, ["kind"]) == []


def test_erasure_query_where_everybody_is_a_subject(spark, tmp_path):
    from tidewatch.plans import catalog
    spark.range(50).selectExpr("id AS c_custkey", "7 AS c_nationkey", "9500.0D AS c_acctbal") \
        .write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(100).selectExpr(
        "id AS o_orderkey", "id % 50 AS o_custkey", "'O' AS o_orderstatus", "1000.0D AS o_totalprice",
        "timestamp_ntz'1997-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    left = catalog.all_queries()["privacy_erase_files"](spark, str(tmp_path))
    assert left.columns == ["alert_id", "username", "severity"] and left.collect() == []


def test_erasure_that_was_cut_off_is_completed(spark, monkeypatch):
    from tidewatch.operators import privacy as PR
    path = work_dir(spark, "erase-cut")
    spark.createDataFrame([(i, f"user_{i % 4}") for i in range(40)], "id int, owner string").repartition(4).write.parquet(path)
    subjects = spark.createDataFrame([("user_1",)], "user_name string")
    calls = []
    delete = PR._File.delete

    def failing(self):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        delete(self)

    monkeypatch.setattr(PR._File, "delete", failing)
    with pytest.raises(RuntimeError):
        PR.erase_in_files(spark, path, subjects, "owner", lambda rows: PR.erase_rows(rows, subjects, "owner"))
    monkeypatch.setattr(PR._File, "delete", delete)
    PR.finish_erasure(spark, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [i for i in range(40) if i % 4 != 1]


def test_lifecycle_is_an_exchange_a_step(spark):
    """Commands to known and unknown alerts, some without a time, over few rows a batch; no join, three exchanges."""
    rng = random.Random(11)
    names = ["new", *A.STATUS_MOVES, "odd"]
    alerts = spark.createDataFrame([(i, rng.choice(names[:-1])) for i in range(12)], "alert_id int, status string")
    rows = [(rng.randrange(15), None if n % 9 == 0 else at(rng.choice([5, rng.randrange(10**7)])), n, rng.choice(names), n % 5 == 0)
            for n in range(500)]
    commands = spark.createDataFrame(rows, "alert_id int, at timestamp_ntz, seq int, new_status string, force boolean")
    found = A.apply_transitions(alerts, commands, 86400)
    text = plan(found)
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 3
    status, want = {r.alert_id: r.status for r in alerts.collect()}, {}
    for alert, when, seq, new, force in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or EPOCH, r[2])):
        if alert in status:
            old = status[alert]
            ok = new != "odd" and (force or new == old or new in A.STATUS_MOVES[old])
            status[alert] = new if ok else old
            want[seq] = (alert, old, ok, status[alert])
    assert {r.seq: (r.alert_id, r.old_status, r.accepted, r.status) for r in found.collect()} == want


def test_history_is_stored_without_a_second_replay(spark, monkeypatch):
    """A range of times would be sought by running all commands first."""
    from pyspark.sql import DataFrame
    monkeypatch.delattr(DataFrame, "repartitionByRange")
    alerts = spark.createDataFrame([(i, "new") for i in range(6)], "alert_id int, status string")
    commands = spark.createDataFrame([(i % 6, at(i * 86400 * 20), i, "acknowledged" if i < 6 else "resolved") for i in range(12)],
                                     "alert_id int, at timestamp_ntz, seq int, new_status string")
    root = work_dir(spark, "history-once")
    HI.append_batch(root, alerts, commands, 0)
    assert {r.status for r in HI.read_statuses(root, alerts, 0).collect()} == {"resolved"}
    assert HI.read_history(spark, root).count() == 12


def test_rows_of_one_row_group_are_dealt_out(spark):
    from tidewatch.plans.bindings import Tables
    key = "tidewatch.inputPartitions"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        dealt = Tables(spark, "/nowhere").spread(spark.range(1000).coalesce(1))
        parts = [len(p) for p in dealt.rdd.glom().collect()]
        assert len(parts) == 4 and min(parts) > 200
    finally:
        spark.conf.set(key, before)
