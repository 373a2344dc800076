from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewatch.session import work_dir
from tidewatch.sources import tables as TB
from tidewatch.operators.fields import EventFields
from tidewatch.streaming.jobs import dedup_alerts, score_batches, tumbling_counts
from tidewatch.streaming.sinks import run_append, run_batches, run_update, stream_files

START = datetime(2024, 1, 1)


def test_dedup_state_lasts_over_batches(spark, tmp_path):
    """Three files, one batch each: a period goes on, ends, and another opens."""
    for number, minutes in enumerate([[0, 10, 10], [50, 59, 61], [130]]):
        rows = [("k", START + timedelta(minutes=m)) for m in minutes] + [("other", START + timedelta(minutes=minutes[0]))]
        spark.createDataFrame(rows, "dedup_key string, triggered_at timestamp").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    alerts = stream_files(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)
    stored = run_update(dedup_alerts(alerts, 3600, delay="1 day"), "test-dedup")
    found = stored.groupBy("dedup_key", "opened_at").agg(F.max("alert_count").alias("n")).collect()
    base = int((START - datetime(1970, 1, 1)).total_seconds())
    assert {(r.dedup_key, (r.opened_at - base) // 60, r.n) for r in found} == {
        ("k", 0, 5), ("k", 61, 1), ("k", 130, 1), ("other", 0, 2), ("other", 130, 1)}


@pytest.mark.parametrize("files", [[[0, 70], [30]], [[70, 130], [10, 30], [0, 131]], [[200], [100, 150], [0, 61, 120]]])
def test_late_alerts_count_to_their_own_period(spark, tmp_path, files):
    """Whatever order the files come in, the stream ends with the periods of the batch."""
    for minutes in files:
        rows = [("k", START + timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(rows, "dedup_key string, triggered_at timestamp").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    alerts = stream_files(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)
    stored = run_update(dedup_alerts(alerts, 3600, delay="1 day"), "test-late")
    last = stored.groupBy("dedup_key", "opened_at").agg(F.max_by("alert_count", "batch").alias("n")).filter("n > 0")
    base = int((START - datetime(1970, 1, 1)).total_seconds())
    want, opened = {}, None
    for minute in sorted(m for minutes in files for m in minutes):
        opened = minute if opened is None or minute >= opened + 60 else opened
        want[opened] = want.get(opened, 0) + 1
    assert {(r.opened_at - base) // 60: r.n for r in last.collect()} == want


def test_each_batch_meets_the_scores_and_queues_the_rest(spark, tmp_path):
    layout = ("event_id string, normalized struct<source_ip:string,destination_ip:string,metadata:map<string,string>>, "
              "enrichment map<string,string>")
    known = spark.createDataFrame([("ipv4", "8.8.8.8", True, 90)],
                                  "type string, value string, is_malicious boolean, score int")
    for name, ip in (("a", "8.8.8.8"), ("b", "9.9.9.9"), ("c", "10.0.0.1")):
        spark.createDataFrame([(name, (ip, None, None), {"kept": "yes"})], layout).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    envelopes = stream_files(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)

    def store(enriched, queue, batch_id):
        enriched.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch_id}"))
        queue.write.mode("overwrite").parquet(str(tmp_path / f"queue/batch={batch_id}"))

    run_batches(envelopes, score_batches(lambda: known, store), "test-scores")
    rows = {r.event_id: r.enrichment for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["b"] == rows["c"] == {"kept": "yes"}
    assert rows["a"] == {"kept": "yes", "threat_intel": '{"source_ip":{"is_malicious":true,"score":90}}'}
    assert [(r.event_id, r.value) for r in spark.read.parquet(str(tmp_path / "queue")).collect()] == [("b", "9.9.9.9")]


def test_partitioned_table_prunes(spark, tmp_path):
    rows = spark.range(100).select(
        (F.lit(START).cast("timestamp") + F.make_interval(days=F.col("id").cast("int"))).alias("event_timestamp"),
        F.concat(F.lit("u"), F.col("id") % 5).alias("username"))
    path = str(tmp_path / "t")
    TB.write_analytic(rows, "events", path, bloom=["username"])
    scanned = TB.scan_analytic(spark, "events", path, F.lit("2024-03-01").cast("timestamp"), since_month="2024-03")
    assert scanned.count() == 40
    assert "PartitionFilters: [isnotnull(event_month" in scanned._jdf.queryExecution().executedPlan().toString()


def test_audit_goes_to_log_and_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "bob", START)], "id int, user_name string, timestamp timestamp")
    for _ in range(2):
        TB.publish_audit(rows, str(tmp_path / "log"), str(tmp_path / "table"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 == spark.read.parquet(str(tmp_path / "table")).count()


def test_work_dir_follows_the_session():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default),
                               sparkContext=SimpleNamespace(master=master))

    assert work_dir(session("spark://host", "/shared/x/"), "a").startswith("/shared/x/a-")
    assert work_dir(session("local[2]", None), "a") != work_dir(session("local[2]", None), "a")
    with pytest.raises(RuntimeError):
        work_dir(session("spark://host", None), "a")


@pytest.mark.parametrize(("function", "bound", "want"), [("sum", 250, 300.0), ("distinct", 1, 2.0), ("avg", 99, 100.0),
                                                         ("max", 150, 200.0), ("count", 2, 3.0)])
def test_streamed_counters_use_the_rules_function(spark, tmp_path, function, bound, want):
    rows = [(START + timedelta(seconds=i), "a", v) for i, v in enumerate([50, 50, 200])]
    rows += [(START + timedelta(seconds=3), "a", 50)] if function == "distinct" else []
    rows.append((START + timedelta(hours=5), "late", 1))  # ends the window
    for number in range(3):  # a file is a batch
        spark.createDataFrame(rows[2 * number:2 * number + 2] or rows[-1:], "ts timestamp, user string, points int").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    events = stream_files(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)
    rule = {"id": "r", "severity": "low", "trigger": {}, "condition": {"operator": "gt", "value": bound, "aggregation": {
        "function": function, "field": "points", "group_by": "user", "window_seconds": 3600}}}
    run = run_append if function == "distinct" else run_update
    stored = run(tumbling_counts(events, rule, EventFields(events.schema)), "test-tumbling").where("group_value = 'a'")
    assert stored.agg(F.max("aggregated_value")).first()[0] == want
    if function == "distinct":
        assert [r.event_count for r in stored.collect()] == [4]


def test_ingested_batches_meet_places_and_assets_by_sorting(spark, tmp_path):
    """Two batches; ranges inside each other, over the end of the IPv4 space and wholly beyond it, whose blocks nobody gathers."""
    from tidewatch.model import ENVELOPE
    from tidewatch.operators.enrichment import asset_lookup, geo_blocks, join_geo
    from tidewatch.streaming.jobs import enrich_batches
    rows = [(1, 0x0B000000, 0x0BFFFFFF, "wide"), (2, 0x0B010200, 0x0B0102FF, "narrow"), (3, 0xFFFFFF00, (1 << 32) + 65535, "end")]
    rows += [(n, (1 << 32) + n * 65536, (1 << 32) + n * 65536 + 65535, "beyond") for n in range(4, 400)]
    ranges = spark.createDataFrame(rows, "range_id long, start_ip long, end_ip long, country string").selectExpr(
        "*", "'C' country_code", "'city' city", "0D latitude", "0D longitude", "'UTC' timezone")
    assert [r.geo_block for r in geo_blocks(ranges.where("range_id > 2")).collect()] == ["4ffffff"]
    assets = spark.createDataFrame([(1, "box", "high", "me", "host", ["t"], "11.1.2.3", "Box", START)],
                                   "id long, name string, criticality string, owner string, asset_type string, tags array<string>, "
                                   "ip_address string, hostname string, updated_at timestamp")
    for name, ip in (("a", "11.1.2.3"), ("b", "11.9.9.9"), ("c", "255.255.255.7"), ("d", "16.0.4.1"), ("e", "10.0.0.1")):
        spark.createDataFrame([(name, ip)], "event_id string, ip string").selectExpr(
            *[f"{'event_id' if f.name == 'event_id' else 'named_struct(' + ', '.join(repr(n.name) + ', ' + ('ip' if n.name == 'source_ip' else f'cast(null as {n.dataType.simpleString()})') for n in f.dataType) + ')' if f.name == 'normalized' else f'cast(null as {f.dataType.simpleString()})'} AS {f.name}"
              for f in ENVELOPE]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_files(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=3)
    body = enrich_batches(spark, lambda: ranges, lambda: asset_lookup(assets), lambda found, n: found.selectExpr(
        "event_id", "get_json_object(enrichment['source_geo'], '$.country') place", "get_json_object(enrichment['source_asset'], '$.name') asset")
        .write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "batch"))
    run_batches(stream, body, "test-enrich")
    found = {r.event_id: (r.place, r.asset) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {"a": ("narrow", "box"), "b": ("wide", None), "c": ("end", None), "d": (None, None), "e": ("Private", None)}
    plan = join_geo(spark.createDataFrame([("11.1.2.3",)], "ip string"), ranges, {"ip": "place"})._jdf.queryExecution().toString()
    assert "SortMergeJoin [geo_block" in plan


def test_scores_of_a_batch_read_the_indicators_that_were_kept(spark):
    from tidewatch.streaming.jobs import attach_scores
    rows = spark.createDataFrame([("a", None)], "event_id string, enrichment map<string,string>")
    found = spark.createDataFrame([("a", "ipv4", None, "8.8.8.8", "source_ip"), ("a", "ipv4", None, "9.9.9.9", "destination_ip")],
                                  "event_id string, type string, hash_type string, value string, enrichment_key string")
    known = spark.createDataFrame([("ipv4", "8.8.8.8", True, 90)], "type string, value string, is_malicious boolean, score int")
    enriched, queue = attach_scores(rows, known, found)
    assert "90" in enriched.collect()[0].enrichment["threat_intel"] and [r.value for r in queue.collect()] == ["9.9.9.9"]
