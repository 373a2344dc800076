"""Queries against their SQL, and what their plans look like.

TIDEWATCH_ALL=1 compares every query; otherwise one or two of each section.
"""
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans import catalog

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from check_oracle import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.all_queries(), catalog.all_sql()
SAMPLE = ["cond_not_in", "match_all_rules", "agg_rule_rolling", "agg_tumbling_fires", "baseline_store", "anomaly_combine",
          "join_geo", "join_assets", "extract_indicators", "ti_valid_asof", "join_packet_sni", "alert_dedup_week",
          "alert_resolve", "risk_score", "user_risk_profile", "alert_page", "health_silence", "mask_pii_email",
          "privacy_erase", "extract_urls", "audit_search", "convert_v2_rules", "stream_user_risk", "import_assets_csv", "stream_rules", "stream_dedup_alerts", "run_rule_set", "rule_set_alerts", "risk_pipeline", "alert_statuses",
          "ti_daily_quota", "health_percentiles", "health_ceiling", "lifecycle_stats"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_registry():
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("TIDEWATCH_ALL") else SAMPLE)
def test_against_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, result.fetchall())


def test_sketch_estimates_are_close(spark):
    found = QUERIES["user_host_port_sketches"](spark, FOLDER).collect()
    assert found and all(r.is_close for r in found)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["join_geo", "join_packet_sni", "ti_valid_asof", "join_assets", "anomaly_combine"])
def test_no_pairwise_joins(spark, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        text = plan(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.set(key, before)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "SortMergeJoin" in text


@pytest.mark.parametrize("name", ["scan_assets"])
def test_rankings_are_limited_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scan_reads_only_what_is_needed(spark):
    text = plan(QUERIES["exfil_top_pairs"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text and "props" not in text
    assert "TakeOrderedAndProject" in text
