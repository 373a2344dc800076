"""The given tables read as security data.

Every view is one select list used by both engines, so a query and its SQL see
the same rows. Where the dialects differ, ``{...}`` parts are filled per engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"

# Interval and array spellings of the two engines.
DIALECTS = {
    "spark": {
        "seconds": "make_interval(0, 0, 0, 0, 0, 0, {0})", "hours": "make_interval(0, 0, 0, 0, {0})",
        "minutes": "make_interval(0, 0, 0, 0, 0, {0})", "ts": "timestamp_ntz'{0}'",
    },
    "duckdb": {
        "seconds": "to_seconds({0})", "hours": "to_hours({0})", "minutes": "to_minutes({0})", "ts": "TIMESTAMP '{0}'",
    },
}


def _say(dialect: str, what: str, argument: str) -> str:
    return DIALECTS[dialect][what].format(argument)


def _ip(key: str) -> str:
    return (f"CASE WHEN {key} % 3 = 0 THEN concat('203.0.113.', {key} % 250) "
            f"ELSE concat('10.0.', {key} % 8, '.', {key} % 250) END")


def views(dialect: str) -> dict[str, tuple[str, list[str]]]:
    """View name -> (source table, select list)."""
    say = lambda what, argument: _say(dialect, what, argument)
    sec = [
        "event_id", "ts", "user_id",
        "CASE event_type WHEN 'error' THEN 'authentication_attempt' WHEN 'click' THEN 'http_request' "
        "WHEN 'view' THEN 'dns_query' WHEN 'purchase' THEN 'network_traffic' ELSE 'process_execution' END AS event_type",
        "CASE WHEN value < 50 THEN 'info' WHEN value < 150 THEN 'low' WHEN value < 300 THEN 'medium' "
        "WHEN value < 450 THEN 'high' ELSE 'critical' END AS severity",
        "CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('user_', user_id) END AS username",
        "CASE WHEN event_id % 37 = 0 THEN '' ELSE concat('host_', user_id % 20) END AS hostname",
        f"{_ip('user_id')} AS source_ip",
        "CASE WHEN event_id % 2 = 0 THEN concat('198.51.100.', event_id % 40) "
        "ELSE concat('192.168.1.', event_id % 50) END AS destination_ip",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS destination_port",
        "CAST(floor(value * 10000) AS BIGINT) AS bytes_sent",
        "CAST(floor(value * 3000) AS BIGINT) AS bytes_received",
        # Open attributes; null where an event does not have them.
        "CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'invalid_password' "
        "WHEN 1 THEN 'account_locked' WHEN 2 THEN 'Account_Disabled' ELSE NULL END END AS m_failure_reason",
        "CASE WHEN event_type = 'signup' THEN concat('proc_', user_id % 7, CASE event_id % 3 WHEN 0 THEN '.exe' "
        "WHEN 1 THEN '.sh' ELSE '.PS1' END) END AS m_process_name",
        "CASE WHEN event_type = 'view' THEN concat(CASE event_id % 5 WHEN 0 THEN 'Evil' WHEN 1 THEN 'botnet' "
        "ELSE 'www' END, user_id % 30, '.example.com') END AS m_query_name",
        "CASE event_id % 4 WHEN 0 THEN concat(' ', CAST(floor(value) AS INT), ' ') "
        "WHEN 1 THEN concat('1,', 100 + user_id % 800) WHEN 2 THEN 'n/a' ELSE NULL END AS m_points",
        "CASE event_id % 7 WHEN 0 THEN concat('http://site', user_id % 40, '.example.org/p?q=', event_id % 9) "
        "WHEN 1 THEN concat('cdn', user_id % 25, '.example.net') WHEN 2 THEN concat('8.8.', user_id % 200, '.', "
        "event_id % 200) WHEN 3 THEN repeat(concat('ab', event_id % 10, 'f'), 8) WHEN 4 THEN '10.1.2.3' "
        "WHEN 5 THEN 'plain words' ELSE NULL END AS m_artifact",
        "CASE user_id % 5 WHEN 0 THEN 'auth.failed' WHEN 1 THEN 'malware.detected' WHEN 2 THEN 'policy.violation' "
        "WHEN 3 THEN 'network.command_and_control' ELSE 'web.click' END AS risk_event",
    ]
    assets = [
        "CAST(c_custkey AS BIGINT) AS id", "c_name AS name", f"{_ip('c_custkey')} AS ip_address",
        "concat('Host_', c_custkey % 400) AS hostname",
        "CASE c_mktsegment WHEN 'FURNITURE' THEN 'host' WHEN 'HOUSEHOLD' THEN 'service' WHEN 'MACHINERY' "
        "THEN 'database' WHEN 'BUILDING' THEN 'firewall' ELSE 'workstation' END AS asset_type",
        "CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 3000 THEN 'medium' WHEN c_acctbal < 7000 THEN 'high' "
        "ELSE 'critical' END AS criticality",
        "concat('user_', c_nationkey) AS owner",
        "concat(lower(c_mktsegment), ',zone_', c_nationkey % 5) AS tag_text",
        f"{say('ts', '2023-12-01 00:00:00')} + {say('minutes', 'c_custkey')} AS created_at",
        f"{say('ts', '2024-01-01 00:00:00')} + {say('minutes', 'c_custkey')} AS updated_at",
    ]
    audit = [
        "o_orderkey AS id", f"o_orderdate + {say('seconds', 'o_orderkey % 86400')} AS \"timestamp\"",
        "concat('user_', o_custkey % 50) AS user_name",
        "CASE o_orderstatus WHEN 'O' THEN 'login' WHEN 'F' THEN 'update' ELSE 'delete' END AS action",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'alert' WHEN '2-HIGH' THEN 'rule' ELSE 'asset' END AS resource_type",
        "concat('', o_custkey) AS resource_id",
        "CASE WHEN o_totalprice < 20000 THEN 'failure' ELSE 'success' END AS status",
        "concat('10.1.', o_custkey % 16, '.', o_custkey % 250) AS ip_address", "'agent/1.0' AS user_agent",
        "concat('{\"status\":\"', o_orderstatus, '\",\"owner\":\"user_', o_custkey % 9, '\"}') AS old_state",
        "concat('{\"status\":\"', o_orderpriority, '\"}') AS new_state",
        "concat('{\"key\":\"', o_orderkey % 100, '\"}') AS metadata",
    ]
    at = f"o_orderdate + {say('seconds', 'o_orderkey % 86400')}"
    alerts = [
        "o_orderkey AS alert_id", "concat('rule-', o_custkey % 10) AS rule_id",
        "concat('Rule ', o_custkey % 10) AS rule_name",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' "
        "ELSE 'low' END AS severity",
        "CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'resolved' ELSE 'acknowledged' END AS status",
        f"{at} AS triggered_at", f"{at} + {say('seconds', '5')} AS created_at",
        f"{at} + {say('hours', 'o_orderkey % 72')} AS last_seen",
        "CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk_score",
        "concat('user_', o_custkey % 50) AS username", "concat('dedup:', o_custkey % 500) AS dedup_key",
    ]
    geo = [
        # One /24-sized range per supplier key inside 203.0.113.0-203.0.113.255
        # and wider ones elsewhere; ranges never overlap.
        "CAST(s_suppkey AS BIGINT) AS range_id",
        "CASE WHEN s_suppkey < 50 THEN 3405803776 + s_suppkey * 5 "
        "ELSE 3325256704 + (s_suppkey - 50) * 65536 END AS start_ip",
        "CASE WHEN s_suppkey < 50 THEN 3405803776 + s_suppkey * 5 + 4 "
        "ELSE 3325256704 + (s_suppkey - 50) * 65536 + 65535 END AS end_ip",
        "concat('Country ', s_nationkey) AS country", "concat('C', s_nationkey) AS country_code",
        "concat('City ', s_suppkey) AS city", "CAST(s_nationkey AS DOUBLE) AS latitude",
        "CAST(s_suppkey AS DOUBLE) AS longitude", "'UTC' AS timezone",
    ]
    return {
        "sec_events": ("events", sec), "assets": ("customer", assets), "audit": ("orders", audit),
        "alerts": ("orders", alerts), "geo_ranges": ("supplier", geo),
    }


def with_views(body: str, *names: str, ctes: str = "") -> str:
    """SQL for DuckDB: the named views, more CTEs, then the query."""
    known = views("duckdb")
    parts = [f"{name} AS (SELECT {', '.join(known[name][1])} FROM {known[name][0]})" for name in names]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    if not parts:
        return body.strip()
    word = "WITH RECURSIVE" if "recursive" in ctes.lower() else "WITH"
    return f"{word} {', '.join(parts)} {body.strip()}".replace("/*recursive*/", "")


class Tables:
    """The given tables and the views over them, for one session and folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, spread: bool = False) -> DataFrame:
        table, select_list = views("spark")[name]
        rows = self.spread(self.raw(table)) if spread else self.raw(table)
        return rows.selectExpr(*[part.replace('"timestamp"', "`timestamp`") for part in select_list])

    def spread(self, rows: DataFrame) -> DataFrame:
        """The rows dealt out evenly, for work that costs far more a row than sending it does: no scan can
        split a row group, so a file of few large ones would keep most cores idle. Into as many parts as
        the session says (``tidewatch.inputPartitions``), else as a shuffle has; never by the size of the input."""
        return rows.repartition(int(self.spark.conf.get("tidewatch.inputPartitions", None)
                                    or self.spark.conf.get("spark.sql.shuffle.partitions")))

    @cached_property
    def sec_events(self) -> DataFrame:
        return self.view("sec_events")

    @cached_property
    def spread_events(self) -> DataFrame:
        return self.view("sec_events", spread=True)

    @cached_property
    def rich_events(self) -> DataFrame:
        """Events with their open attributes as a metadata map, in the mixed key
        spellings agents send."""
        return with_metadata(self.spread_events)

    @cached_property
    def assets(self) -> DataFrame:
        return self.view("assets").withColumn("tags", F.split("tag_text", ",")).drop("tag_text")

    @cached_property
    def audit(self) -> DataFrame:
        return self.view("audit")

    @cached_property
    def alerts(self) -> DataFrame:
        return self.view("alerts")

    @cached_property
    def geo_ranges(self) -> DataFrame:
        return self.view("geo_ranges")


# Metadata keys as sent, per attribute column.
METADATA_KEYS = {
    "m_failure_reason": "failureReason", "m_process_name": "process_name", "m_query_name": "queryName",
    "m_points": "Risk-Points", "m_artifact": "artifact",
}


def with_metadata(events: DataFrame) -> DataFrame:
    pairs = [part for column, key in METADATA_KEYS.items() for part in (F.lit(key), F.col(column))]
    metadata = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return events.withColumn("metadata", metadata).drop(*METADATA_KEYS)


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")
