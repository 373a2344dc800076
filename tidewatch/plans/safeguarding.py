"""Schema checks, limits, masking, erasure, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import mask_email, sanitize
from ..operators import privacy as PR
from ..operators import quality as Q
from ..operators.enrichment import latest_assets
from ..session import work_dir
from ..sources import envelopes as EN
from ..sources import tables as TB
from .bindings import Tables, with_views
from .catalog import query

# --------------------------------------------------------------------- quality
_EVENT_ERRORS = [
    ("event_type = 'process_execution' AND event_id % 3 = 0", "'event_type is not a known value'"),
    ("event_id % 11 = 0", "'protocol is not a known value'"), ("event_id % 19 = 0", "'http_method is not a known value'"),
    ("event_id % 13 = 0", "'source_ip is not an address'"),
    ("destination_port * 900 > 65535", "'destination_port is out of range'"),
    ("event_id % 17 = 0", "'bytes_sent is negative'"), ("event_id % 23 = 0", "'http_status_code is out of range'"),
]


@query("validate_events", with_views(f"""
    SELECT event_id, errors = '' AS is_valid, errors FROM (SELECT event_id, concat_ws('|',
      CASE WHEN event_id % 29 = 0 THEN 'severity is required' END,
      {', '.join(f'CASE WHEN {bad} THEN {message} END' for bad, message in _EVENT_ERRORS)}) AS errors
    FROM sec_events)""", "sec_events"))
def validate_events(t: Tables):
    """Events broken in known ways, checked against the event schema."""
    every = lambda n: F.col("event_id") % n == 0
    events = t.sec_events.select(
        "event_id", F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"),
        F.when((F.col("event_type") == "process_execution") & every(3), F.lit("no_type"))
        .otherwise(F.col("event_type")).alias("event_type"),
        F.when(~every(29), F.col("severity")).alias("severity"),
        F.when(every(13), F.lit("host-1")).otherwise(F.col("source_ip")).alias("source_ip"),
        F.when(every(2), F.lit("")).otherwise(F.col("destination_ip")).alias("destination_ip"),
        F.when(every(11), F.lit("carrier_pigeon")).otherwise(F.lit("tcp")).alias("protocol"),
        F.when(~every(5), F.col("user_id").cast("int")).alias("source_port"),
        (F.col("destination_port") * 900).alias("destination_port"),
        F.when(every(17), F.lit(-1)).otherwise(F.col("bytes_sent")).alias("bytes_sent"),
        F.when(every(19), F.lit("BREW")).when(every(3), F.lit("GET")).alias("http_method"),
        F.when(every(23), F.lit(600)).otherwise(F.lit(204)).alias("http_status_code"))
    return Q.validate_events(events).select("event_id", "is_valid", F.array_join("errors", "|").alias("errors"))


_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{80}-\\x{9F}]"


@query("check_input_limits", f"""
    SELECT doc_id, strlen(text) <= 65536 AS size_ok, true AS utf8_ok, NOT regexp_matches(text, '{_CONTROL}') AS control_ok,
      length(text) <= 10000 AS length_ok, strlen(text) <= 65536 AND NOT regexp_matches(text, '{_CONTROL}')
        AND length(text) <= 10000 AS accepted FROM documents""")
def check_input_limits(t: Tables):
    return Q.check_input(t.raw("documents"), F.col("text")) \
        .select("doc_id", "size_ok", "utf8_ok", "control_ok", "length_ok", "accepted")


@query("sanitize_text", f"""
    SELECT doc_id, left(regexp_replace(concat(text, chr(7), chr(10), chr(127)), '{_CONTROL}', '', 'g'), 10000) AS clean
    FROM documents""")
def sanitize_text(t: Tables):
    noisy = F.concat(F.col("text"), F.lit("\x07\n\x7f"))
    return t.raw("documents").select("doc_id", sanitize(noisy).alias("clean"))


_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = "@([A-Za-z0-9.-])[A-Za-z0-9.-]*\\.([A-Z|a-z]{2,})\\b"


def masked_sql(text: str) -> str:
    return (f"regexp_replace(regexp_replace({text}, '\\b({_LOCAL}){_LOCAL}+({_LOCAL}){_DOMAIN}', "
            f"'\\1***\\2@\\3***@***\\4', 'g'), '\\b{_LOCAL}{{1,2}}{_DOMAIN}', '***@\\1***@***\\2', 'g')")


@query("mask_pii_email", f"SELECT doc_id, {masked_sql('text')} AS masked FROM documents")
def mask_pii_email(t: Tables):
    return t.raw("documents").select("doc_id", mask_email(F.col("text")).alias("masked"))


@query("check_table_constraints", with_views("""
    SELECT 'asset_type unknown' AS violation, concat('', id) AS subject FROM assets
      WHERE asset_type NOT IN ('host', 'service', 'database', 'firewall', 'network_device', 'iot', 'other')
    UNION ALL SELECT 'ip_address too short', concat('', id) FROM assets WHERE length(ip_address) < 7
    UNION ALL SELECT 'ip_address not unique', ip_address FROM assets GROUP BY ip_address HAVING count(*) > 1""",
    "assets"))
def check_table_constraints(t: Tables):
    return Q.constraint_violations(t.assets)


@query("check_packet_constraints", with_views("""
    SELECT violation, concat('', event_id) AS subject FROM (
      SELECT event_id, unnest(list_filter([CASE WHEN length(left(source_ip, event_id % 9)) < 7 THEN 'src_ip too short' END,
        CASE WHEN length(destination_ip) < 7 THEN 'dst_ip too short' END,
        CASE WHEN length(left(m_query_name, event_id % 5)) < 3 THEN 'sni too short' END], lambda x: x IS NOT NULL)) AS violation
      FROM sec_events)""", "sec_events"))
def check_packet_constraints(t: Tables):
    cut = lambda column, n: F.left(column, (F.col("event_id") % n).cast("int"))
    packets = t.sec_events.select(
        F.col("event_id").alias("id"), cut("source_ip", 9).alias("src_ip"), F.col("destination_ip").alias("dst_ip"),
        cut("m_query_name", 5).alias("sni"))
    return Q.packet_violations(packets)


# --------------------------------------------------------------------- privacy
# People of nation 7 ask for erasure; people of nation 8 restrict processing.
_SUBJECTS = """subjects AS (SELECT DISTINCT concat('user_', c_custkey % 50) AS user_name FROM customer
      WHERE c_nationkey = 7 AND c_acctbal > 9000)"""


def subjects(t: Tables):
    return t.raw("customer").filter("c_nationkey = 7 AND c_acctbal > 9000") \
        .select(F.concat(F.lit("user_"), F.col("c_custkey") % 50).alias("user_name")).distinct()


@query("privacy_erase", with_views("""
    SELECT 'audit' AS source_table, id, CASE WHEN s THEN concat('anonymized-', left(sha256(concat(user_name, 'pepper')), 16))
      ELSE user_name END AS user_name, CASE WHEN s THEN '0.0.0.0' ELSE ip_address END AS ip_address,
      CASE WHEN s THEN 'anonymized' ELSE user_agent END AS user_agent
    FROM (SELECT *, user_name IN (SELECT user_name FROM subjects) AS s FROM audit)
    UNION ALL SELECT 'alerts', alert_id, username, NULL, NULL FROM alerts
      WHERE username NOT IN (SELECT user_name FROM subjects)
    UNION ALL SELECT 'assets', id, owner, NULL, NULL FROM assets WHERE owner NOT IN (SELECT user_name FROM subjects)""",
    "audit", "alerts", "assets", ctes=_SUBJECTS))
def privacy_erase(t: Tables):
    who = subjects(t)
    blank = F.lit(None).cast("string")
    audit = PR.erase_from_audit(t.audit, who, "pepper").select(
        F.lit("audit").alias("source_table"), "id", "user_name", "ip_address", "user_agent")
    alerts = PR.erase_rows(t.alerts, who, "username").select(
        F.lit("alerts").alias("source_table"), F.col("alert_id").alias("id"), F.col("username").alias("user_name"),
        blank.alias("ip_address"), blank.alias("user_agent"))
    assets = PR.erase_rows(t.assets, who, "owner").select(
        F.lit("assets").alias("source_table"), "id", F.col("owner").alias("user_name"), blank.alias("ip_address"),
        blank.alias("user_agent"))
    return audit.unionByName(alerts).unionByName(assets)


@query("privacy_erase_files", with_views("""
    SELECT alert_id, username, severity FROM alerts WHERE username NOT IN (SELECT user_name FROM subjects)""",
    "alerts", ctes=_SUBJECTS))
def privacy_erase_files(t: Tables):
    """The stored alerts after an erasure that rewrites only the files which hold a subject."""
    path = work_dir(t.spark, "erasure")
    alerts = t.alerts.select("alert_id", "username", "severity")
    alerts.repartitionByRange(16, "username").write.partitionBy("severity").parquet(path)
    who = subjects(t)
    PR.erase_in_files(t.spark, path, who, "username", lambda rows: PR.erase_rows(rows, who, "username"), ["severity"])
    return t.spark.read.schema(alerts.schema).parquet(path)  # every alert may have been a subject's


@query("privacy_access_export", with_views("""
    SELECT user_name, 'audit' AS source_table, concat('', id) AS row_id, status AS body_status FROM audit
      WHERE user_name IN (SELECT user_name FROM subjects)
    UNION ALL SELECT username, 'alerts', concat('', alert_id), status FROM alerts
      WHERE username IN (SELECT user_name FROM subjects)
    UNION ALL SELECT owner, 'assets', concat('', id), NULL FROM assets WHERE owner IN (SELECT user_name FROM subjects)""",
    "audit", "alerts", "assets", ctes=_SUBJECTS))
def privacy_access_export(t: Tables):
    exported = PR.export_subject({
        "audit": (t.audit, "user_name", "id"), "alerts": (t.alerts, "username", "alert_id"),
        "assets": (t.assets, "owner", "id")}, subjects(t))
    return exported.select("user_name", "source_table", "row_id", F.get_json_object("body", "$.status").alias("body_status"))


@query("privacy_restrict", with_views("""
    SELECT event_id, username FROM sec_events WHERE username NOT IN (SELECT user_name FROM subjects)""", "sec_events",
    ctes=_SUBJECTS))
def privacy_restrict(t: Tables):
    return PR.without_restricted(t.sec_events, subjects(t)).select("event_id", "username")


@query("pseudonymize", with_views("""
    SELECT event_id, sha256(concat(source_ip, 'pepper')) AS source_ip, concat(left(username, 1), '***', right(username, 1))
      AS username FROM sec_events""", "sec_events"))
def pseudonymize(t: Tables):
    return PR.pseudonymize(t.sec_events, "pepper", ["source_ip"], ["username"]) \
        .select("event_id", "source_ip", "username")


@query("pseudonymize_text", f"SELECT conv_id, turn, {masked_sql('text')} AS text FROM conversations")
def pseudonymize_text(t: Tables):
    return PR.pseudonymize(t.raw("conversations"), "pepper", [], [], ["text"]).select("conv_id", "turn", "text")


# ------------------------------------------------------------ sources and sinks
@query("scan_events_partitioned", with_views("""
    SELECT event_type, severity, count(*) AS events, CAST(sum(destination_port) AS BIGINT) AS ports FROM sec_events
    WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL""", "sec_events"))
def scan_events_partitioned(t: Tables):
    """Events written as the month-partitioned table and read back by time."""
    path = work_dir(t.spark, "events")
    TB.write_analytic(t.sec_events.withColumnRenamed("ts", "event_timestamp"), "events", path,
                      bloom=["username", "hostname"])
    bound = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")
    rows = TB.scan_analytic(t.spark, "events", path, bound(20), bound(31), since_month="2024-01")
    return rows.groupBy("event_type", "severity").agg(
        F.count("*").alias("events"), F.sum("destination_port").alias("ports"))


@query("import_assets_csv", with_views("""
    SELECT name, ip_address, CASE WHEN asset_type = 'workstation' THEN 'workstation' ELSE asset_type END AS asset_type,
      criticality, tag_text AS tags, CASE WHEN asset_type = 'workstation' THEN 'unknown asset_type workstation' END AS error
    FROM assets""", "assets"))
def import_assets_csv(t: Tables):
    """The asset table as an import file: odd case, spaced tags, unknown types."""
    path = work_dir(t.spark, "asset-csv")
    t.view("assets").select(
        F.col("name").alias("hostname"), F.col("ip_address").alias("ip"), F.initcap("asset_type").alias("asset_type"),
        F.upper("criticality").alias("criticality"), "owner",
        F.regexp_replace("tag_text", ",", " , ").alias("tags")).write.option("header", True).csv(path)
    return TB.check_assets(TB.read_asset_csv(t.spark, path)).select(
        "name", "ip_address", "asset_type", "criticality", F.array_join("tags", ",").alias("tags"), "error")


@query("import_assets_summary", with_views("""
    SELECT count(*) AS total, count(*) FILTER (asset_type <> 'workstation') AS imported,
      count(*) FILTER (asset_type = 'workstation') AS failed FROM assets""", "assets"))
def import_assets_summary(t: Tables):
    rows = t.view("assets").select(F.col("name").alias("hostname"), F.col("ip_address").alias("ip"), "asset_type",
                                   "criticality", "owner", F.col("tag_text").alias("tags"))
    return TB.import_summary(TB.check_assets(rows))


@query("append_audit_jsonl", with_views("""
    SELECT id, user_name, action, status, "timestamp" FROM audit""", "audit"))
def append_audit_jsonl(t: Tables):
    """The audit table published to the line log and read back from it."""
    base = work_dir(t.spark, "audit")
    TB.publish_audit(t.audit, f"{base}/log", f"{base}/table")
    return t.spark.read.schema("id bigint, user_name string, action string, status string, timestamp timestamp_ntz") \
        .json(f"{base}/log")


@query("scan_assets_latest", with_views("""
    SELECT ip_address, id, name FROM assets QUALIFY row_number() OVER
      (PARTITION BY ip_address ORDER BY updated_at DESC, id DESC) = 1""", "assets"))
def scan_assets_latest(t: Tables):
    return latest_assets(t.assets, F.col("ip_address"), "ip_address").select("ip_address", "id", "name")


def packet_rows(t: Tables):
    protocol = F.get(F.array(*map(F.lit, ["TCP", "udp", "Https", "gopher"])), (F.col("event_id") % 4).cast("int"))
    return t.sec_events.select(
        F.col("event_id").alias("id"), "source_ip", "destination_ip", protocol.alias("protocol"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("int").alias("source_port"),
        "destination_port", F.col("m_query_name").alias("payload_preview"),
        F.when(F.col("event_id") % 2 == 0, F.col("m_query_name")).alias("sni"), F.lit("00ff").alias("raw_payload"),
        F.create_map(F.lit("deviceName"), F.col("hostname"), F.lit("sensorId"), F.lit("s-1")).alias("metadata"))


@query("packets_to_events", with_views("""
    SELECT source_ip, destination_ip, CASE event_id % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'https'
      ELSE 'unknown' END AS protocol, ts AS "timestamp", m_query_name AS preview,
      CASE WHEN event_id % 2 = 0 THEN m_query_name END AS sni, hostname AS device_name, 's-1' AS sensor_id,
      source_ip AS raw_source FROM sec_events""", "sec_events"))
def packets_to_events(t: Tables):
    n = F.col("normalized")
    return EN.packets_to_envelopes(packet_rows(t)).select(
        n["source_ip"].alias("source_ip"), n["destination_ip"].alias("destination_ip"), n["protocol"].alias("protocol"),
        n["timestamp"].cast("timestamp_ntz").alias("timestamp"),
        F.try_element_at(n["metadata"], F.lit("payloadPreview")).alias("preview"),
        F.try_element_at(n["metadata"], F.lit("sni")).alias("sni"), n["device_name"].alias("device_name"),
        n["sensor_id"].alias("sensor_id"), F.get_json_object("raw", "$.sourceIp").alias("raw_source"))
