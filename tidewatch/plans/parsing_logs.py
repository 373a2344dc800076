"""Log parsers over lines built from the events.

Each line is written from event columns and read back by a parser, so the SQL
states what must come out without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.grok import grok_extract
from ..functions.text import sanitize_ascii
from ..functions.timeparse import parse_timestamp
from ..operators import parsing as P
from ..operators.rules import empty_map
from .bindings import Tables, with_views
from .catalog import query

_MESSAGES = [
    "Failed password for invalid user bob from {ip} port 22 ssh2", "admin : TTY=pts/0 ; sudo COMMAND=/bin/ls",
    "permission denied for {ip}", "login accepted", "opened file report.txt", "heartbeat",
]
_TAGS = ["sshd", "sudo", "kernel", "auth", "vfs", "cron"]


def _pick(key: str, values: list[str], dialect: str) -> str:
    branches = " ".join(
        f"WHEN {i} THEN concat('{value.split('{ip}')[0]}', source_ip, '{value.split('{ip}')[1]}')" if "{ip}" in value
        else f"WHEN {i} THEN '{value}'" for i, value in enumerate(values))
    return f"CASE {key} % {len(values)} {branches} END"


_MESSAGE, _TAG = _pick("event_id", _MESSAGES, ""), _pick("event_id", _TAGS, "")


def _stamp(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def syslog_line() -> Column:
    """Structured, tagged, classic and shapeless lines in turn."""
    msg, tag = F.expr(_MESSAGE), F.expr(_TAG)
    priority = F.col("user_id") % 192
    structured = F.concat(F.lit("<"), priority, F.lit(">1 "), _stamp(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                          F.lit(" "), F.coalesce(F.nullif(F.col("hostname"), F.lit("")), F.lit("-")), F.lit(" "),
                          tag, F.lit(" 77 - - "), msg)
    tagged = F.concat(F.lit("<"), priority, F.lit(">1 "), _stamp(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                      F.lit(" gate "), tag, F.lit("[12]: "), msg)
    classic = F.concat(_stamp(F.col("ts"), "MMM dd HH:mm:ss"), F.lit(" gate "), tag, F.lit("[12]: "),
                       msg)
    kind = F.col("event_id") % 4
    return F.when(kind == 0, structured).when(kind == 1, tagged).when(kind == 2, classic).otherwise(msg)


_SYSLOG_FIELDS = f"""lines AS (SELECT *, {_MESSAGE} AS msg, {_TAG} AS t, event_id % 4 AS kind,
      user_id % 192 AS pri FROM sec_events),
    parsed AS (SELECT event_id, kind, msg AS message, CASE WHEN kind = 3 THEN '' ELSE t END AS tag,
      CASE kind WHEN 0 THEN hostname WHEN 3 THEN 'sensor' ELSE 'gate' END AS device_name,
      CASE WHEN kind < 2 THEN CAST(pri AS INT) ELSE 0 END AS priority,
      CASE WHEN kind < 2 THEN pri % 8 ELSE 1 END AS level,
      CASE WHEN contains(msg, source_ip) THEN source_ip ELSE '' END AS source_ip,
      CASE WHEN kind < 3 THEN date_trunc('second', ts) END AS timestamp,
      lower(concat_ws(' ', CASE WHEN kind = 3 THEN '' ELSE t END, msg)) AS words FROM lines)"""
_SYSLOG_SQL = """
    SELECT event_id, message, tag, device_name, priority, source_ip, "timestamp",
      CASE WHEN level <= 2 THEN 'critical' WHEN level = 3 THEN 'high' WHEN level = 4 THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN contains(words, 'ssh') THEN 'ssh_connection' WHEN contains(words, 'sudo') THEN 'process_execution'
        WHEN contains(words, 'failed') OR contains(words, 'error') OR contains(words, 'denied') THEN 'security_alert'
        WHEN contains(words, 'authentication') OR contains(words, 'login') OR contains(words, 'password')
          THEN 'authentication_attempt'
        WHEN contains(words, 'file') OR contains(words, 'access') THEN 'file_access' ELSE 'system_log' END AS event_type,
      CASE event_id % 6 WHEN 0 THEN 'ssh_failed_login' WHEN 1 THEN 'sudo_command' WHEN 2 THEN 'access_denied' END AS mark
    FROM parsed"""


@query("parse_syslog", with_views(_SYSLOG_SQL, "sec_events", ctes=_SYSLOG_FIELDS.replace(" AS timestamp,", ' AS "timestamp",')))
def parse_syslog(t: Tables):
    lines = t.spread_events.withColumns({"raw": syslog_line(), "source": F.lit("sensor")})
    lines, parsed = P.parse_syslog(lines, F.col("raw"), F.col("source"), 2024)
    out = ["message", "tag", "device_name", "priority", "source_ip", "severity", "event_type", "mark"]
    return lines.select("event_id", *[parsed[name].alias(name) for name in out],
                                  parsed["timestamp"].cast("timestamp_ntz").alias("timestamp"))


@query("parse_syslog_collector", with_views(f"""
    SELECT event_id, CASE WHEN kind < 3 THEN pri END AS priority, CASE WHEN kind < 3 THEN pri // 8 END AS facility,
      CASE WHEN kind < 3 THEN pri % 8 END AS severity_code,
      CASE kind WHEN 0 THEN hostname WHEN 1 THEN 'gate' ELSE '' END AS hostname,
      CASE WHEN kind < 2 THEN concat(t, CASE WHEN kind = 1 THEN '[12]' ELSE '' END) ELSE '' END AS tag, msg AS message,
      CASE WHEN kind < 2 THEN date_trunc('second', ts) END AS "timestamp"
    FROM (SELECT *, {_MESSAGE} AS msg, {_TAG} AS t, event_id % 4 AS kind, CAST(user_id % 192 AS INT) AS pri
          FROM sec_events)""", "sec_events"))
def parse_syslog_collector(t: Tables):
    kind, priority = F.col("event_id") % 4, F.col("user_id") % 192
    events = t.spread_events.withColumns({"msg": F.expr(_MESSAGE), "tag": F.expr(_TAG)})
    head = F.concat(F.lit("<"), priority, F.lit(">"))
    line = F.when(kind == 0, F.concat(
        head, F.lit("1 "), _stamp(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(" "),
        F.coalesce(F.nullif(F.col("hostname"), F.lit("")), F.lit("-")), F.lit(" "), F.col("tag"),
        F.lit(' 77 ID9 [meta a="b"] '), F.col("msg"))).when(kind == 1, F.concat(
            head, _stamp(F.col("ts"), "MMM dd HH:mm:ss"), F.lit(" gate "), F.col("tag"), F.lit("[12]: "),
            F.col("msg"))).when(kind == 2, F.concat(head, F.lit("  "), F.col("msg"))).otherwise(F.col("msg"))
    lines, parsed = P.parse_syslog_collector(events.withColumn("raw", line), F.col("raw"), 2024)
    return lines.select(
        "event_id", *[parsed[n].alias(n) for n in ("priority", "facility", "severity_code", "hostname", "tag", "message")],
        parsed["timestamp"].cast("timestamp_ntz").alias("timestamp"))


@query("map_syslog_agent", with_views("""
    SELECT event_id, CASE WHEN code <= 3 THEN 'security_alert' WHEN code <= 7 THEN 'system_log' ELSE 'unknown' END
      AS event_type, CASE WHEN code <= 2 THEN 'critical' WHEN code = 3 THEN 'high' WHEN code = 4 THEN 'medium'
      WHEN code <= 7 THEN 'info' ELSE 'unknown' END AS severity
    FROM (SELECT event_id, user_id % 9 AS code FROM sec_events)""", "sec_events"))
def map_syslog_agent(t: Tables):
    code = F.col("user_id") % 9
    return t.spread_events.select("event_id", P.agent_syslog_type(code).alias("event_type"),
                               P.agent_syslog_severity(code).alias("severity"))


@query("map_windows_agent", with_views("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 4 < 2 THEN 'authentication_attempt'
      ELSE 'security_alert' END WHEN 1 THEN 'system_log' ELSE 'unknown' END AS event_type,
      CASE user_id % 7 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'info'
      WHEN 5 THEN 'info' ELSE 'unknown' END AS severity FROM sec_events""", "sec_events"))
def map_windows_agent(t: Tables):
    log = F.when(F.col("event_id") % 3 == 0, F.lit("SECURITY")).when(F.col("event_id") % 3 == 1, F.lit("System")) \
        .otherwise(F.lit("Application"))
    code = F.lit(4624) + F.when(F.col("user_id") % 4 == 0, F.lit(0)).when(F.col("user_id") % 4 == 1, F.lit(145)) \
        .otherwise(F.lit(50))
    return t.spread_events.select("event_id", P.agent_event_type(log, code).alias("event_type"),
                               P.agent_event_severity(F.col("user_id") % 7).alias("severity"))


# ------------------------------------------------------------------ access logs
_STATUS = "CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 302 WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 100 END"
_METHOD = "CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'BREW' END"


def access_line() -> Column:
    line = F.concat(
        F.col("source_ip"), F.lit(" - "), F.coalesce(F.nullif(F.col("username"), F.lit("")), F.lit("-")), F.lit(" ["),
        _stamp(F.col("ts"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), F.expr(_METHOD), F.lit(" /p/"),
        F.col("user_id"), F.lit('?q=1 HTTP/1.1" '), F.expr(_STATUS), F.lit(" "), F.col("bytes_sent"),
        F.lit(' "https://example.com/'), F.col("user_id"), F.lit('" "Mozilla/5.0 (X11; Linux)"'),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.col("destination_port"))).otherwise(F.lit("")))
    return F.when(F.col("event_id") % 50 == 0, F.lit("not an access line")).otherwise(line)


@query("parse_apache", with_views(f"""
    SELECT event_id, CASE WHEN bad THEN '' ELSE source_ip END AS source_ip, CASE WHEN bad THEN 0 ELSE code END AS http_status,
      CASE WHEN bad THEN '' ELSE method END AS http_method, CASE WHEN bad THEN '' ELSE concat('/p/', user_id, '?q=1') END AS path,
      CASE WHEN bad THEN '' ELSE concat('https://example.com/', user_id) END AS referrer,
      CASE WHEN bad THEN '' ELSE 'Mozilla/5.0 (X11; Linux)' END AS user_agent,
      CASE WHEN NOT bad THEN username END AS username,
      CASE WHEN NOT bad AND event_id % 2 = 0 AND destination_port > 0 THEN destination_port END AS response_time_ms,
      CASE WHEN NOT bad AND code >= 500 THEN 'security_alert' ELSE 'http_request' END AS event_type,
      CASE WHEN bad OR code < 200 THEN 'unknown' WHEN code >= 500 THEN 'high' WHEN code >= 300 THEN 'low' ELSE 'info' END
        AS severity, CASE WHEN NOT bad AND method IN ('GET', 'POST') THEN 'http' ELSE 'unknown' END AS protocol,
      CASE WHEN NOT bad THEN date_trunc('second', ts) END AS "timestamp"
    FROM (SELECT *, event_id % 50 = 0 AS bad, {_STATUS} AS code, {_METHOD} AS method FROM sec_events)""", "sec_events"))
def parse_apache(t: Tables):
    lines, parsed = P.parse_access_log(t.spread_events.withColumn("raw", access_line()), F.col("raw"))
    out = ["source_ip", "http_status", "http_method", "path", "referrer", "user_agent", "username", "response_time_ms",
           "event_type", "severity", "protocol"]
    return lines.select("event_id", *[parsed[n].alias(n) for n in out],
                                  parsed["timestamp"].cast("timestamp_ntz").alias("timestamp"))


# --------------------------------------------------------------------- firewall
_ACTION = "CASE event_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'deny' WHEN 2 THEN 'Drop' ELSE 'close' END"
_PROTO = "CASE user_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 ELSE 50 END"


def firewall_line() -> Column:
    pairs = F.concat(
        F.lit("action="), F.expr(_ACTION), F.lit(" srcip="), F.col("source_ip"), F.lit(" dstip="),
        F.col("destination_ip"), F.lit(" srcport="), F.col("user_id") % 70 * 100, F.lit(" dstport="),
        F.col("destination_port"), F.lit(" proto="), F.expr(_PROTO), F.lit("  policyid="), F.col("user_id") % 5,
        F.lit(" service=svc a=b=c user="), F.col("user_id"), F.lit(" user=other"))
    cef = F.concat(F.lit("CEF:0|Fortinet|FortiGate|7.0|"), F.col("user_id") % 9, F.lit("|traffic|"),
                   F.col("event_id") % 10, F.lit("|"), pairs)
    return F.when(F.col("event_id") % 2 == 0, cef).otherwise(pairs)


@query("parse_fortinet", with_views(f"""
    SELECT event_id, source_ip, destination_ip, action, CASE WHEN sp > 0 THEN sp END AS source_port,
      CASE WHEN destination_port > 0 THEN destination_port END AS destination_port,
      CASE user_id % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' ELSE 'unknown' END AS protocol,
      CASE WHEN blocked THEN 'security_alert' ELSE 'network_traffic' END AS event_type,
      CASE WHEN blocked AND rating = 'info' THEN 'medium' ELSE rating END AS severity,
      CASE WHEN event_id % 2 = 0 THEN concat(user_id % 9, '') END AS signature_id,
      concat(user_id % 5, '') AS policy_id, concat(user_id, '') AS first_user, 'svc' AS service
    FROM (SELECT *, {_ACTION} AS action, lower({_ACTION}) IN ('deny', 'drop') AS blocked,
      CAST(user_id % 70 * 100 AS INT) AS sp, CASE WHEN event_id % 2 = 1 THEN 'info' WHEN event_id % 10 >= 8 THEN 'critical'
      WHEN event_id % 10 >= 6 THEN 'high' WHEN event_id % 10 >= 4 THEN 'medium' WHEN event_id % 10 >= 2 THEN 'low'
      ELSE 'info' END AS rating FROM sec_events)""", "sec_events"))
def parse_fortinet(t: Tables):
    lines, parsed = P.parse_firewall(t.spread_events.withColumn("raw", firewall_line()), F.col("raw"))
    out = ["source_ip", "destination_ip", "action", "source_port", "destination_port", "protocol", "event_type",
           "severity", "signature_id"]
    meta = lambda key: F.try_element_at("meta", F.lit(key))
    return lines.withColumn("meta", parsed["metadata"]).select(
        "event_id", *[parsed[n].alias(n) for n in out], meta("policy_id").alias("policy_id"),
        meta("user").alias("first_user"), meta("service").alias("service"))


# ---------------------------------------------------------------------- windows
_CODE = "CASE event_id % 6 WHEN 0 THEN 4624 WHEN 1 THEN 4625 WHEN 2 THEN 4672 WHEN 3 THEN 4688 WHEN 4 THEN 4660 ELSE 9999 END"


def windows_line() -> Column:
    data = lambda name, value: F.concat(F.lit(f"<Data Name='{name}'>"), value, F.lit("</Data>"))
    xml = F.concat(
        F.lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System>"
              "<Provider Name='Security'/><EventID>"), F.expr(_CODE), F.lit("</EventID><TimeCreated SystemTime='"),
        _stamp(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("'/><Computer>"), F.col("hostname"),
        F.lit("</Computer></System><EventData>"),
        F.when(F.col("event_id") % 2 == 0, data("TargetUserName", F.col("username"))).otherwise(F.lit("")),
        data("UserName", F.lit("fallback")),
        F.when(F.col("event_id") % 3 == 0, data("SourceNetworkAddress", F.col("destination_ip")))
        .otherwise(data("IpAddress", F.col("source_ip"))), F.lit("</EventData></Event>"))
    return F.when(F.col("event_id") % 41 == 0, F.lit("<broken")).otherwise(xml)


@query("parse_windows_event", with_views(f"""
    SELECT event_id, CASE WHEN bad THEN 0 ELSE code END AS event_code,
      CASE WHEN bad THEN '' WHEN event_id % 2 = 0 THEN username ELSE 'fallback' END AS username,
      CASE WHEN bad THEN '' ELSE hostname END AS device_name,
      CASE WHEN bad THEN '' WHEN event_id % 3 = 0 THEN destination_ip ELSE source_ip END AS source_ip,
      CASE WHEN bad THEN 'unknown_action' ELSE CASE code WHEN 4624 THEN 'login_success' WHEN 4625 THEN 'login_failed'
        WHEN 4672 THEN 'privilege_assignment' WHEN 4688 THEN 'process_creation' WHEN 4660 THEN 'object_deleted'
        ELSE 'unknown_action' END END AS action,
      CASE WHEN bad THEN 'system_log' ELSE CASE code WHEN 4624 THEN 'authentication_attempt'
        WHEN 4625 THEN 'authentication_attempt' WHEN 4672 THEN 'security_alert' WHEN 4688 THEN 'process_execution'
        WHEN 4660 THEN 'file_access' ELSE 'system_log' END END AS event_type,
      CASE WHEN bad THEN 'info' ELSE CASE code WHEN 4625 THEN 'medium' WHEN 4672 THEN 'high' WHEN 4660 THEN 'medium'
        ELSE 'info' END END AS severity, CASE WHEN NOT bad THEN date_trunc('second', ts) END AS "timestamp"
    FROM (SELECT *, event_id % 41 = 0 AS bad, {_CODE} AS code FROM sec_events)""", "sec_events"))
def parse_windows_event(t: Tables):
    lines, parsed = P.parse_windows_event(t.spread_events.withColumn("raw", windows_line()), F.col("raw"))
    out = ["event_code", "username", "device_name", "source_ip", "action", "event_type", "severity"]
    return lines.select("event_id", *[parsed[n].alias(n) for n in out],
                                   parsed["timestamp"].cast("timestamp_ntz").alias("timestamp"))


# ------------------------------------------------------------------- small tools
@query("parse_timestamp_multi", with_views("""
    SELECT event_id, CASE WHEN event_id % 8 = 7 THEN NULL WHEN event_id % 8 = 1 THEN date_trunc('millisecond', ts)
      ELSE date_trunc('second', ts) END AS parsed FROM sec_events""", "sec_events"))
def parse_timestamps(t: Tables):
    patterns = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss",
                "dd/MMM/yyyy:HH:mm:ss '+0000'", "dd/MMM/yyyy:HH:mm:ss", "MMM dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
    text = F.lit("yesterday noon")
    for i, pattern in enumerate(patterns):
        text = F.when(F.col("event_id") % 8 == i, _stamp(F.col("ts"), pattern)).otherwise(text)
    return t.spread_events.withColumn("text", text).select(
        "event_id", parse_timestamp(F.col("text"), 2024).cast("timestamp_ntz").alias("parsed"))


@query("detect_source_type", with_views("""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'cef_json' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'cef_string'
      ELSE 'syslog_string' END WHEN 2 THEN 'syslog_string' WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'cef_string'
      ELSE 'syslog_string' END ELSE 'unknown' END AS source_type FROM sec_events""", "sec_events"))
def detect_source_type(t: Tables):
    kind = F.get(F.array(*map(F.lit, [
        "Application/JSON; charset=utf-8", "text/plain", "text/plain", "application/x-www-form-urlencoded", "image/png"])),
        (F.col("event_id") % 5).cast("int"))
    body = F.when((F.col("event_id") % 5 == 1) & (F.col("user_id") % 2 == 0), F.lit("cef:0|x")) \
        .when((F.col("event_id") % 5 == 3) & (F.col("user_id") % 2 == 0), F.lit("data=CEF:0|x")) \
        .otherwise(F.concat(F.lit("<13>host "), F.col("username")))
    return t.spread_events.select("event_id", P.detect_source_type(kind, body).alias("source_type"))


@query("grok_extract", """
    SELECT page_id, nullif(lower(regexp_extract(url, '(?i)^(https?)://([^/:]+)(?:/([^?#]*))?(?:\\?([^#]*))?', 1)), '') AS scheme,
      nullif(regexp_extract(url, '(?i)^(https?)://([^/:]+)(?:/([^?#]*))?(?:\\?([^#]*))?', 2), '') AS host,
      nullif(regexp_extract(url, '(?i)^(https?)://([^/:]+)(?:/([^?#]*))?(?:\\?([^#]*))?', 3), '') AS path,
      nullif(regexp_extract(url, '(?i)^(https?)://([^/:]+)(?:/([^?#]*))?(?:\\?([^#]*))?', 4), '') AS query_text FROM pages""")
def grok(t: Tables):
    pages, g = grok_extract(
        t.raw("pages"), F.col("url"),
        r"^(?<scheme>https?)://(?<host>[^/:]+)(?:/(?<path>[^?#]*))?(?:\?(?<query>[^#]*))?", "_url_parts")
    return pages.select("page_id", F.lower(g["scheme"]).alias("scheme"), g["host"].alias("host"),
                                 g["path"].alias("path"), g["query"].alias("query_text"))


@query("extract_urls", """
    SELECT page_id, CAST(position AS INT) AS position, regexp_replace(u, '[^ -~]', '', 'g') AS url
    FROM (SELECT page_id, unnest(urls) AS u, generate_subscripts(urls, 1) - 1 AS position FROM
      (SELECT page_id, regexp_extract_all(concat(url, ' ', html),
        '(https?://[^\\s\\x0B]+|www\\.[^\\s\\x0B]+)', 1) AS urls FROM pages))""")
def extract_urls(t: Tables):
    return P.url_rows(t.raw("pages"), "page_id", F.concat_ws(" ", "url", "html"))


@query("clean_ascii", "SELECT doc_id, left(regexp_replace(text, '[^ -~]', '', 'g'), 255) AS cleaned FROM documents")
def clean(t: Tables):
    return t.raw("documents").select("doc_id", sanitize_ascii(F.col("text")).alias("cleaned"))


# ---------------------------------------------------------------------- routing
KINDS = ["SysLog", "apache", "Fortinet", "windows-eventlog", "printer"]


def envelopes(t: Tables):
    """Every event as a raw envelope, written the way its source would."""
    kind = (F.col("event_id") % len(KINDS)).cast("int")
    lines = [syslog_line(), access_line(), firewall_line(), windows_line()]
    raw = F.lit("page 1 printed")
    for position, line in enumerate(lines):
        raw = F.when(kind == position, line).otherwise(raw)
    return t.spread_events.select(
        F.concat(F.lit("e-"), "event_id").alias("event_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.lit("sensor").alias("source"), F.get(F.array(*map(F.lit, KINDS)), kind).alias("source_type"),
        raw.alias("raw"), F.create_map(F.lit("tag"), F.lit("kept"), F.lit("sensor"), F.lit("s1")).alias("enrichment"),
        F.lit("v1.0").alias("schema_version"))


_SYSLOG_TYPE = """CASE WHEN contains(words, 'ssh') THEN 'ssh_connection' WHEN contains(words, 'sudo')
      THEN 'process_execution' WHEN contains(words, 'failed') OR contains(words, 'error') OR contains(words, 'denied')
      THEN 'security_alert' WHEN contains(words, 'authentication') OR contains(words, 'login')
      OR contains(words, 'password') THEN 'authentication_attempt' WHEN contains(words, 'file')
      OR contains(words, 'access') THEN 'file_access' ELSE 'system_log' END"""
ROUTED_SQL = f"""routed AS (SELECT concat('e-', s.event_id) AS event_id, CASE s.event_id % 5
      WHEN 0 THEN {_SYSLOG_TYPE}
      WHEN 1 THEN CASE WHEN s.event_id % 50 <> 0 AND {_STATUS.replace('event_id', 's.event_id')} >= 500
        THEN 'security_alert' ELSE 'http_request' END
      WHEN 2 THEN CASE WHEN lower({_ACTION.replace('event_id', 's.event_id')}) IN ('deny', 'drop')
        THEN 'security_alert' ELSE 'network_traffic' END
      WHEN 3 THEN CASE WHEN s.event_id % 41 = 0 THEN 'system_log' ELSE CASE s.event_id % 6
        WHEN 0 THEN 'authentication_attempt' WHEN 1 THEN 'authentication_attempt' WHEN 2 THEN 'security_alert'
        WHEN 3 THEN 'process_execution' WHEN 4 THEN 'file_access' ELSE 'system_log' END END
      ELSE 'unknown' END AS event_type,
      CASE s.event_id % 5 WHEN 0 THEN p.source_ip WHEN 1 THEN CASE WHEN s.event_id % 50 <> 0 THEN s.source_ip ELSE '' END
        WHEN 2 THEN s.source_ip WHEN 3 THEN CASE WHEN s.event_id % 41 = 0 THEN '' WHEN s.event_id % 3 = 0
        THEN s.destination_ip ELSE s.source_ip END ELSE '' END AS source_ip
    FROM sec_events s JOIN parsed p USING (event_id))"""
_PARSED_CTE = _SYSLOG_FIELDS.replace(" AS timestamp,", ' AS "timestamp",')


@query("route_by_source_type", with_views(
    "SELECT event_id, event_type, source_ip, 'kept' AS tag FROM routed", "sec_events",
    ctes=_PARSED_CTE + ", " + ROUTED_SQL))
def route(t: Tables):
    return P.normalize_envelopes(envelopes(t), 2024).select(
        "event_id", "normalized.event_type", "normalized.source_ip", F.col("enrichment.tag").alias("tag"))


@query("passthrough_normalize", with_views("""
    SELECT concat('e-', event_id) AS event_id, 'unknown' AS event_type, 'info' AS severity, '' AS source_ip,
      username AS payload, ts AS "timestamp", 's1' AS sensor FROM sec_events""", "sec_events"))
def passthrough(t: Tables):
    """Every event as an envelope of a kind no parser knows."""
    plain = t.spread_events.select(
        F.concat(F.lit("e-"), "event_id").alias("event_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.lit("sensor").alias("source"), F.lit("printer").alias("source_type"), F.col("username").alias("raw"),
        F.create_map(F.lit("sensor"), F.lit("s1")).alias("enrichment"))
    n = F.col("normalized")
    return P.normalize_envelopes(plain, 2024).select("event_id", n["event_type"].alias("event_type"), n["severity"].alias("severity"),
                         n["source_ip"].alias("source_ip"), n["payload"].alias("payload"),
                         n["timestamp"].cast("timestamp_ntz").alias("timestamp"),
                         n["metadata"]["sensor"].alias("sensor"))


@query("merge_metadata", with_views("""
    SELECT event_id, 'kept' AS tag, m_failure_reason AS reason,
      CASE WHEN m_artifact IS NULL OR event_id % 2 = 0 THEN 'given' ELSE m_artifact END AS artifact FROM sec_events""",
    "sec_events"))
def merge_metadata(t: Tables):
    given = F.map_filter(F.create_map(
        F.lit("tag"), F.lit("kept"),
        F.lit("artifact"), F.when(~F.coalesce(F.map_contains_key("metadata", "artifact"), F.lit(False))
                                  | (F.col("event_id") % 2 == 0), F.lit("given"))), lambda k, v: v.isNotNull())
    merged = t.rich_events.withColumn("m", P.merge_metadata(given, F.coalesce("metadata", empty_map())))
    read = lambda key: F.try_element_at("m", F.lit(key))
    return merged.select("event_id", read("tag").alias("tag"), read("failureReason").alias("reason"),
                         read("artifact").alias("artifact"))
