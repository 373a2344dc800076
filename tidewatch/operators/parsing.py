"""Raw log lines to normalized events.

Each parser takes a frame and its raw text column and gives back the frame with
its working columns (regex groups, parsed XML; computed once per row) and a dict
of result columns: those of the normalized layout plus the parser's own. Working
and result columns nobody reads are never computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import case_map, empty_map, first_per_key
from ..functions.grok import grok_extract
from ..functions.ip import IPV4_LOOSE, normalize_ip
from ..functions.text import clean_ascii, find_urls
from ..functions.timeparse import parse_timestamp
from ..model import NORMALIZED, PROTOCOLS
from .fields import merge_maps

# ---------------------------------------------------------------- fixed values
# Line layouts. They decide which part of a line becomes which field, so they are the patterns
# in use, character for character (a group name cannot have an underscore here: structuredData).
SYSLOG_STRUCTURED = (
    r"^<(?<priority>\d{1,3})>(?<version>\d+)\s+"
    r"(?<timestamp>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\s+"
    r"(?<hostname>\S+)\s+(?<appname>\S+)\s+(?<procid>\S+)\s+(?<msgid>\S+)\s+"
    r"(?<structuredData>\[.*?\]|\-)\s*(?<message>.*)"
)
SYSLOG_TAGGED = (
    r"<(?<priority>\d+)>(?<version>\d+)\s+(?<timestamp>[^\s]+)\s+(?<hostname>[^\s]+)\s+"
    r"(?<tag>[^\s\[]+)(?:\[(?<pid>\d+)\])?\s*:\s*(?<message>.*)"
)
SYSLOG_CLASSIC = (
    r"(?<timestamp>[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<hostname>[^\s]+)\s+"
    r"(?<tag>[^\s\[]+)(?:\[(?<pid>\d+)\])?\s*:?\s*(?<message>.*)"
)
SYSLOG_CLASSIC_PRIORITY = (
    r"^<(?<priority>\d{1,3})>(?<timestamp>[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?<hostname>\S+)\s+"
    r"(?<tag>[^:\s]+)(?:\[(?<pid>\d+)\])?\s*:\s*(?<message>.*)"
)
SYSLOG_PRIORITY_ONLY = r"^<(?<priority>\d{1,9})>\s*(?<message>.*)"
ACCESS_LOG = (
    r"^(?<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\s+(?<ident>\S+)\s+(?<user>\S+)\s+\[(?<timestamp>[^\]]+)\]\s+"
    r'"(?<method>\S+)\s+(?<path>\S+)\s+(?<version>HTTP/[\d.]+)"\s+(?<status>\d{3})\s+(?<size>\d+|-)\s+'
    r'"(?<referrer>[^"]*)"\s+"(?<agent>[^"]*)"(?:\s+(?<elapsed>\S+))?'
)
FIREWALL_CEF = (
    r"CEF:0\|Fortinet\|FortiGate\|[^\|]*\|(?<signatureId>[^\|]*)\|(?<signatureName>[^\|]*)\|"
    r"(?<severity>\d+)\|(?<cefContent>.*)"
)
# Words that decide a syslog line's event type, first match wins.
SYSLOG_TYPE_WORDS = [
    (["ssh"], "ssh_connection"), (["sudo"], "process_execution"),
    (["failed", "error", "denied"], "security_alert"),
    (["authentication", "login", "password"], "authentication_attempt"),
    (["file", "access"], "file_access"),
]
SYSLOG_SEVERITY = {0: "critical", 1: "critical", 2: "critical", 3: "high", 4: "medium", 5: "low", 6: "low", 7: "low"}
AGENT_SYSLOG_SEVERITY = SYSLOG_SEVERITY | {5: "info", 6: "info", 7: "info"}
AGENT_LEVEL_SEVERITY = {1: "critical", 2: "high", 3: "medium", 4: "info", 5: "info"}
AGENT_LOGON_CODES = [4624, 4625, 4768, 4769]
ACCESS_LOG_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
FIREWALL_KEYS = ["action", "srcip", "dstip", "srcport", "dstport", "proto"]
FIREWALL_PROTOCOLS = {6: "tcp", 17: "udp", 1: "icmp"}
# Windows event code: action, event type, severity.
WINDOWS_CODES = {
    4624: ("login_success", "authentication_attempt", "info"),
    4625: ("login_failed", "authentication_attempt", "medium"),
    4656: ("file_object_accessed", "file_access", "low"),
    4658: ("object_handle_closed", "file_access", "low"),
    4660: ("object_deleted", "file_access", "medium"),
    4663: ("attempt_made_to_access_object", "file_access", "low"),
    4672: ("privilege_assignment", "security_alert", "high"),
    4688: ("process_creation", "process_execution", "info"),
    4719: ("audit_policy_changed", "security_alert", "high"),
    4720: ("user_created", "system_log", "info"),
    4721: ("user_enabled", "system_log", "info"),
    4722: ("user_disabled", "system_log", "info"),
    4725: ("user_disabled_by_admin", "system_log", "info"),
    4726: ("user_deleted", "system_log", "info"),
    4740: ("account_lockout", "security_alert", "medium"),
    4767: ("account_unlocked", "system_log", "info"),
    4907: ("audit_settings_modified", "security_alert", "high"),
    5136: ("directory_service_object_modified", "system_log", "medium"),
}
WINDOWS_XML = (
    "System STRUCT<EventID: STRING, Computer: STRING, TimeCreated: STRUCT<_SystemTime: STRING>>, "
    "EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"
)

Parsed = tuple[DataFrame, dict[str, Column]]


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def string_map(entries: dict[str, Column]) -> Column:
    """Map of the entries that are not null."""
    made = F.create_map(*[part for name, value in entries.items() for part in (F.lit(name), value.cast("string"))])
    return F.map_filter(made, lambda k, v: v.isNotNull())


# ---------------------------------------------------------------------- syslog
def parse_syslog(frame: DataFrame, raw: Column, source: Column, year: int | Column | None = None) -> Parsed:
    """Structured, then tagged, then classic lines; else the whole line is the
    message and ``source`` the host."""
    frame = frame.withColumn("_line", F.trim(raw))
    line, groups = F.col("_line"), []
    missed = line
    for stage, pattern in (("_structured", SYSLOG_STRUCTURED), ("_tagged", SYSLOG_TAGGED),
                           ("_classic", SYSLOG_CLASSIC)):
        frame, found = grok_extract(frame, missed, pattern, stage)
        groups.append({"tag": found["appname"], **found} if "appname" in found else found)
        # The next form is only tried on lines no earlier form took.
        missed = F.when(found["timestamp"].isNull(), missed)
    taken = F.coalesce(*[g["timestamp"] for g in groups])

    def pick(name: str, otherwise: Column) -> Column:
        return F.when(taken.isNull(), otherwise).otherwise(_text(F.coalesce(*[g[name] for g in groups])))

    dash = lambda part: F.when(part == "-", F.lit("")).otherwise(part)
    frame = frame.withColumns({
        "_message": pick("message", line), "_host": dash(pick("hostname", source)),
        "_tag": dash(pick("tag", F.lit(""))),
        "_priority": F.coalesce(groups[0]["priority"], groups[1]["priority"]).try_cast("int"), "_taken": taken,
    }).withColumn("_address", F.regexp_extract("_message", rf"({IPV4_LOOSE})", 1))
    message, tag, priority = F.col("_message"), F.col("_tag"), F.col("_priority")
    mark = syslog_mark(message)
    return frame, {
        "timestamp": parse_timestamp(F.col("_taken"), year),
        "event_type": syslog_event_type(tag, message),
        "severity": case_map(F.coalesce(priority.bitwiseAND(7), F.lit(1)), SYSLOG_SEVERITY, "info"),
        "source_ip": normalize_ip(F.col("_address")), "device_name": F.col("_host"), "tag": tag,
        "priority": F.coalesce(priority, F.lit(0)), "message": message, "mark": mark,
        "metadata": string_map({"tag": tag, "priority": F.coalesce(priority, F.lit(0)), "message": message,
                                "event_type": mark}),
    }


def syslog_event_type(tag: Column, message: Column) -> Column:
    words = F.lower(F.concat_ws(" ", tag, message))
    choice = None
    for needles, event_type in SYSLOG_TYPE_WORDS:
        found = F.contains(words, F.lit(needles[0]))
        for needle in needles[1:]:
            found = found | F.contains(words, F.lit(needle))
        choice = F.when(found, F.lit(event_type)) if choice is None else choice.when(found, F.lit(event_type))
    return choice.otherwise(F.lit("system_log"))


def syslog_mark(message: Column) -> Column:
    """What the message speaks of; the last kind that fits wins."""
    has = lambda word: F.contains(message, F.lit(word))
    return (
        F.when(has("denied"), F.lit("access_denied"))
        .when(has("sudo") & (has("COMMAND") | has("TTY")), F.lit("sudo_command"))
        .when(has("Failed password") | has("Invalid user"), F.lit("ssh_failed_login"))
    )


def parse_syslog_collector(frame: DataFrame, raw: Column, year: int | Column | None = None) -> Parsed:
    """The collector's reading: structured, then classic with priority, then a
    bare priority, then plain text. ``-`` means empty in structured lines."""
    frame, structured = grok_extract(frame, raw, SYSLOG_STRUCTURED, "_structured")
    structured["tag"] = structured["appname"]
    missed = F.when(structured["timestamp"].isNull(), raw)
    frame, classic = grok_extract(frame, missed, SYSLOG_CLASSIC_PRIORITY, "_classic")
    missed = F.when(classic["timestamp"].isNull(), missed)
    frame, bare = grok_extract(frame, missed, SYSLOG_PRIORITY_ONLY, "_bare")
    is_structured, is_classic = structured["timestamp"].isNotNull(), classic["timestamp"].isNotNull()
    frame = frame.withColumn("_priority", F.coalesce(
        structured["priority"], classic["priority"], bare["priority"]).try_cast("int"))
    priority = F.col("_priority")
    dash = lambda part: F.when(_text(part) == "-", F.lit("")).otherwise(_text(part))
    either = lambda name: F.when(is_structured, dash(structured[name])) \
        .when(is_classic, _text(classic[name])).otherwise(F.lit(""))
    return frame, {
        "priority": priority, "facility": F.shiftright(priority, 3), "severity_code": priority.bitwiseAND(7),
        "timestamp": parse_timestamp(F.coalesce(structured["timestamp"], classic["timestamp"]), year),
        "hostname": either("hostname"), "tag": either("tag"),
        "message": F.when(is_structured, _text(structured["message"])).when(is_classic, _text(classic["message"]))
        .when(bare["priority"].isNotNull(), _text(bare["message"])).otherwise(raw),
    }


def agent_syslog_type(code: Column) -> Column:
    return F.when(code.between(0, 3), F.lit("security_alert")).when(code.between(4, 7), F.lit("system_log")) \
        .otherwise(F.lit("unknown"))


def agent_syslog_severity(code: Column) -> Column:
    return case_map(code, AGENT_SYSLOG_SEVERITY, "unknown")


# ------------------------------------------------------------------ access logs
def parse_access_log(frame: DataFrame, raw: Column) -> Parsed:
    """Combined access log, with an optional response time at the end."""
    frame, g = grok_extract(frame, F.trim(raw), ACCESS_LOG, "_access")
    frame = frame.withColumns({
        "_status": F.coalesce(g["status"].try_cast("int"), F.lit(0)),
        "_elapsed": F.coalesce(g["elapsed"].try_cast("int"), F.lit(0)), "_client": _text(g["ip"]),
    })
    status, elapsed = F.col("_status"), F.when(F.col("_elapsed") > 0, F.col("_elapsed"))
    own = {"http_method": _text(g["method"]), "http_status": status, "path": _text(g["path"]),
           "user_agent": _text(g["agent"]), "referrer": _text(g["referrer"]), "response_time_ms": elapsed}
    return frame, {
        "timestamp": parse_timestamp(g["timestamp"]),
        "event_type": F.when(status >= 500, F.lit("security_alert")).otherwise(F.lit("http_request")),
        "severity": F.when(status >= 500, F.lit("high")).when(status >= 300, F.lit("low"))
        .when(status >= 200, F.lit("info")).otherwise(F.lit("unknown")),
        "source_ip": normalize_ip(F.col("_client")), "username": g["user"],
        "protocol": F.when(F.upper(g["method"]).isin(ACCESS_LOG_METHODS), F.lit("http")).otherwise(F.lit("unknown")),
        **own, "metadata": string_map(own),
    }


# --------------------------------------------------------------------- firewall
def parse_firewall(frame: DataFrame, raw: Column) -> Parsed:
    """Header-and-pairs lines or bare ``key=value`` pairs split at blanks. A pair
    has exactly one ``=``; of the keys with a column the last pair counts."""
    frame, cef = grok_extract(frame, F.trim(raw), FIREWALL_CEF, "_cef")
    is_cef = cef["severity"].isNotNull()
    frame = frame.withColumn("_content", F.when(is_cef, _text(cef["cefContent"])).otherwise(F.trim(raw)))
    value = lambda key: F.nullif(F.regexp_extract(
        "_content", rf"(?is)^(?:.* )?{key}=([^ =]*)(?: .*)?$", 1), F.lit(""))
    frame = frame.withColumns({f"_{key}": value(key) for key in FIREWALL_KEYS})
    action = F.coalesce(F.col("_action"), F.lit("unknown"))
    blocked = F.lower(action).isin("deny", "drop")
    rating = F.when(is_cef, cef_severity(cef["severity"].try_cast("int"))).otherwise(F.lit("info"))
    port = lambda key: F.when(F.col(key).try_cast("int") > 0, F.col(key).try_cast("int"))
    signature = {"signature_id": F.when(is_cef, _text(cef["signatureId"])),
                 "signature_name": F.when(is_cef, _text(cef["signatureName"]))}
    return frame, {
        "event_type": F.when(blocked, F.lit("security_alert")).otherwise(F.lit("network_traffic")),
        "severity": F.when(blocked & (rating == "info"), F.lit("medium")).otherwise(rating),
        "source_ip": normalize_ip(_text(F.col("_srcip"))), "destination_ip": normalize_ip(_text(F.col("_dstip"))),
        "source_port": port("_srcport"), "destination_port": port("_dstport"),
        "protocol": case_map(F.col("_proto").try_cast("int"), FIREWALL_PROTOCOLS, "unknown"), "action": action,
        **signature,
        "metadata": merge_maps(firewall_extras(F.col("_content")), string_map({**signature, "action": action})),
    }


def cef_severity(code: Column) -> Column:
    return (
        F.when(code >= 8, F.lit("critical")).when(code >= 6, F.lit("high")).when(code >= 4, F.lit("medium"))
        .when(code >= 2, F.lit("low")).otherwise(F.lit("info"))
    )


def firewall_extras(content: Column) -> Column:
    """Pairs with no column of their own; the first pair of a key counts."""
    pairs = F.transform(
        F.filter(F.split(content, " "), lambda f: F.size(F.split(f, "=")) == 2),
        lambda f: F.struct(F.lower(F.substring_index(f, "=", 1)).alias("key"),
                           F.substring_index(f, "=", -1).alias("value")))
    named = F.transform(pairs, lambda p: F.struct(
        F.when(p["key"] == "policyid", F.lit("policy_id")).otherwise(p["key"]).alias("key"), p["value"].alias("value")))
    return F.map_from_entries(first_per_key(F.filter(named, lambda p: ~p["key"].isin(FIREWALL_KEYS))))


# ---------------------------------------------------------------------- windows
def parse_windows_event(frame: DataFrame, raw: Column) -> Parsed:
    """Windows event XML, read once per row into a struct."""
    frame = frame.withColumn("_doc", F.from_xml(raw, WINDOWS_XML, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}))
    doc = F.col("_doc")
    named = F.filter(F.coalesce(doc["EventData"]["Data"], F.array().cast("array<struct<_Name:string,_VALUE:string>>")),
                     lambda d: _text(d["_Name"]) != "")
    # The last value of a name counts, so the reversed list keeps its first.
    entries = F.reverse(F.transform(named, lambda d: F.struct(d["_Name"].alias("key"), _text(d["_VALUE"]).alias("value"))))
    frame = frame.withColumns({
        "_data": F.map_from_entries(first_per_key(entries)),
        "_code": F.coalesce(doc["System"]["EventID"].try_cast("int"), F.lit(0)),
    })
    data, code = F.col("_data"), F.col("_code")
    value = lambda *names: F.coalesce(*[F.try_element_at(data, F.lit(n)) for n in names], F.lit(""))
    known = lambda part, default: case_map(
        code, {number: entry[part] for number, entry in WINDOWS_CODES.items()}, default)
    frame = frame.withColumn("_address", value("IpAddress", "SourceNetworkAddress"))
    username, computer = value("TargetUserName", "UserName"), _text(doc["System"]["Computer"])
    return frame, {
        "timestamp": parse_timestamp(doc["System"]["TimeCreated"]["_SystemTime"]),
        "event_code": code, "action": known(0, "unknown_action"), "event_type": known(1, "system_log"),
        "severity": known(2, "info"), "username": username, "device_name": computer,
        "source_ip": normalize_ip(F.col("_address")),
        "metadata": merge_maps(
            F.transform_keys(data, lambda k, v: F.concat(F.lit("event_data."), k)),
            string_map({"event_id": code, "action": known(0, "unknown_action"), "username": username,
                        "computer": computer})),
    }


def agent_event_type(log_name: Column, event_code: Column) -> Column:
    return (
        F.when(F.lower(log_name) == "security",
               F.when(event_code.isin(AGENT_LOGON_CODES), F.lit("authentication_attempt"))
               .otherwise(F.lit("security_alert")))
        .when(F.lower(log_name) == "system", F.lit("system_log")).otherwise(F.lit("unknown"))
    )


def agent_event_severity(level: Column) -> Column:
    return case_map(level, AGENT_LEVEL_SEVERITY, "unknown")


# -------------------------------------------------------------- collector input
def detect_source_type(content_type: Column, body: Column) -> Column:
    kind, text = F.lower(content_type), F.upper(body)
    return (
        F.when(F.contains(kind, F.lit("application/json")), F.lit("cef_json"))
        .when(F.contains(kind, F.lit("text/plain")),
              F.when(F.startswith(text, F.lit("CEF:")), F.lit("cef_string")).otherwise(F.lit("syslog_string")))
        .when(F.contains(kind, F.lit("application/x-www-form-urlencoded")),
              F.when(F.contains(text, F.lit("CEF:")), F.lit("cef_string")).otherwise(F.lit("syslog_string")))
        .otherwise(F.lit("unknown"))
    )


def url_rows(texts: DataFrame, id_column: str, text: Column) -> DataFrame:
    """One row per URL token of each whole text, cleaned to printable ASCII."""
    return texts.select(id_column, F.posexplode(find_urls(text)).alias("position", "_url")) \
        .select(id_column, "position", clean_ascii(F.col("_url")).alias("url"))


def protocol_name(name: Column) -> Column:
    """Protocol names in any case; names outside the list are unknown."""
    folded = F.lower(name)
    return F.when(folded.isin(PROTOCOLS), folded).otherwise(F.lit("unknown"))


# ---------------------------------------------------------------------- routing
def as_normalized(parsed: dict[str, Column], envelope_id: Column, raw: Column, received_at: Column) -> Column:
    """A parser's columns as the normalized struct, defaults filled in. A line
    whose time cannot be read gets the time it was received."""
    defaults = {
        "id": envelope_id.cast("string"), "event_type": F.lit("unknown"), "severity": F.lit("info"),
        "source_ip": F.lit(""), "destination_ip": F.lit(""), "protocol": F.lit("unknown"), "payload": raw,
        "metadata": empty_map(),
    }
    columns = []
    for field in NORMALIZED.fields:
        value = parsed.get(field.name, defaults.get(field.name, F.lit(None)))
        if field.name == "timestamp":
            value = F.coalesce(value.cast("timestamp"), received_at.cast("timestamp"))
        columns.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*columns)


def passthrough(envelope_id: Column, raw: Column, received_at: Column, enrichment: Column) -> Column:
    """Normalized record of an envelope no parser takes."""
    return as_normalized({"metadata": enrichment, "timestamp": received_at}, envelope_id, raw, received_at)


def normalize_envelopes(envelopes: DataFrame, year: int | Column | None = None) -> DataFrame:
    """Adds the normalized record, chosen by source type regardless of case,
    and merges parsed metadata into the enrichment, where present keys win.

    Every parser sees only the lines of its own kind (null otherwise), so a row
    pays for one parser.
    """
    raw, key, received = F.col("raw"), F.col("event_id"), F.col("received_at")
    enrichment = F.coalesce(F.col("enrichment"), empty_map())
    kind = F.lower("source_type")
    parsers = {
        "syslog": lambda frame, line: parse_syslog(
            frame, line, F.col("source"), year if year is not None else F.year(received)),
        "apache": parse_access_log, "fortinet": parse_firewall, "windows-eventlog": parse_windows_event,
    }
    frame, choice, working = envelopes, None, set()
    for name, parse in parsers.items():
        frame, parsed = parse(frame, F.when(kind == name, raw))
        # Dropped here so that the next parser may use the same working names.
        used = [c for c in frame.columns if c not in envelopes.columns and c not in working]
        record = f"_{name}_record"
        frame = frame.withColumn(record, F.when(kind == name, as_normalized(parsed, key, raw, received))).drop(*used)
        working.add(record)
        choice = F.when(kind == name, F.col(record)) if choice is None else choice.when(kind == name, F.col(record))
    # A generator of one record: later filters on its fields stay above it and are
    # not rewritten into the parsers' expressions, which would explode the plan.
    record = choice.otherwise(passthrough(key, raw, received, enrichment))
    frame = frame.drop("normalized").select("*", F.explode(F.array(record)).alias("normalized"))
    merged = F.when(kind.isin(list(parsers)), merge_metadata(enrichment, F.col("normalized.metadata")))
    return frame.withColumn("enrichment", merged.otherwise(enrichment)).drop(*working)


def merge_metadata(enrichment: Column, metadata: Column) -> Column:
    """Enrichment keys win over parsed metadata keys."""
    return merge_maps(metadata, enrichment)
