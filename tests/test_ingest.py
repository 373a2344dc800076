import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import parsing as P
from tidewatch.operators.quality import validate_events
from tidewatch.sources.envelopes import decode_envelopes, encode_envelopes, flatten_events

WINDOWS = """<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>{code}</EventID>
<TimeCreated SystemTime='2024-01-15T10:30:00.000Z'/><Computer>PC-1</Computer></System><EventData>{data}</EventData></Event>"""


def parsed(spark, parse, lines, *wanted):
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, raw string")
    frame, columns = parse(frame)
    rows = frame.orderBy("i").select(*[columns[name].alias(name) for name in wanted]).collect()
    return [tuple(row) for row in rows]


def test_syslog_lines(spark):
    lines = [
        "<190>1 2024-01-15T10:31:00.123456Z hostname tag 12345 - - Failed password for invalid user admin from "
        "192.168.1.50 port 54321 ssh2",
        "Jan 15 10:31:00 hostname sudo[12345]: admin : TTY=pts/0 ; PWD=/home/admin ; USER=root ; COMMAND=/bin/bash",
        "Jan 15 10:31:00 host sshd[12345]: Failed password for invalid user test from 203.0.113.45 port 45678 ssh2",
        "<34>1 2024-01-15T10:31:00Z gate su[9]: access denied", "", None,
    ]
    out = parsed(spark, lambda f: P.parse_syslog(f, F.col("raw"), F.lit("src"), 2024), lines,
                 "device_name", "tag", "priority", "source_ip", "event_type", "severity", "mark")
    assert out[0] == ("hostname", "tag", 190, "192.168.1.50", "ssh_connection", "low", "ssh_failed_login")
    assert out[1] == ("hostname", "sudo", 0, "", "process_execution", "critical", None)
    assert out[2][:4] == ("host", "sshd", 0, "203.0.113.45")
    assert out[3] == ("gate", "su", 34, "", "security_alert", "critical", "access_denied")
    assert out[4][:3] == ("src", "", 0)


def test_access_lines(spark):
    lines = [
        '192.168.1.100 - admin [15/Jan/2024:10:31:00 +0000] "GET /api/users HTTP/1.1" 200 1234 "https://example.com" '
        '"Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36"',
        '10.0.0.50 - - [15/Jan/2024:10:31:01 +0000] "POST /nonexistent HTTP/1.1" 404 512 "-" "curl/7.81.0"',
        '203.0.113.1 - - [15/Jan/2024:10:31:02 +0000] "GET /admin HTTP/1.1" 500 1024 "-" "Mozilla/5.0" 37',
        "garbage",
    ]
    out = parsed(spark, lambda f: P.parse_access_log(f, F.col("raw")), lines, "source_ip", "http_method", "path",
                 "http_status", "event_type", "severity", "response_time_ms", "timestamp")
    assert out[0][:7] == ("192.168.1.100", "GET", "/api/users", 200, "http_request", "info", None)
    assert out[1][3:6] == (404, "http_request", "low") and out[2][3:7] == (500, "security_alert", "high", 37)
    assert out[0][7] == datetime(2024, 1, 15, 10, 31) and out[3] == ("", "", "", 0, "http_request", "unknown", None, None)


def test_firewall_lines(spark):
    lines = [
        "CEF:0|Fortinet|FortiGate|7.0.0|0000000013|forward traffic accept|3|action=accept srcip=10.0.0.1 dstip=8.8.8.8 "
        "srcport=1234 dstport=443 proto=6 policyid=4 service=HTTPS",
        "action=deny srcip=203.0.113.50 dstip=192.168.1.1 srcport=45678 dstport=445 proto=6 policyid=0 service=smb",
        "action=accept srcip=999.1.1.1 srcport=x proto=17 a=1 A=2 b=c=d",
    ]
    out = parsed(spark, lambda f: P.parse_firewall(f, F.col("raw")), lines, "action", "source_ip", "destination_port",
                 "protocol", "event_type", "severity", "metadata")
    assert out[0][:6] == ("accept", "10.0.0.1", 443, "tcp", "network_traffic", "low")
    assert out[0][6]["signature_id"] == "0000000013" and out[0][6]["policy_id"] == "4"
    assert out[1][:6] == ("deny", "203.0.113.50", 445, "tcp", "security_alert", "medium")
    assert out[2][:6] == ("accept", "", None, "udp", "network_traffic", "info")
    assert out[2][6] == {"a": "1", "action": "accept"}


def test_windows_events(spark):
    data = lambda **kv: "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in kv.items())
    lines = [
        WINDOWS.format(code=4624, data=data(TargetUserName="john", UserName="x", IpAddress="192.168.1.100")),
        WINDOWS.format(code=4625, data=data(UserName="attacker", IpAddress="FE80::0:1")),
        WINDOWS.format(code=1, data=""), "<broken", "",
    ]
    out = parsed(spark, lambda f: P.parse_windows_event(f, F.col("raw")), lines, "event_code", "action", "username",
                 "source_ip", "severity", "device_name", "metadata")
    assert out[0][:6] == (4624, "login_success", "john", "192.168.1.100", "info", "PC-1")
    assert out[0][6]["event_data.UserName"] == "x"
    assert out[1][:5] == (4625, "login_failed", "attacker", "fe80::1", "medium")
    assert out[2][:3] == (1, "unknown_action", "") and out[3][:3] == (0, "unknown_action", "")


def test_collector_lines(spark):
    lines = ["<13>1 2024-01-15T10:31:00Z - app 1 - [a b=\"c\"] hello", "<13>Jan  5 10:31:00 h cron: tick", "<13>  bare",
             "plain", "<x>odd"]
    out = parsed(spark, lambda f: P.parse_syslog_collector(f, F.col("raw"), 2024), lines, "facility", "severity_code",
                 "hostname", "tag", "message")
    assert out == [(1, 5, "", "app", "hello"), (1, 5, "h", "cron", "tick"), (1, 5, "", "", "bare"),
                   (None, None, "", "", "plain"), (None, None, "", "", "<x>odd")]


ENVELOPE = {
    "eventId": "550e8400", "receivedAt": "2024-01-15T10:30:00Z", "source": "sensor-01", "sourceType": "network-sensor",
    "raw": "{}", "normalized": {"id": "n1", "timestamp": "2024-01-15T10:29:59.5Z", "eventType": "NetworkTraffic",
                                "severity": "high", "sourceIp": "10.0.0.1", "destinationIp": "", "destinationPort": 443,
                                "protocol": "TCP", "metadata": {"bytes": 5}},
    "enrichment": {"geoLocation": {"country": "X", "city": "Y"}, "asn": 64500}, "schemaVersion": "v1.0",
}


def test_envelopes_round_trip_and_poison(spark):
    lines = [json.dumps(ENVELOPE), "not json", json.dumps({"other": 1})]
    rows = decode_envelopes(spark.createDataFrame([(line,) for line in lines], "value string"))
    found = rows.collect()
    assert [r.decoded for r in found] == [True, False, False]
    first = found[0]
    assert first.normalized.event_type == "network_traffic" and first.normalized.protocol == "tcp"
    assert first.normalized.metadata == {"bytes": "5"} and json.loads(first.enrichment["geoLocation"])["city"] == "Y"
    again = decode_envelopes(encode_envelopes(rows.filter("decoded")).select("value")).first()
    assert again.normalized == first.normalized and again.received_at == first.received_at
    message = json.loads(encode_envelopes(rows.filter("decoded")).first().value)
    assert "username" not in message["normalized"] and message["eventId"] == "550e8400"
    flat = flatten_events(rows.filter("decoded")).first()
    assert (flat.username, flat.source_port, flat.destination_port, flat.event_month) == ("", 0, 443, "2024-01")
    assert flat.event_timestamp == datetime(2024, 1, 15, 10, 29, 59, 500000)


def test_unknown_sources_pass_through(spark):
    frame = spark.createDataFrame(
        [("1", datetime(2024, 1, 1), "s", "SYSLOG", "Jan 02 03:04:05 h t: m", {"tag": "given"}),
         ("2", datetime(2024, 1, 1), "s", "fax", "beep", {"k": "v"}), ("3", datetime(2024, 1, 1), "s", None, None, None)],
        "event_id string, received_at timestamp, source string, source_type string, raw string, "
        "enrichment map<string,string>")
    rows = {r.event_id: r for r in P.normalize_envelopes(frame).collect()}
    assert rows["1"].enrichment["tag"] == "given" and rows["1"].normalized.timestamp == datetime(2024, 1, 2, 3, 4, 5)
    assert rows["2"].normalized.metadata == {"k": "v"} and rows["2"].normalized.timestamp == datetime(2024, 1, 1)
    assert rows["3"].normalized.event_type == "unknown"


def test_validation(spark):
    frame = spark.createDataFrame(
        [("1", datetime(2024, 1, 1), "dns_query", "high", "1.2.3.4", "", "tcp", 80, 5),
         ("2", None, "dance", "high", "x", "::1", None, 70000, -1)],
        "id string, timestamp timestamp, event_type string, severity string, source_ip string, destination_ip string, "
        "protocol string, source_port int, bytes_sent int")
    good, bad = validate_events(frame).orderBy("id").collect()
    assert good.is_valid and good.errors == []
    assert len(bad.errors) == 7
