"""Row layouts and the fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Enumerations are stored as snake_case strings; position gives the rank.
EVENT_TYPES = [
    "unknown", "network_traffic", "dns_query", "http_request", "tls_handshake", "ssh_connection",
    "file_access", "process_execution", "authentication_attempt", "system_log", "security_alert",
]
SEVERITIES = ["unknown", "info", "low", "medium", "high", "critical"]
RULE_SEVERITIES = ["low", "medium", "high", "critical"]
PROTOCOLS = ["unknown", "tcp", "udp", "icmp", "http", "https", "dns", "ssh", "ftp", "smtp", "tls"]
CRITICALITIES = ["low", "medium", "high", "critical"]
ASSET_TYPES = ["host", "service", "database", "firewall", "network_device", "iot", "other"]
ALERT_STATUSES = [
    "new", "pending_score", "acknowledged", "under_investigation", "resolved", "closed", "false_positive",
]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "CONNECT"]

# Lifecycle moves an analyst may make. Staying put is always allowed.
STATUS_MOVES = {
    "new": ["acknowledged", "pending_score", "false_positive"],
    "pending_score": ["new", "acknowledged", "false_positive"],
    "acknowledged": ["under_investigation", "resolved", "false_positive"],
    "under_investigation": ["resolved", "closed", "false_positive"],
    "resolved": ["closed", "acknowledged"],
    "closed": ["acknowledged"],
    "false_positive": ["closed"],
}

# Event type names accepted in rule triggers besides the stored ones.
EVENT_TYPE_ALIASES = {"authentication_failure": "authentication_attempt"}


# -------------------------------------------------------------------- layouts
def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STRING_MAP = T.MapType(T.StringType(), T.StringType())

NORMALIZED = _struct(
    id=T.StringType(), timestamp=T.TimestampType(), event_type=T.StringType(), severity=T.StringType(),
    source_ip=T.StringType(), destination_ip=T.StringType(), source_port=T.IntegerType(),
    destination_port=T.IntegerType(), protocol=T.StringType(), payload=T.StringType(), metadata=STRING_MAP,
    device_name=T.StringType(), sensor_id=T.StringType(), username=T.StringType(), hostname=T.StringType(),
)

ENVELOPE = _struct(
    event_id=T.StringType(), received_at=T.TimestampType(), source=T.StringType(), source_type=T.StringType(),
    raw=T.StringType(), normalized=NORMALIZED, enrichment=STRING_MAP, schema_version=T.StringType(),
)

FLAT_EVENT = _struct(
    event_id=T.StringType(), received_at=T.TimestampType(), event_timestamp=T.TimestampType(),
    event_type=T.StringType(), severity=T.StringType(), source_ip=T.StringType(), destination_ip=T.StringType(),
    source_port=T.IntegerType(), destination_port=T.IntegerType(), protocol=T.StringType(),
    username=T.StringType(), hostname=T.StringType(), device_name=T.StringType(), source=T.StringType(),
    source_type=T.StringType(),
)

ASSET = _struct(
    id=T.StringType(), name=T.StringType(), ip_address=T.StringType(), hostname=T.StringType(),
    asset_type=T.StringType(), criticality=T.StringType(), owner=T.StringType(),
    tags=T.ArrayType(T.StringType()), description=T.StringType(), created_at=T.TimestampType(),
    updated_at=T.TimestampType(),
)

ASSET_CSV = _struct(
    hostname=T.StringType(), ip=T.StringType(), asset_type=T.StringType(), criticality=T.StringType(),
    owner=T.StringType(), tags=T.StringType(),
)

PACKET = _struct(
    id=T.LongType(), source_ip=T.StringType(), destination_ip=T.StringType(), protocol=T.StringType(),
    timestamp=T.TimestampType(), source_port=T.IntegerType(), destination_port=T.IntegerType(),
    payload_preview=T.StringType(), sni=T.StringType(), raw_payload=T.StringType(), metadata=STRING_MAP,
)

# Responses of the two reputation services, as landed JSON.
ABUSE_RESPONSE = "data STRUCT<abuseConfidenceScore: INT, totalReports: INT, lastReportedAt: STRING>"
PULSE_RESPONSE = "pulse_info STRUCT<count: INT, pulses: ARRAY<STRUCT<name: STRING, modified: STRING>>>"

# Month-partitioned analytic tables: event-time column, sort key, days kept.
ANALYTIC_TABLES = {
    "events": ("event_timestamp", ["username", "event_timestamp"], 30),
    "network_events": ("event_time", ["src_ip", "dst_ip", "event_time"], 90),
    "security_alerts": ("alert_time", ["severity", "alert_time"], 180),
    "dns_queries": ("query_time", ["src_ip", "query_time"], 30),
    "tls_sessions": ("session_time", ["src_ip", "session_time"], 30),
    "application_metrics": ("metric_time", ["service_name", "metric_name", "metric_time"], 30),
    "baseline_features": ("calculated_at", ["metric_type", "username", "hostname"], 7),
    "audit_events": ("timestamp", ["user_name", "timestamp"], 730),
    "alerts": ("created_at", ["severity", "created_at"], 90),
}
