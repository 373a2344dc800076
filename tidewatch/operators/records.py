"""Asset and audit reads and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import all_of
from ..model import STRING_MAP
from .enrichment import apply_changes
from .paging import rows_at


# ---------------------------------------------------------------------- assets
def list_assets(assets: DataFrame, search: str | None = None, asset_type: str | None = None,
                criticality: str | None = None, owner: str | None = None, tag: str | None = None,
                page: int = 1, size: int = 50) -> DataFrame:
    """Newest assets first that meet every given filter."""
    tests = []
    if search:
        pattern = f"%{search}%"
        tests.append(F.col("name").ilike(pattern) | F.col("ip_address").ilike(pattern)
                     | F.col("hostname").ilike(pattern))
    if asset_type:
        tests.append(F.col("asset_type") == asset_type.lower())
    if criticality:
        tests.append(F.col("criticality") == criticality.lower())
    if owner:
        tests.append(F.col("owner").ilike(f"%{owner}%"))
    if tag:
        tests.append(F.array_contains("tags", tag))
    page, size = max(page, 1), max(size, 1)
    return rows_at(assets.filter(all_of(tests)), [F.desc("created_at"), F.asc("id")], "created_at", (page - 1) * size, size)


def lookup_asset(assets: DataFrame, asset_id=None, ip: str | None = None, hostname: str | None = None) -> DataFrame:
    if asset_id is not None:
        return assets.filter(F.col("id") == asset_id)
    if ip is not None:
        return assets.filter(F.col("ip_address") == ip)
    return assets.filter(F.lower("hostname") == (hostname or "").lower())


def change_assets(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """Created, updated and deleted assets applied to the table; the change
    time becomes ``updated_at``."""
    return apply_changes(assets, changes.withColumn("updated_at", F.col("changed_at")))


# ----------------------------------------------------------------------- audit
def search_audit(audit: DataFrame, user: str | None = None, action: str | None = None,
                 resource_type: str | None = None, resource_id: str | None = None, since: Column | None = None,
                 until: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest audit events that meet every given filter; as many as ``limit`` says."""
    equalities = {"user_name": user, "action": action, "resource_type": resource_type, "resource_id": resource_id}
    tests = [F.col(name) == value for name, value in equalities.items() if value is not None]
    if since is not None:
        tests.append(F.col("timestamp") >= since)
    if until is not None:
        tests.append(F.col("timestamp") <= until)
    return rows_at(audit.filter(all_of(tests)), [F.desc("timestamp"), F.asc("id")], "timestamp", offset, limit)


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("user_name", "action", "resource_type", "status",
                         F.to_date("timestamp").alias("event_date")).agg(F.count("*").alias("event_count"))


def decode_audit(audit: DataFrame) -> DataFrame:
    """JSON state columns as string maps."""
    return audit.withColumns({name: F.from_json(name, STRING_MAP) for name in ("old_state", "new_state", "metadata")})
