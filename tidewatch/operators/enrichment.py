"""Joins that attach geography, assets and packet names to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.basic import empty_map, epoch_micros, floor_div, floor_div_by
from ..functions.ip import ipv4_to_long, ipv6_digits, is_private_ip
from ..model import CRITICALITIES
from .fields import merge_maps
from .parsing import string_map

ASSET_FIELDS = ["id", "name", "criticality", "owner", "asset_type", "tags"]

# No join below hints a broadcast: sides grow with the site. Spark broadcasts a
# side it has measured as small and otherwise shuffles, where adaptive execution
# splits the partitions of a hot address.


# ------------------------------------------------------------------- geography
# An address is a key of its family and its bytes in hexadecimal; a block of addresses is the
# beginning of such a key. IPv4 has 4 levels of blocks, IPv6 16.
GEO_LEVELS = {4: 4, 6: 16}


def network_ranges(networks: DataFrame, column: str = "network") -> DataFrame:
    """Networks written as ``address/bits`` of either family, with ``family`` and, for IPv4,
    ``start_ip`` and ``end_ip``, for IPv6 ``prefix`` (32 hexadecimal digits) and ``bits``."""
    address, bits = F.substring_index(column, "/", 1), F.substring_index(column, "/", -1).cast("int")
    six = F.contains(F.col(column), F.lit(":"))
    number = F.when(~six, ipv4_to_long(address))
    return networks.withColumns({
        "family": F.when(six, 6).otherwise(4), "prefix": F.when(six, ipv6_digits(address)), "bits": bits,
        "_size": F.when(~six, F.pow(F.lit(2.0), 32 - bits).cast("bigint"))}) \
        .withColumn("start_ip", floor_div_by(number, F.col("_size")) * F.col("_size")) \
        .withColumn("end_ip", F.col("start_ip") + F.col("_size") - 1).drop("_size")


def geo_blocks(ranges: DataFrame) -> DataFrame:
    """Ranges cut into aligned blocks, one row per ``geo_block``, with the range's size as ``geo_size``.

    A block lies wholly inside its range, so an address lies in a range if one of
    its beginnings is a block of the range: an equality. A level of IPv4 adds what the coarser
    ones left over at the two ends, at most 255 blocks each; an IPv6 network is at
    most 256 blocks of one level. What lies beyond the last IPv4 address holds none and gets no block.
    """
    start, after = F.col("start_ip"), F.col("end_ip") + 1
    size, space = (after - start).cast("double"), 1 << 32
    after = F.when(after > space, F.lit(space)).otherwise(after)
    parts = []
    for level in range(1, 5):
        shift = 32 - 8 * level
        first, last = _ceil_shift(start, shift), F.shiftright(after, shift)
        found = _blocks(first, last)
        if level > 1:
            left, right = _ceil_shift(start, shift + 8), F.shiftright(after, shift + 8)
            whole = left < right
            found = F.concat(
                _blocks(first, F.when(whole, F.shiftleft(left, 8)).otherwise(last)),
                F.when(whole, _blocks(F.shiftleft(right, 8), last)).otherwise(_blocks(last, last)))
        parts.append(F.transform(found, _written(2 * level)))
    blocks = F.concat(*parts)
    if "prefix" in ranges.columns:
        bits, digits = F.col("bits"), F.col("prefix")
        whole = F.greatest(F.floor((bits - 1) / 8), F.lit(0)).cast("int")  # bytes before the one that the network ends in
        span = F.pow(F.lit(2), 8 * (whole + 1) - bits).cast("int")
        low = F.conv(F.substr(digits, 2 * whole + 1, F.lit(2)), 16, 10).cast("int")
        low = low - low % span
        six = F.transform(F.sequence(low, low + span - 1), lambda byte: F.concat(
            F.lit("6"), F.substr(digits, F.lit(1), 2 * whole), F.lower(F.lpad(F.hex(byte), 2, "0"))))
        blocks = F.when(F.col("family") == 6, six).otherwise(blocks)
        size = F.when(F.col("family") == 6, F.pow(F.lit(2.0), 128 - bits)).otherwise(size)
    return ranges.withColumn("geo_size", size).withColumn("geo_block", F.explode(blocks))


def _written(digits: int):
    return lambda block: F.concat(F.lit("4"), F.lower(F.lpad(F.hex(block), digits, "0")))


def _ceil_shift(value: Column, shift: int) -> Column:
    return F.shiftright(value + ((1 << shift) - 1), shift)


def _blocks(first: Column, after: Column) -> Column:
    return F.when(first < after, F.sequence(first, after - 1)).otherwise(F.array().cast("array<bigint>"))


def address_key(ip: Column) -> Column:
    """Family and bytes of an address in any spelling; null for anything else."""
    four = F.concat(F.lit("4"), F.lower(F.lpad(F.hex(ipv4_to_long(ip)), 8, "0")))
    return F.when(F.contains(ip, F.lit(":")), F.concat(F.lit("6"), ipv6_digits(ip))).otherwise(four)


def join_geo(events: DataFrame, ranges: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a struct with the location of each address column; ``columns`` maps it to its output.

    Private addresses get a fixed record; an address outside every range gets
    null. Ranges (BIGINT ``start_ip``..``end_ip``; or what ``network_ranges`` gives)
    may be nested: the smallest that holds an address counts.

    Distinct addresses are located first, by equality with the blocks; the events
    themselves meet the result once for each column. A stream knows no distinct
    addresses: there each level of blocks is one more join with the blocks of that level.
    A range is up to hundreds of blocks, which Spark does not foresee when it measures
    the table of ranges, so blocks are joined by sorting and never sent to the driver.
    """
    lookup = geo_blocks(ranges).select("geo_block", F.struct("geo_size", F.struct(
        F.coalesce("country", F.lit("Unknown")).alias("country"),
        F.coalesce("country_code", F.lit("XX")).alias("country_code"),
        F.coalesce("city", F.lit("Unknown")).alias("city"),
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"),
        F.coalesce("timezone", F.lit("UTC")).alias("timezone"), F.lit(False).alias("is_private"),
    ).alias("place")).alias("_found"))
    fixed = F.struct(
        F.lit("Private").alias("country"), F.lit("PR").alias("country_code"), F.lit("Private Network").alias("city"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.lit(None).cast("string").alias("timezone"), F.lit(True).alias("is_private"))
    if events.isStreaming:
        lookup = lookup.groupBy("geo_block").agg(F.min("_found").alias("_found"))
        for ip, output in columns.items():
            levels = max(GEO_LEVELS.values()) if "prefix" in ranges.columns else GEO_LEVELS[4]
            located = events.withColumn("_key", F.when(~is_private_ip(F.col(ip)), address_key(F.col(ip))))
            for level in range(1, levels + 1):
                side = lookup.where(F.length("geo_block") == 2 * level + 1).hint("merge").select(F.col("geo_block").alias("_at"), F.col("_found").alias(f"_found_{level}"))
                block = F.when(F.length("_key") > 2 * level, F.substring("_key", 1, 2 * level + 1))
                located = located.join(side, block == F.col("_at"), "left").drop("_at")
            found = [f"_found_{level}" for level in range(1, levels + 1)]
            place = F.array_min(F.array(*found))["place"]
            events = located.withColumn(output, F.when(is_private_ip(F.col(ip)), fixed).otherwise(place)).drop("_key", *found)
        return events

    addresses = events.select(F.explode(F.array(*columns)).alias("_ip")).distinct().where("_ip IS NOT NULL") \
        .withColumn("_key", address_key(F.col("_ip")))
    levels = F.sequence(F.lit(1), ((F.length("_key") - 1) / 2).cast("int"))
    beginnings = F.transform(levels, lambda level: F.substr(F.col("_key"), F.lit(1), 2 * level + 1))
    blocks = F.when(is_private_ip(F.col("_ip")), F.array(F.lit("private"))).otherwise(beginnings)
    private = events.sparkSession.range(1).select(F.lit("private").alias("geo_block"), F.struct(
        F.lit(0.0).alias("geo_size"), fixed.alias("place")).alias("_found"))
    places = addresses.select("_ip", F.explode(blocks).alias("geo_block")).join(lookup.unionByName(private).hint("merge"), "geo_block") \
        .groupBy("_ip").agg(F.min("_found")["place"].alias("_place"))
    # Rows without an address are dealt out over keys that no address has.
    nowhere = F.concat(F.lit(" "), (F.monotonically_increasing_id() % 4096).cast("string"))
    for ip, output in columns.items():
        events = events.withColumn("_key", F.coalesce(F.col(ip), nowhere)) \
            .join(places.withColumnsRenamed({"_ip": "_key", "_place": output}), "_key", "left").drop("_key")
    return events


# ---------------------------------------------------------------------- assets
def latest_assets(assets: DataFrame, key: Column, name: str) -> DataFrame:
    """Newest asset per key. The ranking is limited before the shuffle, so a
    key with many versions sends one row per task."""
    newest = Window.partitionBy(name).orderBy(F.desc("updated_at"), F.desc("id"))
    return assets.withColumn(name, key).filter(F.col(name).isNotNull() & (F.col(name) != "")) \
        .withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def asset_lookup(assets: DataFrame) -> DataFrame:
    """(lookup_key, asset): by address, else by lower-case host name."""
    asset = F.struct(*ASSET_FIELDS)
    keyed = (
        assets.select("updated_at", "id", asset.alias("asset"), F.explode(F.array(
            F.struct(F.col("ip_address").alias("key"), F.lit(0).alias("way")),
            F.struct(F.lower("hostname").alias("key"), F.lit(1).alias("way")),
        )).alias("_by"))
        .select("updated_at", "id", "asset", F.col("_by.key").alias("lookup_key"), F.col("_by.way").alias("_way"))
        .filter(F.col("lookup_key").isNotNull() & (F.col("lookup_key") != ""))
    )
    best = Window.partitionBy("lookup_key").orderBy("_way", F.desc("updated_at"), F.desc("id"))
    return keyed.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == 1) \
        .select("lookup_key", "asset")


def join_assets(events: DataFrame, lookup: DataFrame,
                sides: tuple[tuple[str, str], ...] = (("source_ip", "source_asset"),
                                                      ("destination_ip", "destination_asset"))) -> DataFrame:
    """Adds an asset struct for each (address column, output) pair."""
    for column, output in sides:
        side = lookup.select(F.col("lookup_key").alias("_key"), F.col("asset").alias(output))
        events = events.join(side, F.lower(F.col(column)) == F.col("_key"), "left").drop("_key")
    return events


def asset_or_lookup(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """Asset already attached to the event first, direct lookup where absent;
    source and destination are decided independently."""
    joined = join_assets(events, lookup, (("source_ip", "_source_found"), ("destination_ip", "_destination_found")))
    return joined.withColumns({
        "source_asset": F.coalesce("source_asset", "_source_found"),
        "destination_asset": F.coalesce("destination_asset", "_destination_found"),
    }).drop("_source_found", "_destination_found")


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str = "id", order: str = "changed_at",
                  operation: str = "operation") -> DataFrame:
    """A snapshot after a change feed: the newest change per key wins and a
    ``deleted`` one removes the row. Rows without changes pass untouched."""
    newest = Window.partitionBy(key).orderBy(F.desc(order), F.desc(operation))
    last = changes.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1)
    kept = snapshot.join(last.select(key), key, "left_anti")
    written = last.filter(F.col(operation) != "deleted").select(*snapshot.columns)
    return kept.unionByName(written)


def criticality_rank(asset: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in reversed(list(enumerate(CRITICALITIES))):
        rank = F.when(F.lower(asset["criticality"]) == name, F.lit(position)).otherwise(rank)
    return rank


# ------------------------------------------------------------- packets and names
def join_packet_names(packets: DataFrame, names: DataFrame, within_seconds: int = 5) -> DataFrame:
    """Every packet with all names seen on its address pair less than
    ``within_seconds`` away, or with null.

    Names are repeated for the one or two time cells their interval touches and
    each packet lies in one cell, so a busy pair is split along time and no
    pair of rows is compared twice.
    """
    reach = within_seconds * 1_000_000
    cell = 2 * reach
    left = packets.withColumn("_at", epoch_micros(F.col("packet_ts"))) \
        .withColumn("_cell", floor_div(F.col("_at"), cell))
    at = epoch_micros(F.col("name_ts"))
    right = names.select(
        F.col("src_ip").alias("_src"), F.col("dst_ip").alias("_dst"), "sni", "name_ts", at.alias("_name_at"),
        F.explode(F.sequence(floor_div(at - reach, cell), floor_div(at + reach, cell))).alias("_name_cell"))
    return left.join(
        right,
        (F.col("src_ip") == F.col("_src")) & (F.col("dst_ip") == F.col("_dst"))
        & (F.col("_cell") == F.col("_name_cell")) & (F.abs(F.col("_at") - F.col("_name_at")) < reach),
        "left",
    ).drop("_at", "_cell", "_src", "_dst", "_name_at", "_name_cell")


# ------------------------------------------------------------------ on the event
# The keys under which enrichments travel with an event.
GEO_KEYS = {"source_geo": "source_geo", "destination_geo": "dest_geo"}
GEO_JSON = ("struct<country:string,countryCode:string,city:string,lat:double,lon:double,timezone:string,"
            "isPrivate:boolean>")
ASSET_KEYS = {"source_asset": "source_asset", "destination_asset": "destination_asset"}


def write_enrichment(events: DataFrame, parts: dict[str, str], enrichment: str = "enrichment") -> DataFrame:
    """The struct or map columns of ``parts`` as JSON in the ``enrichment`` map, so that
    they travel with the event; absent ones leave no key."""
    body = lambda column: F.col(column).cast(GEO_JSON) if column in GEO_KEYS else F.col(column)
    present = {key: F.to_json(body(column)) for column, key in parts.items() if column in events.columns}
    if not present:
        return events
    carried = F.coalesce(enrichment, empty_map()) if enrichment in events.columns else empty_map()
    return events.withColumn(enrichment, merge_maps(carried, string_map(present))) \
        .drop(*[column for column in parts if column in events.columns])
