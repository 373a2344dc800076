import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.grok import grok_extract
from tidewatch.functions.ip import ipv4_to_long, is_ipv6, is_private_ip, is_public_ip, normalize_ip
from tidewatch.functions.text import clean_ascii, find_urls, mask_email, sanitize, sanitize_ascii
from tidewatch.functions.timeparse import parse_timestamp


def values(spark, rows, build):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [row.out for row in frame.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_ipv6_against_the_standard_library(spark):
    random.seed(3)
    texts = ["::", "::1", "1::", "2001:DB8::0:1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "fe80::", "::ffff:1.2.3.4",
             "64:ff9b::10.0.0.1", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", ":::", "1:2:3", "g::1", "::1.2.3.400"]
    for _ in range(300):
        groups = [random.choice(["0", "0", "0000", "%x" % random.randrange(65536), "%04X" % random.randrange(256)])
                  for _ in range(8)]
        texts.append(":".join(groups))
    def expected(text):
        try:
            address = ipaddress.IPv6Address(text)
        except ValueError:
            return ""
        if address.ipv4_mapped and "." in text:
            return f"::ffff:{address.ipv4_mapped}"
        # The library prints mapped addresses dotted in newer versions; compare in groups.
        return address.compressed if "." not in address.compressed else None
    found = values(spark, texts, normalize_ip)
    for text, got in zip(texts, found):
        want = expected(text)
        if want is not None:
            assert got == want, text
    assert values(spark, texts, is_ipv6) == [bool(ipaddress_ok(t)) for t in texts]


def ipaddress_ok(text):
    try:
        return ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def test_ipv4(spark):
    rows = ["1.2.3.4", " 10.0.0.1 ", "256.1.1.1", "1.2.3", "01.2.3.4", "", None, "x"]
    assert values(spark, rows, normalize_ip) == ["1.2.3.4", "10.0.0.1", "", "", "", "", "", ""]
    assert values(spark, ["1.2.3.4", "255.255.255.255", "1.2.3.4.5", None], ipv4_to_long) == [
        16909060, 4294967295, None, None]


def test_private_ranges(spark):
    private = ["10.0.0.0", "10.255.255.255", "172.16.0.1", "172.31.255.255", "192.168.1.1", "169.254.9.9", "127.0.0.1",
               "::1", "0:0:0:0:0:0:0:1", "fc00::1", "FD12::9", "fe80::1", "febf::1"]
    public = ["9.255.255.255", "11.0.0.1", "172.15.0.1", "172.32.0.1", "192.169.0.1", "169.253.0.1", "128.0.0.1",
              "2001:db8::1", "fec0::1", "::2", "100.64.0.1"]
    assert all(values(spark, private, is_private_ip)) and not any(values(spark, private, is_public_ip))
    assert not any(values(spark, public, is_private_ip)) and all(values(spark, public, is_public_ip))
    assert not any(values(spark, ["", None, "x.y", "300.1.1.1"], is_public_ip))


def test_masking(spark):
    rows = ["mail joanna.x@corp.example.org now", "ab@x.io", "a@b", "one@a.com two@b.co.uk", None, "no address"]
    assert values(spark, rows, mask_email) == [
        "mail j***x@c***@***org now", "***@x***@***io", "a@b", "o***e@a***@***com t***o@b***@***uk", None, "no address"]


def test_cleaning(spark):
    assert values(spark, ["aé\tb\x7f" + "c" * 300], sanitize_ascii) == ["ab" + "c" * 253]
    assert values(spark, ["http://a.é/" + "c" * 2000], clean_ascii) == ["http://a./" + "c" * 2000]
    assert values(spark, ["a\x07b\nc\td\x85"], sanitize) == ["ab\nc\td"]
    assert values(spark, ["see https://a.b/c?d www.e.f end"], find_urls) == [["https://a.b/c?d", "www.e.f"]]


@pytest.mark.parametrize("text,year,expected", [
    ("2024-01-15T10:31:00.123456Z", None, "2024-01-15 10:31:00.123456"),
    ("2024-01-15T10:31:00", None, "2024-01-15 10:31:00"),
    ("2024-01-15T10:31:00+02:00", None, "2024-01-15 08:31:00"),
    ("15/Jan/2024:10:31:00 +0100", None, "2024-01-15 09:31:00"),
    ("15/Jan/2024:10:31:00", None, "2024-01-15 10:31:00"),
    ("Jan 15 10:31:00", 2023, "2023-01-15 10:31:00"), ("Jan  5 10:31:00", 2023, "2023-01-05 10:31:00"),
    ("Jan 15 10:31:00", None, None), ("2024-01-15 10:31:00", None, "2024-01-15 10:31:00"),
    ("yesterday", 2023, None), ("", 2023, None),
])
def test_timestamps(spark, text, year, expected):
    assert values(spark, [text], lambda c: parse_timestamp(c, year).cast("string")) == [expected]


def test_grok(spark):
    frame = spark.createDataFrame([("x K=12 y",), ("k= z",), ("none",)], "v string")
    frame, groups = grok_extract(frame, F.col("v"), r"k=(?<num>\d*)\s(?<rest>\w)", "_g")
    assert [tuple(r) for r in frame.select(groups["num"], groups["rest"]).collect()] == [
        ("12", "y"), (None, "z"), (None, None)]


@pytest.mark.parametrize("sign", ["\x01", "\x02", "\x01\x02", "\x02\x03", "\x02\x04\x01"])
def test_grok_keeps_separators_in_the_text(spark, sign):
    for at in range(4):
        parts = ["12", "y z", "end"]
        text = " ".join(parts[:at] + [f"a{sign}b"] + parts[at:])
        frame = spark.createDataFrame([(text,)], "v string")
        frame, groups = grok_extract(frame, F.col("v"), r"^(?<one>\S+)\s(?<two>.*)\s(?<three>\S+)$", "_g")
        words = text.split(" ")
        assert tuple(frame.select(groups["one"], groups["two"], groups["three"]).first()) == (
            words[0], " ".join(words[1:-1]), words[-1])


def test_geography_of_both_families_without_pairs(spark):
    """Ranges of any width against the standard library, at both ends and in between."""
    import ipaddress
    import random

    from tidewatch.operators.enrichment import geo_blocks, join_geo, network_ranges

    rng = random.Random(3)
    networks = ["15.0.0.0/8", "12.34.0.0/15", "13.1.2.0/25", "13.1.2.128/32", "16.0.0.0/6",
                "2001:db8::/32", "2001:db9:8000::/33", "2a00::/12", "2001:dba:1:2::/64", "2001:dbb::/47",
                # Nested: the innermost counts. From 8000:: up, and the whole of a family.
                "15.7.0.0/16", "15.7.9.0/24", "15.7.9.128/25", "2001:db8:1::/48", "2001:db8:1::a:0:0/96", "2001:db8:1::a:0:5/128",
                "9000::/4", "::/0"]
    nets = [ipaddress.ip_network(n) for n in networks]
    addresses = []
    for net in nets:
        first, last = int(net[0]), int(net[-1])
        kind = type(net[0])
        addresses += [str(kind(n)) for n in (first, last, first - 1, last + 1, rng.randint(first, last))
                      if 0 <= n < 1 << net.max_prefixlen]
    blank = ", ".join(f"cast(null as {kind}) {name}" for name, kind in (
        ("country_code", "string"), ("city", "string"), ("latitude", "double"), ("longitude", "double"),
        ("timezone", "string")))
    ranges = network_ranges(spark.createDataFrame([(n, n) for n in networks], "network string, country string")) \
        .selectExpr("*", *blank.split(", "))
    events = spark.createDataFrame([(a,) for a in addresses], "ip string")
    got = {r.ip: r.place and r.place.country for r in join_geo(events, ranges, {"ip": "place"}).collect()}
    for text in addresses:
        ip = ipaddress.ip_address(text)
        inside = [(net.prefixlen, name) for name, net in zip(networks, nets) if ip in net]
        want = max(inside)[1] if inside else None
        if ip.is_private:
            want = got[text] if got[text] == "Private" else want
        assert got[text] == want, text
    odd = spark.createDataFrame([(1000003, 9000017, "x")], "start_ip bigint, end_ip bigint, country string")
    covered = geo_blocks(odd).selectExpr("sum(shiftleft(1L, 4 * (9 - length(geo_block)))) n", "count(*) rows").first()
    assert covered.n == 9000017 - 1000003 + 1 and covered.rows < 2048
