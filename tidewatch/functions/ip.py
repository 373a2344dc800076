"""IP address expressions. Addresses stay text; the BIGINT form is for ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_EXACT = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
IPV4_LOOSE = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"

# Address blocks that never leave a site.
# 10/8, 172.16/12, 192.168/16, 169.254/16, 127/8; fc00::/7, fe80::/10, ::1.
PRIVATE_V4 = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|127\.)"
PRIVATE_V6 = r"^([0:]*:0*1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
IPV6_SPELLING = (
    r"^(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"
    r"|(?=(?::*[0-9a-f]+){0,7}:*$)(?:(?:[0-9a-f]{1,4}:){1,7}|:)(?:(?::[0-9a-f]{1,4}){1,7}|:))$"
)


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4_EXACT), F.lit(False))


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad as BIGINT, null when it is not one."""
    octets = F.split(F.nullif(F.regexp_extract(ip, IPV4_EXACT, 0), F.lit("")), r"\.")
    octet = lambda i: F.get(octets, F.lit(i)).cast("bigint")
    return octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3)


def _lowered(ip: Column) -> Column:
    return F.lower(F.trim(ip))


def is_ipv6(ip: Column) -> Column:
    """Any spelling: full, folded with ``::``, or with a dotted tail."""
    return F.coalesce(F.regexp_replace(_lowered(ip), rf"(?<=:){IPV4_EXACT[1:]}", "0:0").rlike(IPV6_SPELLING),
                      F.lit(False))


def canonical_ipv6(ip: Column) -> Column:
    """Shortest lower-case spelling of an IPv6 address, null when malformed.

    Expand to eight groups, drop leading zeros, then fold the longest run of
    zero groups. All of it is string functions, so no Python worker is needed.
    """
    tail = _dotted_tail(ip)
    short = let(let(_undotted(ip), _eight_groups), _fold_zeros)
    dotted = short.rlike(r"^::ffff:") & (tail != "")
    return F.when(is_ipv6(ip), F.when(dotted, F.concat(F.lit("::ffff:"), tail)).otherwise(short))


def ipv6_digits(ip: Column) -> Column:
    """All 128 bits of an IPv6 address as 32 hexadecimal digits, null when malformed."""
    groups = lambda text: F.split(_eight_groups(text), ":")
    digits = let(let(_undotted(ip), groups), lambda g: F.concat(*[F.lpad(F.get(g, F.lit(i)), 4, "0") for i in range(8)]))
    return F.when(is_ipv6(ip), digits)


def _dotted_tail(ip: Column) -> Column:
    return F.regexp_extract(_lowered(ip), rf"({IPV4_LOOSE})$", 1)


def _undotted(ip: Column) -> Column:
    """The address with a dotted tail written as two groups."""
    tail = _dotted_tail(ip)
    return F.when(tail == "", _lowered(ip)).otherwise(let(ipv4_to_long(tail), lambda n: F.concat(
        F.regexp_replace(_lowered(ip), rf"{IPV4_LOOSE}$", ""),
        F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535))))))


def _group_count(part: Column) -> Column:
    return F.when(part == "", F.lit(0)).otherwise(F.size(F.split(part, ":")))


def _eight_groups(text: Column) -> Column:
    left, right = F.substring_index(text, "::", 1), F.substring_index(text, "::", -1)
    missing = F.greatest(F.lit(8) - _group_count(left) - _group_count(right), F.lit(0))
    filler = F.rtrim(F.repeat(F.lit("0:"), missing), F.lit(":"))
    expanded = F.when(F.contains(text, F.lit("::")), F.concat_ws(
        ":", F.nullif(left, F.lit("")), filler, F.nullif(right, F.lit("")))).otherwise(text)
    return F.regexp_replace(expanded, r"(^|:)0+(?=[0-9a-f])", "$1")


def _fold_zeros(groups: Column) -> Column:
    folded = groups
    for run in range(2, 9):
        zeros = rf"(?:^|:)0(?::0){{{run - 1}}}(?::|$)"
        folded = F.when(groups.rlike(zeros), F.regexp_replace(groups, rf"^(.*?){zeros}(.*)$", "$1::$2")) \
            .otherwise(folded)
    return folded


def normalize_ip(ip: Column) -> Column:
    """Canonical text of a valid address, otherwise the empty string."""
    text = F.trim(ip)
    return (
        F.when(is_ipv4(text), text)
        .when(F.contains(text, F.lit(":")), F.coalesce(canonical_ipv6(text), F.lit("")))
        .otherwise(F.lit(""))
    )


def is_private_ip(ip: Column) -> Column:
    """Site-local, link-local and loopback addresses of both families."""
    text = F.trim(ip)
    return (
        F.when(is_ipv4(text), text.rlike(PRIVATE_V4))
        .when(is_ipv6(text), F.lower(text).rlike(PRIVATE_V6))
        .otherwise(F.lit(False))
    )


def is_public_ip(ip: Column) -> Column:
    text = F.trim(ip)
    return (is_ipv4(text) | is_ipv6(text)) & ~is_private_ip(text)
