"""IP addresses as native columns: validity, canonical text, bytes."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; without it, each use would repeat the value's whole expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _quad(ip: Column) -> Column:
    """The value of a dotted quad, null for anything else."""
    value = lambda x: F.aggregate(F.split(x, r"\."), F.lit(0).cast("bigint"), lambda a, p: a * 256 + p.try_cast("bigint"))
    return F.when(ip.rlike(rf"\A{IPV4}\z"), value(ip))


def _groups(ip: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 text, null for anything else."""
    as_hex = lambda q: F.concat_ws(":", F.hex(F.floor(q / 65536).cast("bigint")), F.hex(q % 65536))
    plain = let(F.regexp_extract(ip, rf":({IPV4})\z", 1), lambda tail: F.when(tail != "", F.concat(F.substring(ip, F.lit(1), F.length(ip) - F.length(tail)), as_hex(_quad(tail)))).otherwise(ip))
    side = lambda x: F.when(x == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(x, ":", -1))

    def eight(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.expr("cast(array() as array<string>)"))
        n = F.size(left) + F.size(right)
        well = F.forall(F.concat(left, right), lambda x: x.rlike(r"\A[0-9A-Fa-f]{1,4}\z")) & (((F.size(sides) == 1) & (n == 8)) | ((F.size(sides) == 2) & (n <= 7)))
        return F.when(well, F.transform(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right), lambda x: F.conv(x, 16, 10).cast("int")))

    return let(F.transform(F.split(plain, "::", -1), side), eight)


#: Runs of zeros in a text of eight numbers between colons, longest first.
_RUNS = [":" + "0:" * k for k in range(8, 1, -1)]


def _text(groups: Column) -> Column:
    """The canonical text of eight numbers."""
    byte = lambda i, high: (F.floor(F.get(groups, F.lit(i)) / 256) if high else F.get(groups, F.lit(i)) % 256).cast("int").cast("string")
    quad = F.concat_ws(".", byte(6, True), byte(6, False), byte(7, True), byte(7, False))
    mapped = F.slice(groups, 1, 6) == F.array(*(F.lit(x) for x in (0, 0, 0, 0, 0, 65535)))
    whole = F.concat(F.lit(":"), F.array_join(F.transform(groups, lambda x: F.lower(F.hex(x.cast("bigint")))), ":"), F.lit(":"))
    short = let(whole, lambda t: F.coalesce(*(F.when(F.instr(t, run) > 0, F.regexp_replace(t, f"^(.*?){run}", "$1::")) for run in _RUNS), t))
    return F.when(mapped, quad).otherwise(F.regexp_replace(short, "^:(?!:)|(?<!:):$", ""))


def canonical_ip(ip: Column) -> Column:
    """The canonical text of an address (RFC 5952; one that maps an IPv4 address as that), null for anything else."""
    return let(ip, lambda x: F.when(x.rlike(rf"\A{IPV4}\z"), x).when(F.instr(x, ":") > 0, let(_groups(x), lambda g: F.when(g.isNotNull(), _text(g)))))


def canonical_text(ip: str) -> str | None:
    """The same for one text."""
    try:
        found = ipaddress.ip_address(ip)
    except ValueError:
        return None
    return str(getattr(found, "ipv4_mapped", None) or found)


def ip_bytes(ip: Column, legacy: bool = False) -> Column:
    """An address as its shortest big-endian bytes (leading zero bytes are dropped), empty for anything else.

    `legacy`: an IPv6 address gives bytes only if it is written with a "::" that isn't at its beginning; otherwise one that maps
    an IPv4 address gives that one's bytes.
    """
    four = lambda q: F.lpad(F.hex(q), 8, "0")
    sixteen = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(F.hex(x.cast("bigint")), 4, "0")), "")

    def chosen(x: Column) -> Column:
        if not legacy:
            return F.coalesce(four(_quad(x)), sixteen(_groups(x)))
        as_four = let(canonical_ip(x), lambda t: four(_quad(t)))
        return F.when(F.instr(x, "::") > 1, sixteen(_groups(x))).otherwise(as_four)

    return F.unhex(F.regexp_replace(F.coalesce(let(ip, chosen), F.lit("")), "^(?:00)+", ""))
