"""Paths, parameters and greetings of the protocol (RFC 5321), as native regular expressions.

Each production of the RFC is one expression, so that a path is parsed without leaving the JVM. Address literals are valid if
`canonical_ip` takes them; their host is the canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweir.functions.ip import IPV4, canonical_ip

_SUB = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
DOMAIN = rf"{_SUB}(?:\.{_SUB})*"
_ATEXT = r"[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~]+"
QUOTED = r'"(?:[ !#-\[\]-~]|\\[ -~])*"'
LOCAL = rf"{_ATEXT}(?:\.{_ATEXT})*|{QUOTED}"
_LITERAL = rf"\[(?:{IPV4}|[Ii][Pp][Vv]6:[0-9A-Fa-f:.]+)\]"
_ROUTE = rf"@{DOMAIN}(?:,@{DOMAIN})*"
PATH = rf"^ ?<(?:({_ROUTE}):)?({LOCAL})(@({DOMAIN}|{_LITERAL}))?>(.*)$"
PARAM = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:=[!-<>-~]+)?"


def literal_ip(literal: Column) -> Column:
    """The canonical text of an address literal with its brackets, null if it is none."""
    return canonical_ip(F.regexp_extract(literal, r"\A\[(?:[Ii][Pp][Vv]6:)?(.*)\]\z", 1))


def params(rest: Column) -> Column:
    """The parameters after a path as [key, value] structs; null if they are malformed."""
    each = F.transform(F.filter(F.split(rest, " "), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.regexp_extract(x, "=(.*)$", 1)).otherwise("").alias("value")))
    return F.when(~rest.startswith(" "), F.expr("array()").cast("array<struct<key:string,value:string>>")).when(rest.rlike(f"^(?: {PARAM})+$"), each)


def _unquoted(local: Column) -> Column:
    return F.when(local.startswith('"'), F.regexp_replace(F.substring(local, F.lit(2), F.length(local) - 2), r"\\(.)", "$1")).otherwise(local)


def parse_path(line: Column, forward: bool) -> Column:
    """What follows MAIL FROM: or (forward) RCPT TO: as a struct; `ok` is false, and the rest null, for a syntax error.

    `<>` is the null path and no forward path. A forward path to the postmaster needs no host; its local part becomes
    `postmaster` whatever follows that prefix.
    """
    part = lambda i: F.regexp_extract(line, PATH, i)
    null_path = F.lit(False) if forward else line.rlike("^ ?<>")
    local, host = _unquoted(part(2)), part(4)
    postmaster = F.lit(forward) & F.lower(local).startswith("postmaster")
    rest = F.when(null_path, F.regexp_replace(line, "^ ?<>", "")).otherwise(part(5))
    found = params(rest)
    literal = host.startswith("[")
    ip = F.when(literal, literal_ip(host))
    ok = F.coalesce((null_path | (line.rlike(PATH) & ((part(3) != "") | postmaster) & (~literal | ip.isNotNull()))) & found.isNotNull(), F.lit(False))
    return F.struct(
        ok.alias("ok"), F.when(ok, null_path).alias("null_path"), F.when(ok, F.filter(F.split(part(1), ","), lambda x: x != "")).alias("route"),
        F.when(ok, F.when(postmaster, "postmaster").otherwise(local)).alias("user"), F.when(ok, F.coalesce(ip, host)).alias("host"), F.when(ok, ip).alias("ip"),
        F.when(ok, ~local.rlike(r"^[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~]*$") & part(2).startswith('"')).alias("quoted"), F.when(ok, found).alias("params"),
    )


#: Limits in bytes, and the replies beyond them, in the order in which they are tested.
PATH_BYTES, LOCAL_BYTES, DOMAIN_BYTES = 256, 128, 255


def address_fault(line: Column, path: Column) -> Column:
    """The name of the reply (see `replies.CANNED`) that refuses what follows MAIL FROM: or RCPT TO:, null if nothing does."""
    return (
        F.when(F.octet_length(line) > PATH_BYTES, "path_too_long").when(~path["ok"], "invalid_address")
        .when(path["null_path"], F.lit(None).cast("string")).when(F.octet_length(path["user"]) > LOCAL_BYTES, "local_part_too_long")
        .when(F.octet_length(path["host"]) > DOMAIN_BYTES, "domain_too_long")
    )


def greeting_host(line: Column, literal: bool) -> Column:
    """The host that HELO or (with a literal allowed) EHLO names after one space, null for a syntax error; a literal's is its address."""
    name = F.nullif(F.regexp_extract(line, rf"\A ({DOMAIN})(?:[:,>].*)?\z", 1), F.lit(""))
    return F.coalesce(name, literal_ip(F.regexp_extract(line, rf"\A ({_LITERAL})", 1))) if literal else name
