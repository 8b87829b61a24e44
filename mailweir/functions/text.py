"""Column functions of the message engine: native, and measured in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweir.functions.ip import let


def glob_to_regex(glob: str) -> str | None:
    """An anchored expression for a shell pattern, null for a malformed one, which matches nothing.

    * and ? don't match a slash, a backslash makes the next character plain, and a class is [abc], [a-z] or [^a-z].
    """
    plain = lambda c: "\\" + c if c in r"\.^$|+(){}[]*?-&~#" else c
    out, i, n = "", 0, len(glob)
    while i < n:
        c = glob[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i == n:
                return None
            out += plain(glob[i])
            i += 1
        elif c == "[":
            inner = "^" if glob[i : i + 1] == "^" else ""
            i += len(inner)
            members = 0
            while glob[i : i + 1] != "]" or not members:
                ends = []
                for first in (True, False):
                    if not first:
                        if glob[i : i + 1] != "-":
                            break
                        i += 1
                    if i >= n or glob[i] in "-]":
                        return None
                    i += glob[i] == "\\"
                    if i >= n:
                        return None
                    ends.append(plain(glob[i]))
                    i += 1
                inner += "-".join(ends)
                members += 1
            i += 1
            out += f"[{inner}]"
        else:
            out += plain(c)
    return rf"\A{out}\z"


def address_text(user: Column, host: Column, quoted: Column, literal: Column) -> Column:
    """An address as text: quoted local part where needed, brackets around an address literal."""
    escaped = F.regexp_replace(user, r'([\\"])', r"\\$1")
    local = F.when(quoted, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(user)
    domain = F.when(literal, F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return (
        F.when((user == "") & (host == ""), "")
        .when((user == "postmaster") & (host == ""), "postmaster")
        .when(host != "", F.concat(local, F.lit("@"), domain))
        .otherwise(local)
    )


#: White space that is trimmed from texts.
_WHITE = " \t\n\x0b\f\r\x85\xa0"


def trimmed(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.btrim(text, F.lit(_WHITE))


def result_code(text: Column) -> Column:
    """The reply code that a text begins with, as its first three characters; 554 if these aren't a whole number."""
    head = F.substring(trimmed(text), 1, 3)
    return F.coalesce(F.when(head.rlike(r"\A(?:[0-9]{3}|[+-][0-9]{2})\z"), head.try_cast("int")), F.lit(554))


def trim_bytes(text: Column, limit: int) -> Column:
    """At most `limit` bytes: the trimmed text if it was short enough, else a byte prefix of the untrimmed one."""
    data = text.cast("binary")
    return F.when(F.octet_length(text) > limit, F.substring(data, 1, limit)).otherwise(trimmed(text).cast("binary"))


def trimmed_to(text: Column, limit: int) -> Column:
    """The same as text; a character that the limit splits becomes a replacement character."""
    return let(text, lambda x: F.make_valid_utf8(trim_bytes(x, limit).cast("string")))


def queue_id(client: Column) -> Column:
    """The digest by which a client's messages are known: of a replacement character and the client's number as a character.

    Numbers that are no character (above 0x10FFFF, or of surrogates) count as a replacement character.
    """
    n = F.when((client > 0x10FFFF) | client.between(0xD800, 0xDFFF) | (client < 0), F.lit(0xFFFD)).otherwise(client)
    two, byte = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0"), lambda shift: F.floor(n / (1 << shift)).cast("bigint") % 64 + 128
    lead = lambda shift, mark: F.floor(n / (1 << shift)).cast("bigint") + mark
    encoded = (
        F.when(n < 0x80, two(n)).when(n < 0x800, F.concat(two(lead(6, 0xC0)), two(byte(0))))
        .when(n < 0x10000, F.concat(two(lead(12, 0xE0)), two(byte(6)), two(byte(0)))).otherwise(F.concat(two(lead(18, 0xF0)), two(byte(12)), two(byte(6)), two(byte(0))))
    )
    return F.md5(F.unhex(F.concat(F.lit("EFBFBD"), encoded)))


def mail_date(at: Column) -> Column:
    """A time stamp as in message headers; the session's time zone decides."""
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss Z")


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration_seconds(text: Column, default: float) -> Column:
    """Seconds of a duration such as 1h30m, 1.5s or -2ms; the default for an empty or malformed one."""
    number = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
    parts = F.regexp_extract_all(text, F.lit(rf"({number})(ns|us|µs|μs|ms|s|m|h)"), F.lit(0))
    unit = lambda x: F.regexp_extract(x, "([a-zµμ]+)$", 1)
    factor = lambda x: F.coalesce(*(F.when(unit(x) == u, F.lit(f)) for u, f in _UNITS.items()))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.regexp_extract(x, rf"^({number})", 1).cast("double") * factor(x))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(text.rlike(r"\A[+-]?0\z"), 0.0).when(text.rlike(rf"\A[+-]?(?:{number}(?:ns|us|µs|μs|ms|s|m|h))+\z"), signed).otherwise(F.lit(float(default)))


def proxy_value(line: Column, name: str) -> Column:
    """What a proxy's line (XCLIENT, then name=value pairs) gives as a value, null if it doesn't; the last one counts."""
    pairs = F.filter(F.split(F.substring(line, 9, 2048), " "), lambda x: (F.size(F.split(x, "=", -1)) == 2) & (F.substring_index(x, "=", 1) == name) & (F.substring_index(x, "=", -1) != "[UNAVAILABLE]"))
    return F.when(F.size(pairs) > 0, F.substring_index(F.get(pairs, F.size(pairs) - 1), "=", -1))


def peer_ip(address: Column) -> Column:
    """The IP of ip:port or [ip]:port."""
    return F.coalesce(F.nullif(F.regexp_extract(address, r"\A\[([^\]%]+)(?:%[^\]]*)?\]:[0-9]+\z", 1), F.lit("")), F.nullif(F.regexp_extract(address, r"\A([^:]+):[0-9]+\z", 1), F.lit("")), address)


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as a number, null for anything else."""
    parts = F.split(ip, r"\.")
    value = F.aggregate(F.transform(parts, lambda p: p.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a * 256 + b)
    valid = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (p.try_cast("int") <= 255))
    return F.when(valid, value)


def protocol_label(esmtp: Column, tls: Column) -> Column:
    return F.concat(F.when(esmtp, "E").otherwise(""), F.lit("SMTP"), F.when(tls, "S").otherwise(""))


def delivery_header(user: Column, primary_host: Column, ip: Column, host: Column, label: Column, mail_hash: Column, stamp: Column) -> Column:
    """The block that is put before a stored message."""
    return F.concat(
        F.lit("Delivered-To: "), F.trim(user), F.lit("@"), primary_host, F.lit("\nReceived: from "), ip, F.lit(" (["), ip,
        F.lit("])\n\tby "), host, F.lit(" with "), label, F.lit(" id "), mail_hash, F.lit("@"), host, F.lit(";\n\t"), stamp, F.lit("\n"),
    )


def cumulative_md5(base: Column, recipients: Column) -> Column:
    """For recipient i, the md5 of the base and of all recipients up to i; the base stays out of lambda bodies, where Spark can't run a UDF."""
    start = F.struct(base.alias("all"), F.expr("array()").cast("array<string>").alias("hashes"))
    step = lambda a, x: F.struct(F.concat(a["all"], x).alias("all"), F.array_append(a["hashes"], F.md5(F.concat(a["all"], x).cast("binary"))).alias("hashes"))
    return F.aggregate(recipients, start, step, lambda a: a["hashes"])


def unstuff_dots(body: Column) -> Column:
    """A transferred body as sent: the dot that was put before a line's dot goes, line ends become \\n."""
    return F.regexp_replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), r"(?m)^\.", "")


def stuff_dots(body: Column) -> Column:
    return F.replace(F.regexp_replace(body, r"(?m)^\.", ".."), F.lit("\n"), F.lit("\r\n"))


#: The verbs, in the order in which a line is compared with them.
VERBS = ["HELO", "EHLO", "HELP", "XCLIENT", "MAIL FROM:", "RCPT TO:", "RSET", "VRFY", "NOOP", "QUIT", "DATA", "STARTTLS"]


def verb(line: Column) -> Column:
    """The verb that the first 16 characters of a line begin with, null for none."""
    head = F.upper(F.substring(line, 1, 16))
    return F.coalesce(*[F.when(head.startswith(v), v) for v in VERBS])
