"""Message headers (RFC 5322) and encoded words (RFC 2047)."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes in which the end of a header must be found.
HEADER_BYTES = 4097

_WORD = re.compile(r"=\?([A-Za-z0-9-]+)\?([QqBb])\?([^?]*)\?=")


#: How the bytes of a character set become text; another function may take its place.
charset_hook: Callable[[bytes, str], str] = lambda data, charset: data.decode(charset, "replace")


def decode_word(charset: str, kind: str, payload: str, hook: Callable[[bytes, str], str] | None = None) -> str | None:
    """One encoded word, null if it is malformed or of an unknown character set."""
    try:
        if kind in "Bb":
            data = base64.b64decode(payload, validate=True)
        else:
            data = re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), payload.replace("_", " ").encode("ascii"))
        return (hook or charset_hook)(data, charset)
    except (binascii.Error, ValueError, LookupError):
        return None


def decode_words(text: str | None, hook: Callable[[bytes, str], str] | None = None) -> str | None:
    """Decode each encoded word; blanks between two of them go; one that is malformed stays as it is."""
    if text is None or "=?" not in text:
        return text
    out, at, joined = [], 0, False
    for m in _WORD.finditer(text):
        between, word = text[at : m.start()], decode_word(*m.groups(), hook)
        if not (joined and not between.strip(" \t")):
            out.append(between)
        out.append(m[0] if word is None else word)
        at, joined = m.end(), word is not None
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def decoded_words(text: pd.Series) -> pd.Series:
    return text.map(lambda x: decode_words(x))


def header_block(data: Column) -> Column:
    """What stands before the first empty line, null if that isn't within the first HEADER_BYTES bytes."""
    head = F.substring(F.encode(data, "UTF-8"), 1, HEADER_BYTES).cast("string")
    return F.when(F.instr(head, "\n\n") > 0, F.substring_index(head, "\n\n", 1))


def header_lines(data: Column) -> Column:
    """The header with folded lines joined, up to its first malformed line."""
    joined = F.regexp_replace(header_block(data), r"[ \t]*\r?\n[ \t]+", " ")
    bad = F.regexp_instr(joined, F.lit("(?m)^(?![!-9;-~]+:)"))
    return F.when(bad > 0, F.substring(joined, F.lit(1), bad - 1)).otherwise(joined)


def subject(data: Column) -> Column:
    """The first subject, decoded; empty if there is none. Made without the map: Spark can't give a UDF an argument that holds lambdas."""
    return decoded_words(F.coalesce(F.trim(F.regexp_extract(header_lines(data), r"(?im)^subject:([^\r\n]*)", 1)), F.lit("")))


def parse_headers(data: Column) -> Column:
    """map<name, array<value>> of a message: names in canonical case, folded lines joined, values in order.

    From the first malformed line on, nothing is taken. Null where there is no header.
    """
    lines = F.filter(F.split(header_lines(data), "\r?\n"), lambda x: x != "")
    canonical = lambda name: F.array_join(F.transform(F.split(name, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "-")
    pairs = F.transform(lines, lambda x: F.struct(canonical(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, "(?s)^[^:]+:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))
