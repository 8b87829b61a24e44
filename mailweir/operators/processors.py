"""The configured chain of message processors: `A|B|C` is one lazy plan, applied from left to right.

A message has remote_ip, helo, mail_user, mail_host, rcpt_to (array of addresses as text), esmtp, tls, data and stamp.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailweir.functions import mime
from mailweir.functions import text as fn


@F.pandas_udf(T.BinaryType())
def compressed(data: pd.Series) -> pd.Series:
    """zlib at its fastest level."""
    return data.map(lambda x: None if x is None else zlib.compress(x.encode(), 1))


@F.pandas_udf(T.BinaryType())
def expanded(data: pd.Series) -> pd.Series:
    """What `compressed` was made of."""
    return data.map(lambda x: None if x is None else zlib.decompress(x))


def headers_parser(df: DataFrame) -> DataFrame:
    return df.withColumns({"header": mime.parse_headers(F.col("data")), "subject": mime.subject(F.col("data"))})


def hasher(df: DataFrame) -> DataFrame:
    base = F.concat(F.col("mail_user"), F.lit("@"), F.col("mail_host"), F.col("subject") if "subject" in df.columns else F.lit(""), F.col("stamp"))
    return df.withColumn("hashes", fn.cumulative_md5(base, F.col("rcpt_to")))


def header(df: DataFrame, primary_host: str = "mail.example.com") -> DataFrame:
    """The delivery header: the message is for the first recipient's user at `primary_host`, and came in by the first recipient's host."""
    first = F.coalesce(F.col("rcpt_to")[0], F.lit(""))
    mail_hash = F.coalesce(F.col("hashes")[0], F.lit("unknown")) if "hashes" in df.columns else F.lit("unknown")
    user, host = F.regexp_extract(first, "(?s)^(.*)@[^@]*$", 1), F.substring_index(first, "@", -1)
    label = fn.protocol_label(F.col("esmtp"), F.col("tls"))
    return df.withColumn("delivery_header", fn.delivery_header(user, F.lit(primary_host), F.col("remote_ip"), host, label, mail_hash, F.col("stamp")))


def compressor(df: DataFrame) -> DataFrame:
    whole = F.concat(F.coalesce("delivery_header", F.lit("")), "data") if "delivery_header" in df.columns else F.col("data")
    return df.withColumn("compressed", compressed(whole))


def guarded(f: Callable[[str], str]):
    """A function of texts as a column function that gives struct<value, error>: a text that it fails on has the error `storage failed`."""

    @F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(x: str | None) -> tuple[str | None, str | None]:
            try:
                return f(x), None
            except Exception as e:
                return None, f"storage failed: {e}"

        return pd.DataFrame([one(x) for x in texts], columns=["value", "error"], dtype=object)

    return run


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"headersparser": headers_parser, "hasher": hasher, "header": header, "compressor": compressor, "debugger": lambda df: df}


def chain(config: str, registry: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The transformation that a configuration names, in any case; an unknown name is an error, an empty text does nothing."""
    known = REGISTRY | (registry or {})
    names = [x.strip().lower() for x in config.split("|") if x.strip()]
    if missing := [x for x in names if x not in known]:
        raise ValueError(f"unknown processors: {', '.join(missing)}")
    return lambda df: functools.reduce(lambda d, name: d.transform(known[name]), names, df)
