"""Storing a message whole: headers, hashes, delivery header and compression, then the key-value store or, if that fails, the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweir.operators import mailrows, processors
from mailweir.sinks.store import TTL, Store, with_store

CHAIN = "headersparser|hasher|header|compressor"


def stored_rows(messages: DataFrame, connect: Callable[[], Store], at: Column, primary_host: str, ttl: int = TTL, first_only: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The rows of messages (see `mailrows.mail_rows`) after their mail went into the store; where it didn't, the row carries it compressed.

    `first_only` leaves a row for the first recipient alone.
    """
    made = messages.transform(processors.chain(CHAIN)).withColumn("_key", F.get(F.col("hashes"), F.lit(0)))
    put = with_store(made, connect, key="_key", value="compressed", ttl=ttl).drop("_key")
    one = put.withColumn("rcpt_to", F.slice("rcpt_to", 1, 1)) if first_only else put
    return mailrows.mail_rows(one, at, primary_host, keep)
