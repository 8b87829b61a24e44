"""Key-value sinks with expiry: an interface, a store in memory for tests, and the stage that puts messages into one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds that a stored message lives.
TTL = 7200


class Store(Protocol):
    """What a key-value database must offer."""

    def put(self, key: str, ttl: int, value: bytes) -> None: ...


class MemoryStore:
    """A store in this process; its clock can be set."""

    def __init__(self, clock: Callable[[], float] = time.time) -> None:
        self.clock, self.held = clock, {}

    def put(self, key: str, ttl: int, value: bytes) -> None:
        self.held[key] = (self.clock() + ttl, value)

    def get(self, key: str) -> bytes | None:
        until, value = self.held.get(key, (0, None))
        return value if until > self.clock() else None


def with_store(df: DataFrame, connect: Callable[[], Store], key: str = "key", value: str = "value", ttl: int = TTL) -> DataFrame:
    """Put each row's value under its key, and add in_store: whether that worked.

    A row without a key or with a store that fails isn't in the store, and its mail stays in its row (see `mailrows.storage_tag`). Putting
    is the same when repeated, so a task that runs again does no harm. One connection for each task.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("in_store", T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            store = connect()
        except Exception:
            store = None

        def put(k: str | None, v: bytes | str | None) -> bool:
            if store is None or not k or v is None:
                return False
            try:
                store.put(k, ttl, v.encode() if isinstance(v, str) else bytes(v))
            except Exception:
                return False
            return True

        for frame in frames:
            yield frame.assign(in_store=[put(k, v) for k, v in zip(frame[key], frame[value], strict=True)])

    return df.mapInPandas(run, schema)


def joined(rows: DataFrame, store: DataFrame, key: str = "hash") -> DataFrame:
    """Mail rows with their mail from a store's table (key, value), where they say that it is there."""
    kept = store.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    return rows.join(kept, (F.col(key) == F.col("_key")) & (F.col("body") == "redis"), "left").withColumn("mail", F.coalesce("_value", "mail")).drop("_key", "_value")
