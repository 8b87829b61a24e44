"""The session machine and the insert batches as stateful streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailweir.functions import text as fn
from mailweir.operators.protocol import FIELDS, MESSAGE, ServerOptions, Session, with_commands


def stream_sessions(lines: DataFrame, options: ServerOptions, idle_ms: int | None = None) -> DataFrame:
    """The same rows as `protocol.run_sessions`, from a stream of lines (session_id bigint, seq bigint, line, and optionally remote_ip).

    A session's state is what the machine holds between two lines, one message at most. Lines of a session are put in order within
    each micro-batch; one that comes after a later line of its session was answered is late, and has state `late` and no reply.
    With `idle_ms`, a session that gets no line for so long is forgotten; Spark then runs batches for the clock alone, so such a query
    needs a processing-time trigger, and never ends under availableNow.
    """
    have = set(lines.columns)
    rows = lines.select("session_id", "seq", F.coalesce("line", F.lit("")).alias("line"), F.col("remote_ip") if "remote_ip" in have else F.lit("").alias("remote_ip"))
    rows = with_commands(rows, options).withColumn("queued_id", fn.queue_id(F.col("session_id").cast("bigint")))
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(list(frames)).sort_values("seq", kind="stable")
        session, last = pickle.loads(state.get[0]) if state.exists else (None, None)
        out = []
        for row in found.to_dict("records"):
            if session is None:
                session = Session(row["remote_ip"] or "", row["queued_id"] or "")
            if last is not None and row["seq"] <= last:
                out.append((key[0], row["seq"], "late", row["verb"], None, None))
                continue
            last, before = row["seq"], session.state
            reply, message = session.take(row["line"], {c: None if isinstance(row[c], float) else row[c] for c in FIELDS}, options)
            out.append((key[0], row["seq"], before, row["verb"], reply, message))
        state.update((pickle.dumps((session, last)),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "seq", "state", "verb", "reply", "message"])

    schema = f"session_id bigint, seq bigint, state string, verb string, reply string, message {MESSAGE}"
    done = rows.groupBy("session_id").applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
    return done.withColumn("code", F.when(F.col("reply").isNotNull(), fn.result_code(F.col("reply"))))


def stream_batches(rows: DataFrame, by: str, at: str, tie: str, most: int, idle: int) -> DataFrame:
    """The same as `sessions.batches` (island, batch, place), from a stream of rows in order of `at` and `tie`; all three are longs.

    State is a count and the last time of each key. Rows are put in order within each micro-batch.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, island, n = state.get if state.exists else (None, 0, 0)
        found = pd.concat(list(frames)).sort_values([at, tie], kind="stable")
        out = []
        for now, t in zip(found[at].tolist(), found[tie].tolist(), strict=True):
            if last is None or now - last >= idle:
                island, n = island + 1, 0
            out.append((key[0], now, t, island, n // most, n % most))
            last, n = now, n + 1
        state.update((last, island, n))
        yield pd.DataFrame(out, columns=[by, at, tie, "island", "batch", "place"])

    schema = f"`{by}` bigint, `{at}` bigint, `{tie}` bigint, island int, batch int, place int"
    return rows.groupBy(by).applyInPandasWithState(run, schema, "last bigint, island int, n bigint", "append", GroupStateTimeout.NoTimeout)


def stream_store(writes: DataFrame, key: str, at: str, value: str, ttl: str) -> DataFrame:
    """Each key's last write in each window of `ttl`, from a stream; a store with expiry gets a key anew with each.

    `at` is a timestamp; writes that come later than `ttl` after newer ones are dropped, and state is kept no longer.
    """
    marked = writes.withWatermark(at, ttl)
    return marked.groupBy(F.window(at, ttl), key).agg(F.max(F.struct(at, value)).alias("last")).select(key, f"last.{at}", f"last.{value}")
