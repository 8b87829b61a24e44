"""Per-session limits, counters and scopes, as windows over a session's lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_rows(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each session; Spark limits the groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def kill_after(df: DataFrame, by: str, order: list[str], bad: Column, most: int = 5) -> DataFrame:
    """Rows up to and with a session's `most`-th bad one; bad_so_far counts them."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = df.withColumn("bad_so_far", F.sum(bad.cast("int")).over(w))
    return counted.where((F.col("bad_so_far") < most) | ((F.col("bad_so_far") == most) & bad))


def transactions(df: DataFrame, by: str, order: list[str], reset: Column) -> DataFrame:
    """Add transaction: how many resets came before a row of its session."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("transaction", F.coalesce(F.sum(reset.cast("int")).over(w), F.lit(0)))


def batches(df: DataFrame, by: str, at: str, tie: str, rows: int, idle: int) -> DataFrame:
    """Add batch and place: a batch is flushed at `rows` rows or when none comes for `idle` units of `at`."""
    w = Window.partitionBy(by).orderBy(at, tie)
    gap = F.col(at) - F.lag(at).over(w)
    island = df.withColumn("_new", F.when(gap.isNull() | (gap >= idle), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    placed = island.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_island").orderBy(at, tie)) - 1)
    chunk = F.floor(F.col("_n") / rows).cast("int")
    return placed.withColumns({"island": F.col("_island").cast("int"), "batch": chunk, "place": (F.col("_n") % rows).cast("int")}).drop("_new", "_island", "_n")


def last_write(df: DataFrame, key: str, at: str, tie: str, now: int | DataFrame, ttl: int) -> DataFrame:
    """What a store with expiry holds: each key's last row, if it isn't older than `ttl`. `now` may be a table of one row."""
    last = df.groupBy(key).agg(F.max(F.struct(F.col(at), F.col(tie))).alias("last")).select(key, "last.*")
    if isinstance(now, int):
        return last.where(F.col(at) + ttl > now)
    clock = now.select(F.col(now.columns[0]).alias("_now"))
    return last.join(F.broadcast(clock), F.col(at) + ttl > F.col("_now")).drop("_now")


def active(df: DataFrame, by: str, at: str) -> DataFrame:
    """by, change (1 for a session's first row, -1 for its last) and active: how many sessions are open after it.

    Sums of blocks of time make the running count, so that no task holds more than a block and the sums before it.
    """
    spans = df.groupBy(by).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    changes = spans.select(by, F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("change")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("change")))).alias("c")).select(by, "c.*")
    block = changes.withColumn("_block", F.date_trunc("hour", F.col("t").cast("timestamp")))
    sums = block.groupBy("_block").agg(F.sum("change").alias("n"))
    before = sums.select("_block", (F.sum("n").over(Window.orderBy("_block")) - F.col("n")).alias("before"))  # a row for each block
    within = F.sum("change").over(Window.partitionBy("_block").orderBy("t", F.col("change").desc(), by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return block.withColumn("_within", within).join(before, "_block").select(by, "change", (F.col("before") + F.col("_within")).alias("active"))


def joined_errors(df: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """by and errors: a group's only error as it is, or several each after a line end."""
    found = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("all"))
    texts = F.transform("all", lambda x: x[text])
    return found.select(by, F.when(F.size("all") == 1, F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("\n"), F.array_join(texts, "\n"))).alias("errors"))


def timed_out(df: DataFrame, by: str, at: str, tie: str, most: int) -> DataFrame:
    """Add timed_out: whether a row came more than `most` units of `at` after the one before it in its session."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(by).orderBy(at, tie))
    return df.withColumn("timed_out", F.coalesce(gap > most, F.lit(False)))


def byte_totals(df: DataFrame, by: str, *texts: str) -> DataFrame:
    """by and bytes: how many bytes the texts of a group's rows have together."""
    one = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))
    return df.groupBy(by).agg(F.sum(one).alias("bytes"))


def numbered(df: DataFrame, order: list[str], block: Column, name: str = "client_id") -> DataFrame:
    """Rows with a number from 1 without gaps in their order.

    `block` never falls along the order (an hour of a time stamp, say): counts of blocks, then places within them, so no task holds more than a block.
    """
    blocks = df.withColumn("_block", block)
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))  # a row for each block
    within = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return blocks.withColumn("_within", within).join(before, "_block").withColumn(name, F.col("_before") + F.col("_within")).drop("_block", "_within", "_before")
