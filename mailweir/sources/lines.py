"""Text as a source of session lines and of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session_id (a hash of the file), file, seq and line of every file under a path; a file is what one client sent.

    Lines end with a line feed, a carriage return before it goes. Files are read in parts, so seq is the place of the part and the line in it.
    """
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")).alias("seq"), F.col("value").alias("line")
    )
    return rows.select(F.xxhash64("file").alias("session_id"), "file", "seq", F.regexp_replace("line", "\r$", "").alias("line"))


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each line of a text: the columns that `keep` names, seq (from 0) and line, without line ends."""
    lines = F.split(F.col(text), "\r?\n", -1)
    whole = F.when(F.col(text).endswith("\n"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return df.select(*keep, F.posexplode(whole).alias("seq", "line"))


def bodies(lines: DataFrame, by: str, order: str, line: str = "line") -> DataFrame:
    """by and body of each group's lines up to the one that is a dot alone: without the dots that transfer added, with \\n line ends.

    A group without that line has no body. One shuffle; lines after the end aren't collected.
    """
    from pyspark.sql import Window

    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = lines.withColumn("_ends", F.sum(F.when(F.col(line) == ".", 1).otherwise(0)).over(upto)).where((F.col("_ends") == 0) | ((F.col("_ends") == 1) & (F.col(line) == ".")))
    held = F.struct(F.col(order).alias("at"), F.when(F.col(line).startswith("."), F.substring(F.col(line), F.lit(2), F.length(line))).otherwise(F.col(line)).alias("line"))
    grouped = ended.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("_ends") == 0, held))).alias("lines"), F.max("_ends").alias("ended")).where("ended = 1")
    return grouped.select(by, F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.when(F.size("lines") > 0, "\n").otherwise("")).alias("body"))


def body_state(body: Column, max_size: int, slack: int = 1_024_000) -> Column:
    """What becomes of a body: ok, over (the limit, but read to its end) or cut (not read to its end)."""
    size = F.octet_length(body)
    return F.when(size > max_size + slack, "cut").when(size > max_size, "over").otherwise("ok")



