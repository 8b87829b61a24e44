"""Starting and draining streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_lines(spark: SparkSession, path: str, schema: str, files: int | None = 1000) -> DataFrame:
    """Session lines from Parquet files as they come; a micro-batch takes so many files at most, the others wait."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Run a sink for each micro-batch, which may come again after a failure; without `seconds` what is there is taken and the query ends."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def drain(query: StreamingQuery, seconds: float | None = None) -> None:
    """Take in nothing more once what has come is processed, then stop."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination(seconds)
