"""Made-up sessions, for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(spark: SparkSession, n: int, host: str = "mail.example.com", body_lines: int = 3) -> DataFrame:
    """session_id, seq, line and remote_ip of n clients that each send one message."""
    k = F.col("id").cast("string")
    fixed = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    body = F.transform(F.sequence(F.lit(1), F.lit(body_lines)), lambda i: fixed("line ", i.cast("string"), " of ", k)) if body_lines else F.expr("cast(array() as array<string>)")
    head = F.array(F.lit("HELO client.example.org"), fixed("MAIL FROM:<from", k, "@example.org>"), fixed("RCPT TO:<to", k, f"@{host}>"), F.lit("DATA"), fixed("Subject: test ", k), F.lit(""))
    lines = F.concat(head, body, F.array(F.lit("."), F.lit("QUIT")))
    ip = fixed("198.18.", (F.floor(F.col("id") / 256) % 256).cast("string"), ".", (F.col("id") % 256).cast("string"))
    return spark.range(n).select(F.col("id").alias("session_id"), ip.alias("remote_ip"), F.posexplode(lines).alias("seq", "line"))
