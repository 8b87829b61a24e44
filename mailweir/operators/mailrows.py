"""The rows that a message becomes in a table: one for each recipient, in the columns of the row store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweir.functions import addresses
from mailweir.functions import text as fn
from mailweir.functions.ip import ip_bytes

LIMIT = 255
COLUMNS = ["date", "to", "from", "subject", "body", "mail", "spam_score", "has_attach", "hash", "content_type", "recipient", "ip_addr", "return_path", "is_tls", "message_id", "reply_to", "sender"]


def storage_tag(compressed: Column, in_store: Column) -> Column:
    """Where a row's mail is: in the key-value store, compressed in the row, or plain in it."""
    return F.when(F.coalesce(in_store, F.lit(False)), "redis").when(compressed.isNotNull(), "gzip").otherwise("")


def message_view(delivery_header: Column, data: Column) -> Column:
    """What is stored of a message: its delivery header and then its body."""
    return F.concat(F.coalesce(delivery_header, F.lit("")), F.coalesce(data, F.lit("")))


def view_bytes(delivery_header: Column, data: Column) -> Column:
    return F.octet_length(F.coalesce(delivery_header, F.lit(""))) + F.octet_length(F.coalesce(data, F.lit("")))


def push(recipients: Column, address: Column) -> Column:
    return F.array_append(recipients, address)


def pop(recipients: Column) -> Column:
    """The recipients without the last one."""
    return F.slice(recipients, F.lit(1), F.greatest(F.size(recipients) - 1, F.lit(0)))


def mail_rows(messages: DataFrame, at: Column, primary_host: str, keep: list[str] | None = None) -> DataFrame:
    """COLUMNS, and what `keep` names, for every recipient of every message, in one pass without a shuffle.

    A message has mail_from, rcpt_to (addresses as text), subject, data, remote_ip and tls, and may have header, hashes, delivery_header,
    compressed (binary) and in_store (boolean). All rows of a message carry its first hash.
    """
    have = set(messages.columns)
    of = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    value = lambda name: F.get(F.col("header")[name], F.lit(0)) if "header" in have else F.lit(None).cast("string")
    first = lambda name: fn.trimmed_to(addresses.first_address_text(F.coalesce(value(name), F.lit(""))), LIMIT)
    short = lambda text: fn.trimmed_to(F.coalesce(text, F.lit("")), LIMIT)
    mail_hash = F.coalesce(F.get(F.col("hashes"), F.lit(0)), F.lit("")) if "hashes" in have else F.lit("")
    compressed, in_store = of("compressed", "binary"), of("in_store", "boolean")
    body = storage_tag(compressed, in_store)
    mail = F.when(body == "redis", F.lit(b"")).when(body == "gzip", compressed).otherwise(message_view(of("delivery_header", "string"), F.col("data")).cast("binary"))
    once = messages.select(
        *(keep or []), at.alias("date"), first("To").alias("_to"), short(F.col("mail_from")).alias("from"), short(of("subject", "string")).alias("subject"), body.alias("body"), mail.alias("mail"),
        mail_hash.alias("hash"), short(value("Content-Type")).alias("content_type"), ip_bytes(F.col("remote_ip"), legacy=True).alias("ip_addr"), F.col("tls").alias("is_tls"),
        first("Message-Id").alias("_id"), first("Reply-To").alias("reply_to"), first("Sender").alias("sender"), F.explode("rcpt_to").alias("_rcpt"),
    )
    recipient = short(F.col("_rcpt"))
    user = F.regexp_extract("_rcpt", "(?s)^(.*?)(?:@[^@]*)?$", 1)
    made = F.concat(F.col("hash"), F.lit("."), user, F.lit("@" + primary_host))
    rows = once.withColumns({
        "recipient": recipient, "to": F.when(F.col("_to") != "", F.col("_to")).otherwise(recipient), "return_path": F.col("from"), "spam_score": F.lit(0), "has_attach": F.lit(0),
        "message_id": F.when(F.col("_id") != "", F.col("_id")).otherwise(made),
    })
    return rows.select(*(keep or []), *COLUMNS)
