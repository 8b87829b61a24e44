"""Reply texts from enhanced status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values that replies must match: basic code of an enhanced status.
BASIC_CODES = {
    "2.1.0": 250, "2.1.5": 250, "2.3.0": 250, "2.5.0": 250, "2.6.4": 250, "2.6.8": 252, "2.7.0": 220,
    "4.1.1": 451, "4.1.8": 451, "4.2.4": 450, "4.3.0": 421, "4.3.1": 452, "4.3.2": 453, "4.4.1": 451, "4.4.2": 421,
    "4.4.3": 451, "4.4.5": 451, "4.5.0": 451, "4.5.1": 430, "4.5.3": 452, "4.5.4": 451, "4.7.0": 450, "4.7.1": 451,
    "4.7.12": 422, "4.7.15": 450, "4.7.24": 451,
    "5.1.1": 550, "5.1.3": 501, "5.1.8": 501, "5.1.10": 556, "5.2.2": 552, "5.2.3": 552, "5.3.0": 550, "5.3.4": 552,
    "5.4.3": 550, "5.5.0": 501, "5.5.1": 500, "5.5.2": 500, "5.5.4": 501, "5.5.6": 500, "5.6.3": 554, "5.6.6": 554,
    "5.6.7": 553, "5.6.8": 550, "5.6.9": 550, "5.7.0": 550, "5.7.1": 551, "5.7.2": 550, "5.7.4": 504, "5.7.8": 554,
    "5.7.9": 534, "5.7.10": 523, "5.7.11": 524, "5.7.13": 525, "5.7.14": 535, "5.7.15": 550, "5.7.16": 552, "5.7.17": 500,
    "5.7.18": 500, "5.7.19": 500, "5.7.20": 550, "5.7.21": 550, "5.7.22": 550, "5.7.23": 550, "5.7.24": 550, "5.7.25": 550,
    "5.7.26": 550, "5.7.27": 550,
}
#: Default comments of statuses, and of classes.
DEFAULT_TEXTS = {
    "2.0.0": "OK", "2.1.0": "OK", "2.1.5": "OK", "2.5.0": "OK",
    "4.5.3": "Too many recipients", "4.5.4": "Relay access denied", "5.5.1": "Invalid command",
}
CLASS_TEXTS = {2: "OK", 4: "Temporary failure.", 5: "Permanent failure."}


def with_reply(df: DataFrame, status: str = "status", comment: str | None = None) -> DataFrame:
    """Add basic_code and reply; a status without a code of its own gets its class times 100.

    The dimension is a constant of a few dozen rows, so it is broadcast.
    """
    spark = df.sparkSession
    rows = [(s, BASIC_CODES.get(s), DEFAULT_TEXTS.get(s)) for s in sorted(BASIC_CODES.keys() | DEFAULT_TEXTS.keys())]
    dim = F.broadcast(spark.createDataFrame(rows, "_status string, _code int, _text string"))
    kind = F.substring(F.col(status), 1, 1).cast("int")
    by_class = F.coalesce(*[F.when(kind == k, t) for k, t in CLASS_TEXTS.items()], F.lit(""))
    text = F.coalesce(F.col("_text"), by_class)
    if comment:
        text = F.when(F.col(comment) != "", F.col(comment)).otherwise(text)
    joined = df.join(dim, F.col(status) == F.col("_status"), "left").withColumn("basic_code", F.coalesce("_code", kind * 100))
    return joined.withColumn("reply", F.concat_ws(" ", F.col("basic_code").cast("string"), F.col(status), text)).drop("_status", "_code", "_text")


#: Fixed values that replies must match: status, basic code (none: from the status) and comment (none: the default) of each canned reply.
CANNED = {
    "line_too_long": ("5.5.1", 554, "Line too long."),
    "nested_mail": ("5.5.1", 503, "Error: nested MAIL command"),
    "no_sender": ("5.5.1", 503, "Error: No sender"),
    "no_recipients": ("5.5.1", 503, "Error: No recipients"),
    "unrecognized": ("5.5.1", 554, "Unrecognized command"),
    "max_unrecognized": ("5.5.1", 554, "Too many unrecognized commands"),
    "syntax_error": ("5.5.2", 550, "Syntax error"),
    "read_limit": ("5.2.3", 550, "Error:"),
    "message_size": ("5.4.0", 552, "Error:"),
    "read_error": ("4.3.0", 451, "Error:"),
    "path_too_long": ("5.5.4", 550, "Path too long"),
    "invalid_address": ("5.5.4", 501, "Invalid address"),
    "local_part_too_long": ("5.5.4", 550, "Local part too long, cannot exceed 64 characters"),
    "domain_too_long": ("5.5.4", 550, "Domain cannot exceed 255 characters"),
    "backend_not_running": ("5.5.0", 554, "Transaction failed - backend not running"),
    "backend_transaction": ("5.5.0", 554, "Error:"),
    "backend_timeout": ("5.5.0", 554, "Error: transaction timeout"),
    "rcpt_failed": ("5.1.1", 550, "User unknown in local recipient table"),
    "too_many_recipients": ("4.5.3", 452, "Too many recipients"),
    "relay_denied": ("4.1.1", 454, "Error: Relay access denied:"),
    "shutdown": ("4.3.0", 421, "Server is shutting down. Please try again later. Sayonara!"),
    "mail_ok": ("2.1.0", None, ""),
    "rcpt_ok": ("2.1.5", None, ""),
    "reset_ok": ("2.1.0", None, ""),
    "verify_ok": ("2.5.0", 252, "Cannot verify user"),
    "noop_ok": ("2.0.0", None, ""),
    "quit_ok": ("2.0.0", 221, "Bye"),
    "data_ok": ("", 354, "354 Enter message, ending with '.' on a line by itself"),
    "starttls_ok": ("2.0.0", 220, "Ready to start TLS"),
    "queued": ("2.0.0", 250, "OK: queued as"),
}


def reply_text(status: str, code: int | None = None, comment: str = "") -> str:
    """One reply as text; without a status it is the comment alone, and a default comment comes only where no code is given."""
    if not status:
        return comment
    kind = int(status[0])
    if not comment and code is None:
        comment = DEFAULT_TEXTS.get(status, CLASS_TEXTS.get(kind, ""))
    return f"{code or BASIC_CODES.get(status, 100 * kind)} {status} {comment}"


def canned(name: str, *more: str) -> str:
    """A canned reply, with what follows it."""
    return " ".join([reply_text(*CANNED[name]), *more])


def result_text(*parts: Column | str | None) -> Column:
    """A result's text: its parts, in a row; null ones are nothing."""
    return F.concat(*(F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts))


def sql_dimension() -> str:
    """The dimension as a SQL VALUES list, for oracles."""
    quote = lambda x: "NULL" if x is None else f"'{x}'"
    rows = [f"('{s}', {BASIC_CODES.get(s) or 'NULL'}, {quote(DEFAULT_TEXTS.get(s))})" for s in sorted(BASIC_CODES.keys() | DEFAULT_TEXTS.keys())]
    return f"(VALUES {', '.join(rows)}) AS d(status, code, txt)"


def statuses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sorted(BASIC_CODES)], "status string")
