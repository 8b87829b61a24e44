"""Log destinations, process id file, and log lines of messages."""

from __future__ import annotations

import logging
import os
import sys
from logging.handlers import WatchedFileHandler

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_cache: dict[tuple[str, str], logging.Logger] = {}


def logger(dest: str = "", level: str = "info") -> logging.Logger:
    """The logger of a destination and level: stderr (or empty), stdout, off, or a file, which is opened anew when it was moved away.

    The same pair gives the same logger. A file that can't be opened falls back to stderr.
    """
    if (dest, level) not in _cache:
        made = logging.Logger(f"mailweir:{dest}:{level}", level.upper())
        try:
            handler = {"": lambda: logging.StreamHandler(sys.stderr), "stderr": lambda: logging.StreamHandler(sys.stderr), "stdout": lambda: logging.StreamHandler(sys.stdout), "off": logging.NullHandler}.get(dest, lambda: WatchedFileHandler(dest, encoding="utf-8"))()
        except OSError:
            handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        made.addHandler(handler)
        _cache[dest, level] = made
    return _cache[dest, level]


def write_pid(path: str) -> None:
    """Write the process id, if a path is given."""
    if path:
        with open(path, "w", encoding="ascii") as f:
            f.write(str(os.getpid()))


def mail_lines(messages: DataFrame, log_received: bool = True) -> DataFrame:
    """A log line for each message: who sent it and what its headers are; none if received mails aren't logged."""
    to = F.array_join("rcpt_to", ",")
    line = F.concat(F.lit("Mail from: "), F.col("mail_from"), F.lit(" / to: "), to)
    return messages.where(F.lit(log_received)).select(line.alias("line"))


def peer(address: Column) -> Column:
    """The address field of a log line."""
    return F.coalesce(address, F.lit("unknown"))


#: Levels, from the most to the least severe.
LEVELS = ["panic", "fatal", "error", "warn", "info", "debug"]


def shown(level: Column, threshold: str) -> Column:
    """Whether lines of a level are written at a threshold."""
    rank = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.lower(level))
    return (rank > 0) & (rank <= LEVELS.index(threshold) + 1)
