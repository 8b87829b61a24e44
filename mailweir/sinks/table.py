"""Row sinks: Parquet by batch, and any database that Python's DB-API reaches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row

#: Rows of one insert, attempts, seconds between two.
BATCH_ROWS, ATTEMPTS, PAUSE = 50, 3, 1.0


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch has its own folder, so a batch that is run again replaces what it wrote."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def insert_rows(df: DataFrame, connect: Callable[[], Any], table: str, key: str, rows: int = BATCH_ROWS, attempts: int = ATTEMPTS, pause: float = PAUSE, mark: str = "?", writers: int | None = None) -> None:
    """Insert all rows into a table, `rows` at a time in one statement and one transaction, from the executors.

    Rows of a key that is there are replaced: a failed or repeated task leaves no row twice, which needs `key` to tell rows
    apart. A batch that fails is tried again, and after the last attempt the task fails. `connect` is called once in each task. `writers`
    deals the rows at random over so many tasks.
    """
    columns = df.columns
    names, one = ", ".join(f'"{c}"' for c in columns), "(" + ", ".join([mark] * len(columns)) + ")"

    def flush(connection: Any, batch: list[Row]) -> None:
        cursor = connection.cursor()
        cursor.execute(f'DELETE FROM "{table}" WHERE "{key}" IN ({", ".join([mark] * len(batch))})', [r[key] for r in batch])
        cursor.execute(f'INSERT INTO "{table}" ({names}) VALUES {", ".join([one] * len(batch))}', [bytes(v) if isinstance(v, bytearray) else v for r in batch for v in r])
        connection.commit()

    def run(found: Iterator[Row]) -> None:
        connection = connect()
        try:
            while batch := list(islice(found, rows)):
                for attempt in range(attempts):
                    try:
                        flush(connection, batch)
                        break
                    except Exception:
                        connection.rollback()
                        if attempt + 1 == attempts:
                            raise
                        time.sleep(pause)
        finally:
            connection.close()

    (df.repartition(writers) if writers else df).foreachPartition(run)


def probe(connect: Callable[[], Any], table: str) -> None:
    """Whether the table can be read, before any row is sent; raises what the database raises."""
    connection = connect()
    try:
        connection.cursor().execute(f'SELECT * FROM "{table}" LIMIT 1')
    finally:
        connection.close()
