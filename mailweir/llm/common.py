"""What the corpus operators share: the shared folder, Arrow helpers, small checks."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What one broadcast may hold. A larger parameter (a vocabulary, a list of rules) is refused with an error that says what to do.
MAX_BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z only.
LOWER_AZ = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def lower_az(column):
    """Lower-case A-Z and nothing else, natively."""
    from pyspark.sql import functions as F

    return F.translate(column, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (a local test session) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="mailweir-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/mailweir-{label}-{uuid.uuid4().hex}"


_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
#: For tables of large rows: the sizes of pages and row groups are looked at after each row, not only after a hundred.
_LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go when it ends, as nothing reads them again. With `batch_bytes`, functions in it get Arrow batches of about
    that size, one row at least, however large the partitions are, and the files are laid out for large rows.
    """
    spark = df.sparkSession
    path, held = fresh_path(spark, label), {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**(_LARGE_ROWS if batch_bytes else {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    back = spark.read.schema(df.schema).parquet(path)
    back._mailweir_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._mailweir_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which its owner sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_models: dict[tuple[str, str], object] = {}


def worker_model(kind: str, content: bytes, build: Callable[[bytes], object]):
    """The model of a vocabulary in a Python worker, kept between tasks that ask for it; a worker holds one model at a time."""
    key = (kind, hashlib.sha256(content).hexdigest())
    if key not in _models:
        _models.clear()
        _models[key] = build(content)
    return _models[key]


def _give_back(keep: bool = False) -> None:
    """Return freed memory to the machine: now, and from now on large blocks as soon as they are freed.

    With `keep`, blocks up to some MB stay with the process until the task ends, which asks the machine for fewer pages.
    """
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 30 << 20 if keep else 2 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20 if keep else 128 << 10)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], models: bool = False):
    """A function for mapInArrow whose worker, which Spark uses again, keeps no memory of the task (but with `models` those of `worker_model`)."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not models:
            _models.clear()
        _give_back(models)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def texts_of(array: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string or binary array."""
    return array.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text, one row at least."""
    sizes = pc.binary_length(batch.column(column).cast(pa.binary())).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= most:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def add_columns(
    df: DataFrame, text: str, fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], most: int = 8 << 20, models: bool = False
) -> DataFrame:
    """All columns of df and new ones, from a function of Arrow batches; map-only.

    `make` runs once in each task and gives the function, which gets about `most` bytes of text at a time; `models` as in `lean`. A column of df
    whose name (in any case) is that of a new one is replaced.
    """
    taken = {name.lower() for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text, most):
                made = work(part)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, *(n for n, _ in fields)])

    return df.mapInArrow(lean(run, models), schema)
