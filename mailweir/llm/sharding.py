"""Sharding by histogram sort.

Rows are ordered by a key, the pair (hash of the text, doc_id), so that equal texts lie together. A
compact table of keys and sizes is written once; from it, rounds count the exact bytes below candidate
keys over all partitions, and each round puts its probes only where a splitter isn't yet within
tolerance of its share of the bytes. A round brings back at most PROBES counts for each open splitter
(at most 64 splitters' intervals are refined at once). Then the rows are exchanged once, straight to
their place: shards are cut into slices at known counts, so a slice is a task and slots need no pass
over a whole shard. A text that many rows hold is cut into slices between their doc_ids.

A group of equal texts stays in one shard unless that would put a shard's end more than the
tolerance (1 % of a shard) from its share; then it is cut between doc_ids. So with few or long texts, of which one is more than the
tolerance, a group is cut where a boundary beside it would be farther from the share than one inside it.

Defined results: a null text has 8 bytes, crc32 0 and a key of its own group; null doc_ids come first
in their group. Rows equal in both text and doc_id have one key, and stay together in a shard and in a
task. Texts of any length count whole. An empty table gives no rows. Extra columns go along; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailweir.llm.common import discard, lean, partitions, read_table, stored

SHARDS, TOLERANCE, PROBES, OPEN = 24, 0.01, 2048, 64
#: Bytes of text that one task of the exchange should get.
SLICE_BYTES = 64 << 20
_ID = 1 << 64  # keys are hash * _ID + doc_id, both moved to start from 0
_ZERO = 1 << 63


@dataclass
class Bounds:
    """Sorted boundary keys in a form for fast comparison: hashes, and ids where a hash is cut inside."""

    hashes: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, keys: list[int]) -> Bounds:
        return cls(np.array([(k // _ID) for k in keys], np.uint64), np.array([k % _ID for k in keys], np.uint64))

    def place(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How many boundaries are at or below each key."""
        at = np.searchsorted(self.hashes, hashes, side="right")
        for cut in np.intersect1d(self.hashes[self.ids > 0], hashes):
            low, high = np.searchsorted(self.hashes, cut, side="left"), np.searchsorted(self.hashes, cut, side="right")
            mine = np.flatnonzero(hashes == cut)
            at[mine] = low + np.searchsorted(self.ids[low:high], ids[mine], side="right")
        return at


def _unsigned(column: pa.Array, missing: int) -> np.ndarray:
    """Signed 64-bit values in order as unsigned ones."""
    values = column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)
    return values.view(np.uint64) ^ np.uint64(_ZERO)


def _placed(df: DataFrame, bounds: Bounds, name: str) -> DataFrame:
    """Add the number of boundaries at or below each row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = bounds.place(_unsigned(b.column("_hash"), 0), _unsigned(b.column("doc_id"), -_ZERO))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, name])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))


def _counts(keys: DataFrame, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows between consecutive boundaries (one count more than boundaries)."""
    found = _placed(keys, Bounds.of(bounds), "_at").groupBy("_at").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in found:
        size[r["_at"]], rows[r["_at"]] = r["b"], r["n"]
    return size, rows


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[list[int], int]:
    """The keys at which shards begin (all but the first) and the total bytes."""
    top = _ID * _ID
    step = top // probes
    grid = [i * step for i in range(1, probes)]
    size, rows = _counts(keys, grid)
    edges, below, rows_below = [0, *grid, top], np.append(0, np.cumsum(size)).tolist(), np.append(0, np.cumsum(rows)).tolist()
    total = below[-1]
    allowed = tolerance * total / shards
    chosen: dict[int, int] = {}
    spans: dict[int, tuple[int, int, int]] = {}

    def settle(i: int, edges: list[int], below: list[int], rows: list[int]) -> None:
        """Take the boundary nearest to splitter i's share, or the span that holds it if that can still be cut."""
        goal = total * i / shards
        k = min(max(int(np.searchsorted(below, goal, side="right")) - 1, 0), len(edges) - 2)
        near = min((k, k + 1), key=lambda j: (abs(below[j] - goal), j))
        if abs(below[near] - goal) <= allowed or edges[k + 1] - edges[k] <= 1 or rows[k + 1] - rows[k] <= 1:
            chosen[i] = edges[near]
            spans.pop(i, None)
        else:
            spans[i] = (edges[k], edges[k + 1], below[k])

    for i in range(1, shards):
        settle(i, edges, below, rows_below)
    while spans:
        asked = {span[:2]: _probes(*span[:2], probes) for span in list(spans.values())[:OPEN]}
        bounds = sorted({b for inner in asked.values() for b in inner})
        lows, highs = min(lo for lo, _ in asked), max(hi for _, hi in asked)
        part = keys.where(F.col("_hash").between(lows // _ID - _ZERO, min(highs // _ID, _ID - 1) - _ZERO))
        size, rows = _counts(part, bounds)
        ends = dict(zip(bounds, zip(np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist(), strict=True), strict=True))
        for i, (lo, hi, under) in [(i, span) for i, span in spans.items() if span[:2] in asked]:
            inner = asked[lo, hi]
            settle(i, inner, [under + ends[b][0] - ends[lo][0] for b in inner], [ends[b][1] for b in inner])
    return [chosen[i] for i in range(1, shards)], total


def _inside(keys: DataFrame, slices: int) -> list[int]:
    """Keys that cut the rows of a hash with more than a slice's share of all rows between their doc_ids, so that they are several slices."""
    total = keys.count()
    share = max(1, -(-total // slices))
    hot = stored(keys.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * share), "hot")  # fewer than slices
    most = hot.agg(F.max("n")).first()[0]
    if not most:
        return []
    pieces = min(-(-most // share), 1 << 12)
    ids = F.percentile_approx(F.coalesce("doc_id", F.lit(-_ZERO)), [i / pieces for i in range(1, pieces)], 4 * pieces)
    rows = keys.join(hot.select("_hash"), "_hash").groupBy("_hash").agg(ids.alias("ids")).collect()
    discard(hot)
    return [(r["_hash"] + _ZERO) * _ID + i + _ZERO for r in rows for i in set(r["ids"])]


def _probes(low: int, high: int, probes: int) -> list[int]:
    """Candidate keys of a span with both its ends; between groups as long as it holds several hashes."""
    inner = {low + (high - low) * j // probes for j in range(1, probes)}
    if high // _ID - low // _ID > 1:
        inner = {b // _ID * _ID for b in inner if b // _ID * _ID > low}
    return sorted({low, high} | inner)


def histogram_sort(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of docs with size, shard and slot; shards hold near equal bytes, in key order."""
    spark = docs.sparkSession
    taken = {"size", "shard", "slot"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    keyed = docs.withColumns({"_hash": F.xxhash64(F.col(text)), "size": size})
    keys = stored(keyed.select("_hash", F.col(key).cast("bigint").alias("doc_id"), "size"), "keys")
    splitters, total = find_splitters(keys, shards)
    slices = int(min(max(total // SLICE_BYTES + 1, 4 * partitions(spark), 4 * shards), 1 << 16))
    step = _ID * _ID // slices
    bounds = sorted({*splitters, *(i * step for i in range(1, slices)), *_inside(keys, slices)})
    _, rows = _counts(keys, bounds)
    starts = sorted(splitters)
    shard_of = np.searchsorted(np.array(starts, object), np.array([0, *bounds], object), side="right") if starts else np.zeros(len(bounds) + 1, int)
    before = np.cumsum(rows) - rows
    first = np.array([before[np.searchsorted(shard_of, s)] for s in shard_of])
    base = (before - first).astype(np.int64)
    placed = _placed(keyed if key == "doc_id" else keyed.withColumn("doc_id", F.col(key)), Bounds.of(bounds), "_slice")
    n = min(len(bounds) + 1, max(partitions(spark), 4 * shards))
    dealt = placed.repartitionById(n, F.col("_slice") % n).sortWithinPartitions("_slice", "_hash", F.col("doc_id").asc_nulls_first(), text)
    names = [c for c in docs.columns]
    shard_of = shard_of.astype(np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for b in batches:
            at = b.column("_slice").to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.diff(at, prepend=-1 if not len(at) else at[0] - 1))
            slots = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
            if len(at) and at[0] == last:
                slots[: new[1] if len(new) > 1 else len(at)] += seen
            if len(at):
                last, seen = int(at[-1]), int(slots[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), b.column("size"), pa.array(shard_of[at], pa.int32()), pa.array(base[at] + slots, pa.int64())],
                [*names, "size", "shard", "slot"],
            )

    made = [T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    return dealt.mapInArrow(lean(number), T.StructType([*docs.schema.fields, *made]))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the shard and the slot of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_sort(docs).select(
        "doc_id", "size", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
