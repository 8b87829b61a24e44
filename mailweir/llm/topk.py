"""Exact top-k inner products with a vector-approximation file.

Components become the integers floor(256 * x). The approximation file holds, for every distinct vector,
one byte a dimension: the number of the cell (between quantiles of that dimension) in which the component lies. A
query's inner product with a cell has exact lower and upper bounds. Phase one scans the cells and keeps,
for each query, the vectors whose upper bound reaches the k-th best lower bound; phase two reads the
exact vectors of those, best bound first, until the k-th exact result beats the next bound.

Queries are a stated set; they are taken in blocks of bounded size, and each block scans the cells
once, its bounds in tiles of bounded size. What a query must read is dealt over tasks if it is much, and each keeps the k best. Equal vectors are scanned once, with at most k rows of each id and the 2 k smallest of those, which are
all that can be in an answer (k of them may have the query's id). A vector that only rows of the query's id
hold is no candidate.

Defined results: vectors null or with null or non-finite components, and null ids, take no part as
query or candidate. Vectors are compared with those of the same length only. Empty vectors score 0. Ties go to the
smaller id; rows that repeat an id are candidates each, but no row with the query's id is. Rows that repeat a
query's id are one query: its answer is the k best of all pairs of such a row and a candidate row. A component whose integer has more than 64
bits is an error, and so is an answer whose score has; products that may are summed in integers of any size. Other columns are left out; an empty
table, or one without queries, gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailweir.llm.common import lean, read_table, stored

K, EVERY, CELLS = 5, 50, 64
#: Bytes of query vectors in one block.
BLOCK_BYTES = 16 << 20
#: Rows from which the cell bounds are taken (any bounds give exact answers), and bytes of these: a bounded sample.
CELL_SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20
#: Vectors, and pairs of a query and a vector, whose bounds are in memory together.
SCAN_ROWS, TILE = 2048, 1 << 19
#: Vectors that a task reads for one query; more are dealt over several.
READ_ROWS = 512


def whole_numbers(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v, an array of floor(256 * x); rows that take no part are gone."""
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & x.isNotNull() & ~bad)
    wide = F.exists("x", lambda c: F.abs(c.cast("double") * 256) >= 2.0**63)
    whole = F.transform("x", lambda c: F.floor(c.cast("double") * 256).cast("bigint"))
    return rows.select("id", F.when(wide, F.raise_error(F.lit("a component of a vector has more than 64 bits")).cast("array<bigint>")).otherwise(whole).alias("v"))


def _matrix(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of list values by length: length, row numbers, matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    out = []
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out.append((n, rows, flat[starts[rows][:, None] + np.arange(n)]))
    return out


class Cells:
    """Cell limits of each dimension, for one vector length, from a sample; cells at the ends are open."""

    def __init__(self, sample: np.ndarray) -> None:
        self.cuts = np.unique(np.quantile(sample, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0, method="lower").astype(np.int64), axis=0) if len(sample) else np.empty((0, sample.shape[1]), np.int64)
        self.cuts.sort(axis=0)

    def codes(self, v: np.ndarray) -> np.ndarray:
        """Cell c of a dimension holds values from cuts[c - 1] to cuts[c] - 1."""
        return np.stack([np.searchsorted(self.cuts[:, j], v[:, j], side="right") for j in range(v.shape[1])], 1).astype(np.uint8) if v.shape[1] else np.empty((len(v), 0), np.uint8)


def _spans(exact: DataFrame) -> DataFrame:
    """dims, lo and hi: the least and greatest value of each dimension, by length; each task sends one row a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for n, _, v in _matrix(b.column("v")):
                if n:
                    lo, hi = v.min(axis=0), v.max(axis=0)
                    found[n] = (np.minimum(lo, found[n][0]), np.maximum(hi, found[n][1])) if n in found else (lo, hi)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([f[k].tolist() for f in found.values()], pa.list_(pa.int64())) for k in (0, 1))], ["dims", "lo", "hi"])

    each = exact.select("v").mapInArrow(lean(run), "dims int, lo array<bigint>, hi array<bigint>")
    rows = each.select("dims", F.posexplode(F.arrays_zip("lo", "hi")).alias("j", "x")).groupBy("dims", "j").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    sorted_ = rows.groupBy("dims").agg(F.array_sort(F.collect_list(F.struct("j", "lo", "hi"))).alias("a"))
    return sorted_.select("dims", F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi"))


def build_file(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, dict]:
    """The approximation file (number, dims, codes, sole: the id, if all rows have one), the exact file (number, v, ids) and the limits by length.

    The true least and greatest value of each dimension bound the end cells.
    """
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    each = hashed.withColumn("n", F.row_number().over(Window.partitionBy("h", "v", "id").orderBy("id"))).where(F.col("n") <= k)
    few = each.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("n") <= 2 * k)
    exact = stored(few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("number", F.monotonically_increasing_id()).select("number", F.size("v").alias("dims"), "v", "ids"), "exact")
    spans = {r["dims"]: (np.array(r["lo"], np.int64), np.array(r["hi"], np.int64)) for r in _spans(exact).collect()}  # a row for each length
    few_rows = max(1, min(CELL_SAMPLE, SAMPLE_BYTES // (8 * max(spans, default=1) + 8)))
    sample = [r["v"] for r in exact.orderBy(F.xxhash64("v")).limit(few_rows).select("v").collect()]
    limits = {0: (Cells(np.empty((0, 0), np.int64)), np.zeros((1, 0)), np.zeros((1, 0)))}  # empty vectors have no dimension to bound
    for n, (least, most) in spans.items():
        cells = Cells(np.array([s for s in sample if len(s) == n], np.int64).reshape(-1, n))
        inner = np.clip(cells.cuts, least, most)
        limits[n] = (cells, np.concatenate([least[None, :], inner]), np.concatenate([np.maximum(inner - 1, least), most[None, :]]))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, rows, v in _matrix(b.column("v")):
                codes = limits[n][0].codes(v) if n else np.empty((len(rows), 0), np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("number").take(pa.array(rows)), pa.array(np.full(len(rows), n), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("sole").take(pa.array(rows))], ["number", "dims", "codes", "sole"])

    sole = F.when(F.col("ids")[0] == F.element_at("ids", -1), F.col("ids")[0])
    return stored(exact.withColumn("sole", sole).mapInArrow(lean(code), "number bigint, dims int, codes binary, sole bigint"), "cells"), exact, limits


def _bounds(codes: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with any vector of each cell."""
    j = np.arange(codes.shape[1])
    lo, hi = low[codes, j].astype(float), high[codes, j].astype(float)
    plus, minus = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    least, most = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
    slack = 1e-9 * (np.abs(plus).sum(1, keepdims=True) + np.abs(minus).sum(1, keepdims=True)) * max(float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0)))
    return least - np.where(slack > 0.5, slack, 0), most + np.where(slack > 0.5, slack, 0)


def _query_blocks(queries: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, list[int]]]]:
    block: list[tuple[int, list[int]]] = []
    size = 0
    for r in queries.orderBy("id").toLocalIterator():
        block.append((r["id"], r["v"]))
        size += 8 * len(r["v"]) + 8
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates; both tables as of `whole_numbers`."""
    cells, exact, limits = build_file(vectors, k)
    queries = queries.withColumn("n", F.row_number().over(Window.partitionBy("id", "v").orderBy("id"))).where(F.col("n") <= k)  # of equal rows no more can matter
    parts = [_search(cells, exact, limits, block, k) for block in _query_blocks(queries, block_bytes)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(cells: DataFrame, exact: DataFrame, limits: dict, block: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """query_id, vec_id and score: the k best candidates of each row of a query block."""
    spark = cells.sparkSession
    by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {len(v) for _, v in block}:
        rows = [(i, v) for i, (_, v) in enumerate(block) if len(v) == n]
        by_dims[n] = (np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.int64).reshape(len(rows), n))
    ids = np.array([i for i, _ in block], np.int64)
    shared = spark.sparkContext.broadcast(pickle.dumps((by_dims, limits)))  # at most BLOCK_BYTES of queries, and the limits
    need = k  # each vector that takes part holds a candidate

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, limits_ = pickle.loads(shared.value)
        best = {n: np.full((len(rows), need), -np.inf) for n, (rows, _) in queries.items()}
        kept: dict[int, list[tuple[np.ndarray, ...]]] = {n: [] for n in queries}
        for b in batches:
            dims, numbers = b.column("dims").to_numpy(zero_copy_only=False), b.column("number").to_numpy(zero_copy_only=False)
            single, sole = b.column("sole").is_valid().to_numpy(zero_copy_only=False), b.column("sole").fill_null(0).to_numpy(zero_copy_only=False)
            for n in set(np.unique(dims).tolist()) & queries.keys():
                mine = np.flatnonzero(dims == n)
                codes = np.frombuffer(b"".join(b.column("codes").take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), n)
                for start in range(0, len(mine), SCAN_ROWS):
                    some, each = mine[start : start + SCAN_ROWS], max(1, TILE // SCAN_ROWS)
                    for i in range(0, len(queries[n][0]), each):  # a tile
                        tile = slice(i, i + each)
                        least, most = _bounds(codes[start : start + SCAN_ROWS], queries[n][1][tile], *limits_[n][1:])
                        none = single[some] & (sole[some] == ids[queries[n][0][tile]][:, None])
                        least[none] = -np.inf
                        both = np.concatenate([best[n][tile], least], 1)
                        best[n][tile] = -np.partition(-both, need - 1, axis=1)[:, :need]
                        q, c = np.nonzero((most >= best[n][tile].min(1, keepdims=True)) & ~none)
                        kept[n].append((q + i, numbers[mine[start + c]], least[q, c], most[q, c]))
                if len(kept[n]) > 64:  # what the bounds that were found since rule out goes
                    q, c, least, most = (np.concatenate(x) for x in zip(*kept[n], strict=True))
                    good = most >= best[n].min(1)[q]
                    kept[n] = [(q[good], c[good], least[good], most[good])]
        for n, found in kept.items():
            if found:
                q, c, least, most = (np.concatenate(x) for x in zip(*found, strict=True))
                good = most >= best[n].min(1)[q]
                q, c, least, most = q[good], c[good], least[good], most[good]
                yield pa.RecordBatch.from_arrays([pa.array(queries[n][0][q], pa.int32()), pa.array(c, pa.int64()), pa.array(least), pa.array(most)], ["q", "number", "least", "most"])

    near = stored(cells.mapInArrow(lean(scan), "q int, number bigint, least double, most double"), "near")
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("least").desc(), "number"))).where(F.col("n") <= need)
    floor = ranked.groupBy("q").agg(F.when(F.count(F.lit(1)) >= need, F.min("least")).otherwise(F.lit(float("-inf"))).alias("floor"))
    wanted = near.join(floor, "q").where(F.col("most") >= F.col("floor")).select("q", "number", "most")
    shares = wanted.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / READ_ROWS).alias("shares"))
    wanted = wanted.join(shares, "q").select("q", "number", "most", F.pmod(F.xxhash64("number"), F.col("shares")).cast("int").alias("share"))
    read = wanted.join(exact.select("number", "v", "ids"), "number").repartition("q", "share").sortWithinPartitions("q", "share", F.col("most").desc())

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, _ = pickle.loads(shared.value)
        vector = {int(i): v for rows, vs in queries.values() for i, v in zip(rows, vs, strict=True)}
        now, scores, out = None, [], []
        most_of = {i: int(np.abs(x).max(initial=0)) for i, x in vector.items()}
        for b in batches:
            for q, share, most, v, members in zip(*(b.column(c).to_pylist() for c in ("q", "share", "most", "v", "ids")), strict=True):
                if (q, share) != now:
                    out += scores
                    now, scores, own = (q, share), [], int(ids[q])
                if len(scores) >= k and scores[-1][2] > most:
                    continue  # certain: what follows can't reach the k-th result
                wide = most_of[q] * max(map(abs, v), default=0) * len(v) >= 1 << 63
                score = sum(a * b for a, b in zip(vector[q].tolist(), v, strict=True)) if wide else int(vector[q] @ np.array(v, np.int64))
                scores = sorted([*scores, *((own, m, score) for m in members if m != own)], key=lambda s: (-s[2], s[1]))[:k]
        out += scores
        if any(abs(r[2]) >= 1 << 63 for r in out):
            raise OverflowError("the score of an answer has more than 64 bits")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return read.mapInArrow(lean(refine), "query_id bigint, vec_id bigint, score bigint")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the five best candidates of every fiftieth vector."""
    vectors = stored(whole_numbers(read_table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("id") % EVERY == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
