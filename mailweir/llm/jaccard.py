"""Exact n-gram Jaccard join with components, by set-relation skipping.

Sets of shingles are joined through index lists of rare shingles (prefix filter), in three ways that
skip work:

* Index level. Shingles are ordered by how many sets hold them, in classes of powers of two, then by hash. A
  pair of similar sets shares one of the first `n - ceil(0.75 n) + 1` shingles of either. Shingles that
  one set alone holds come first and need no list, and a set with too few shared shingles is dropped
  whole. Lists are cut into blocks by set size, so that members whose sizes rule out a link aren't met.
* Answer level. In each list a pivot set is compared with the others first. From the overlaps with
  the pivot, the overlap of two members is bounded from above and below; only where the bounds leave the
  answer open are the two sets read and compared.
* Links only matter for components between sets that aren't yet in one component, so a list whose members all are in
  one component is done. A list of m copies of a text thus costs m comparisons, not m * m.

All links (`set_links`) are then sought within components, as no link leaves one: the sets of a component are dealt into
sides by size, and any two sides whose sizes allow a link meet once, in one task, by counting common shingles.

How many sets hold a shingle is counted exactly: blocks of sets send their sorted shingles to hash buckets, a
row for each block and bucket, and get back only those that are shared. No group of equal or similar
texts meets in a task: blocks hold a set once, equal sets are one set from then on, and lists are joined with their
pivots by an ordinary join, which Spark splits where a list is long.

Words are runs without white space (bytes 09-0D and 20), after A-Z is lower-cased. Shingles are 64-bit hashes (in
the count and join, of 48 bits and the bucket's).

Defined results: null, empty and wordless texts have an empty set, are linked with nothing and are their own
component. With fewer words than a shingle, the whole sequence is the only one. Rows with a null doc_id take
part, but don't name a component unless all of its ids are null. Rows that repeat a doc_id are documents of their own. An empty table
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailweir.llm.common import LOWER_AZ, discard, lean, read_table, slices, stored, texts_of

WORDS, SHARE = 5, 75
#: Shingles of one block of sets, and of one hash bucket (both bound a task's memory).
BLOCK_SHINGLES, BUCKET_SHINGLES = 1 << 20, 2 << 20
#: Links that a task contracts at a time.
CHUNK_LINKS = 1 << 18
#: Members of a list's largest component that are compared with the rest of the list in one turn.
PIVOTS = 4
#: Sets and shingles of one side of a comparison in `set_links`, and shingles that are counted at a time.
SIDE_SETS, SIDE_SHINGLES, COUNTED = 512, 1 << 19, 4096
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        with np.errstate(over="ignore"):
            self.value = _mix(np.arange(1, 257, dtype=_U) * _BASE)
            self.up = np.empty(0, _U)
            self.inverse = _U(pow(int(_BASE), -1, 1 << 64))
        self._grow(SEGMENT + 1024)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[_U(1)], np.full(n, b, _U)])) for b in (_BASE, self.inverse))

    def word_hashes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and hash of each word of lower-cased bytes; the hash is of the word's bytes alone."""
        n = len(text)
        self._grow(n + 1)
        word = ~_SPACE[text]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.concatenate([[_U(0)], np.cumsum(self.value[text] * self.up[:n])])
            return begin, _mix((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(_U) * _U(0xD6E8FEB86659FD93))

    def all_words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for bytes of any length, in segments that end at white space."""
        text = text.translate(LOWER_AZ)
        data = np.frombuffer(text, np.uint8)
        if len(data) <= SEGMENT:
            return self.word_hashes(data)
        begins, hashes, at = [], [], 0
        while at < len(data):
            end = at + SEGMENT
            if end < len(data):
                gaps = np.flatnonzero(_SPACE[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    while end < len(data) and not _SPACE[data[end]]:
                        end += 1
            b, h = self.word_hashes(data[at:end])
            begins.append(b + at)
            hashes.append(h)
            at = end
        return np.concatenate(begins), np.concatenate(hashes)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        parts = [t or b"" for t in texts]
        begin, hashed = self.all_words(b"\n".join(parts))
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        first = np.searchsorted(begin, starts)
        k, m = self.words, len(hashed)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(m - k + 1, 0), _U)
            for i in range(k):
                rolled = rolled * _BASE + hashed[i : m - k + 1 + i] if m >= k else rolled
            rolled = _mix(rolled)
            out = []
            for i, j in zip(first.tolist(), first[1:].tolist(), strict=False):
                if j - i >= k:
                    out.append(np.unique(rolled[i : j - k + 1]))
                elif j > i:
                    x = _U(j - i)
                    for w in hashed[i:j]:
                        x = x * _BASE + w
                    out.append(_mix(np.array([x], _U)))
                else:
                    out.append(np.empty(0, _U))
        return out


def _signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from slices(b, "text", 2 << 20)


def set_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and sig (16 bytes that equal sets share; null for the empty set), and what else `docs` has beside its text; map-only."""
    more = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in _sized(batches):
            sets = shingler.sets(texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()), *(b.column(f.name) for f in more)], ["doc_id", "n_shingles", "sig", *(f.name for f in more)]
            )

    return docs.mapInArrow(lean(run), T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType()), *more]))


def _least(n: np.ndarray | int) -> np.ndarray | int:
    """The smallest overlap that a set of n shingles needs for a link."""
    return -(-SHARE * n // 100)


def _both(n, m):
    """The smallest overlap with which sets of n and m shingles link."""
    return -(-SHARE * (n + m) // (100 + SHARE))


_SENT = "head int, bucket int, block bigint, a binary, b binary, c binary, d binary"
#: In place of an owner: several sets of the block hold the shingle; the block's own row says which.
_SEVERAL = np.uint32(0xFFFFFFFF)


def shared_shingles(docs: DataFrame, shingles: int) -> DataFrame:
    """id, sig, n and keys (shared shingles, as 64-bit numbers in list order) of every distinct set that may have a link."""
    bits = min(max(6, int(-(-shingles // BUCKET_SHINGLES) - 1).bit_length()), 16)
    buckets, drop = 1 << bits, _U(16 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, task = Shingler(), TaskContext.get().partitionId()
        seen: dict[bytes, np.ndarray] = {}
        total = number = 0

        def block() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in seen.values()], np.uint32)
            keys = np.concatenate(list(seen.values())) >> drop
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times = np.diff(np.append(first, len(keys))).astype(np.uint32)
            several = times > 1  # one entry for the block, so that a shingle of very many sets isn't as many entries of its bucket
            whose = b"".join([struct.pack("<Q", int(several.sum())), keys[first[several]].tobytes(), times[several].tobytes(), owner[np.repeat(several, times)].tobytes()])
            keys, owner = keys[first], np.where(several, _SEVERAL, owner[first])
            ends = np.searchsorted(keys >> _U(48), np.arange(buckets + 1, dtype=_U))
            low, high = keys.astype(np.uint32), ((keys >> _U(32)) & _U(0xFFFF)).astype(np.uint16)
            rows = [
                (0, k, np.diff(high[i:j], prepend=_U(0).astype(np.uint16)).tobytes(), low[i:j].tobytes(), owner[i:j].tobytes(), times[i:j][several[i:j]].tobytes())
                for k, (i, j) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)) if j > i
            ]
            rows.append((1, (task * 31 + number) % buckets, b"".join(seen), sizes.tobytes(), whose, b""))
            for part in range(0, len(rows), 64):
                some = rows[part : part + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int32()), pa.array([task << 24 | number] * len(some), pa.int64()), *(pa.array([r[k] for r in some], pa.binary()) for k in (2, 3, 4, 5))],
                    ["head", "bucket", "block", "a", "b", "c", "d"],
                )

        for b in _sized(batches):
            for s in shingler.sets(texts_of(b.column("text"))):
                if len(s) and (sig := _signature(s)) not in seen:
                    seen[sig] = s
                    total += len(s)
            if total >= BLOCK_SHINGLES:
                yield from block()
                seen, total, number = {}, 0, number + 1
        if seen:
            yield from block()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def answer() -> Iterator[pa.RecordBatch]:
            low, owner, weight = [], [], []
            for _, a, b, c, d in held:
                high = np.cumsum(np.frombuffer(a, np.uint16), dtype=np.uint16).astype(_U)
                low.append(high << _U(32) | np.frombuffer(b, np.uint32))
                owner.append(np.frombuffer(c, np.uint32))
                many = np.ones(len(low[-1]), np.int64)
                many[owner[-1] == _SEVERAL] = np.frombuffer(d, np.uint32)
                weight.append(many)
            ids = [x for x, *_ in held]
            keys, owner, block = np.concatenate(low), np.concatenate(owner), np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in low])
            order = np.argsort(keys)
            keys = keys[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held_by = np.repeat(np.add.reduceat(np.concatenate(weight)[order], new), np.diff(np.append(new, len(keys))))
            shared = held_by >= 2
            keys, owner, block = keys[shared] | _U(now) << _U(48), owner[order][shared], block[order][shared]
            rank = np.frexp(held_by[shared].astype(float))[1].astype(np.uint8)
            order = np.argsort(block, kind="stable")
            ends = np.searchsorted(block[order], np.arange(len(ids) + 1))
            for k, (i, j) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                if j > i:
                    mine = order[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([ids[k]], pa.int64()), *(pa.array([x], pa.binary()) for x in (keys[mine].astype(_U).tobytes(), owner[mine].tobytes(), rank[mine].tobytes()))], ["head", "block", "a", "b", "c"])

        for batch in batches:
            for head, bucket, block, a, b, c, d in zip(*(batch.column(x).to_pylist() for x in ("head", "bucket", "block", "a", "b", "c", "d")), strict=True):
                if head:
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (a, b, c))], ["head", "block", "a", "b", "c"])
                    continue
                if bucket != now and held:
                    yield from answer()
                    held = []
                now = bucket
                held.append((block, a, b, c, d))
        if held:
            yield from answer()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, sigs, sizes, whose = None, [], b"", np.empty(0, np.uint32), b""

        def finish() -> pa.RecordBatch:
            rows = []
            if parts and len(sizes):
                keys, owner, rank = (np.concatenate([np.frombuffer(p[k], t) for p in parts]) for k, t in enumerate((_U, np.uint32, np.uint8)))
                several = owner == _SEVERAL
                if several.any():  # of the block's row: all that it has are shared
                    (n,) = struct.unpack_from("<Q", whose)
                    known, times = np.frombuffer(whose, _U, n, 8), np.frombuffer(whose, np.uint32, n, 8 + 8 * n)
                    ranks = np.empty(n, np.uint8)
                    ranks[np.searchsorted(known, keys[several])] = rank[several]
                    keys, owner, rank = (np.concatenate([x[~several], y]) for x, y in ((keys, np.repeat(known, times)), (owner, np.frombuffer(whose, np.uint32, -1, 8 + 12 * n)), (rank, np.repeat(ranks, times))))
                order = np.lexsort((keys, rank, owner))
                keys, owner = keys[order], owner[order]
                ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
                for i in np.flatnonzero(np.diff(ends) >= _least(sizes.astype(np.int64))).tolist():
                    rows.append((sigs[16 * i : 16 * i + 16], int(sizes[i]), keys[ends[i] : ends[i + 1]].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.binary()))], ["sig", "n", "keys"])

        for batch in batches:
            for head, block, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("head", "block", "a", "b", "c")), strict=True):
                if block != now:
                    yield finish()
                    now, parts, sizes = block, [], np.empty(0, np.uint32)
                if head:
                    sigs, sizes, whose = a, np.frombuffer(b, np.uint32), c
                else:
                    parts.append((a, b, c))
        yield finish()

    sent = docs.select("text").mapInArrow(lean(send), _SENT)
    counted = stored(sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(count), "head int, block bigint, a binary, b binary, c binary"), "counted")
    sets = counted.repartition("block").sortWithinPartitions("block").mapInArrow(lean(gather), "sig binary, n int, keys binary")
    out = sets.groupBy("sig", "n").agg(F.first("keys").alias("keys"))
    out = stored(out.select(F.monotonically_increasing_id().alias("id"), "sig", "n", "keys"), "shared")
    discard(counted)
    return out


def _postings(sets: DataFrame) -> DataFrame:
    """The index lists: key, band (block of the list by size), own (the set's band), id, n, pos (place in the set's order).

    Bands are powers of 4/3, so that similar sets are in one band or in neighbours; a block holds a band and
    the next larger one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, n, blob in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("keys").to_pylist(), strict=True):
                shared = np.frombuffer(blob, np.int64)
                alone = n - len(shared)  # shingles of this set alone come first
                own = int(np.log(n) / np.log(4 / 3) + 1e-9)
                for band in (own, own - 1):
                    smallest = max(int(_least(n)), int((4 / 3) ** band))
                    first = min(n - _both(n, smallest) + 1 - alone, len(shared))
                    if first > 0:
                        for column, x in zip(columns, (shared[:first], *(np.full(first, v) for v in (band, own, i, n)), np.arange(alone, alone + first)), strict=True):
                            column.append(x)
            key, band, own_, id_, n_, pos = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (band, own_)), pa.array(id_, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (n_, pos))], ["key", "band", "own", "id", "n", "pos"])

    return sets.select("id", "n", "keys").mapInArrow(lean(run), "key bigint, band int, own int, id bigint, n int, pos int")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the exact overlap of each pair (p, id); sets that many pairs name are split by Spark's join."""
    one = sets.select("id", F.col("keys").alias("x"))
    two = sets.select(F.col("id").alias("p"), F.col("keys").alias("y"))
    read = pairs.join(one, "id").join(two, "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None
        for b in batches:
            both = []
            for p, x, y in zip(b.column("p").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if p != last:
                    last, pivot = p, np.sort(np.frombuffer(y, np.int64))
                other = np.frombuffer(x, np.int64)
                at = np.minimum(np.searchsorted(pivot, other), len(pivot) - 1)
                both.append(int((pivot[at] == other).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("p", "id", "pn", "n", "pc", "comp")), pa.array(both, pa.int32())], ["p", "id", "pn", "n", "pc", "comp", "o"])

    return read.mapInArrow(lean(run), "p bigint, id bigint, pn int, n int, pc bigint, comp bigint, o int")


def _linked(o, n, m):
    """100 * intersection >= 75 * union."""
    return (100 + SHARE) * o >= SHARE * (n + m)


def _stars(links: DataFrame, level: int) -> DataFrame:
    """Each set of the links (p, id) with the first set that it reaches over the links of one task, in this level's order.

    A task holds CHUNK_LINKS links at a time. The order is another one at each level, so that every level leaves fewer sets.
    """
    salt = _mix(np.array([level + 1], _U) * _BASE)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def finish() -> pa.RecordBatch:
            names, ends = np.unique(np.concatenate(held), return_inverse=True)
            rank = _mix(names.astype(_U) ^ salt) >> _U(1)
            order = np.argsort(rank, kind="stable")
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            u, w = place[ends].reshape(-1, 2).T
            low = np.arange(len(names))
            while (low[u] != low[w]).any():
                x, y = low[u], low[w]
                least = np.minimum(x, y)
                np.minimum.at(low, x, least)
                np.minimum.at(low, y, least)
                while ((far := low[low]) != low).any():
                    low = far
            first = order[low]
            return pa.RecordBatch.from_arrays([pa.array(names[order]), pa.array(rank[first].astype(np.int64)), pa.array(names[first])], ["id", "rank", "root"])

        for b in batches:
            held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("p", "id")], 1).ravel())
            if sum(map(len, held)) >= 2 * CHUNK_LINKS:
                yield finish()
                held = []
        if sum(map(len, held)):
            yield finish()

    return links.select("p", "id").mapInArrow(lean(run), "id bigint, rank bigint, root bigint")


def components(links: DataFrame) -> DataFrame:
    """id and comp (one set of the component, the same for all) of every set that links (p, id) name.

    Each task contracts its links to stars. A set's roots, one for each task that met it, are then links of the
    next level, which holds roots only.
    """
    levels = []
    while True:
        roots = _stars(links, len(levels)).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("rank", "root"))).alias("roots"))
        now = stored(roots.select("id", F.col("roots")[0]["root"].alias("comp"), F.transform(F.expr("slice(roots, 2, size(roots))"), lambda r: r["root"]).alias("others")), "level")
        levels.append(now)
        left = now.agg(F.sum(F.size("others"))).first()[0]
        if not left:
            break
        links = now.select(F.col("comp").alias("p"), F.explode("others").alias("id")).coalesce(-(-left // CHUNK_LINKS))
    found = levels.pop().select("id", "comp")
    for now in reversed(levels):
        found = now.select("id", "comp").join(found.select(F.col("id").alias("comp"), F.col("comp").alias("far")), "comp", "left").select("id", F.coalesce("far", "comp").alias("comp"))
    return found


_MEMBER = {"p": "id", "pn": "n", "ppos": "pos", "pown": "own", "pc": "comp"}


def _member(salt: int, suffix: str = "") -> list:
    """Of the rows of a group, that of the set with the smallest hash, as aggregates that Spark keeps in a hash table."""
    h = F.xxhash64("id", F.lit(salt))  # of a long: no two sets have one
    return [F.min_by(of, h).alias(name + suffix) for name, of in _MEMBER.items()]


def _meetings(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (p < id) that a list suggests: each row with the pivots of its list.

    Left out are pairs of one component, pairs that another block of the list holds, and pairs whose sizes or
    places in the list rule out a link: if this is their first common shingle, no more than what follows can
    be common, and if it isn't, the list of the first one suggests them.
    """
    need = F.ceil((F.col("n") + F.col("pn")) * SHARE / (100 + SHARE))
    met = rows.join(pivots, ["key", "band"]).where(
        (F.col("comp") != F.col("pc")) & (F.least("own", "pown") == F.col("band")) & (100 * F.least("n", "pn") >= SHARE * F.greatest("n", "pn"))
        & (F.col("n") - F.col("pos") >= need) & (F.col("pn") - F.col("ppos") >= need)
    )
    less = F.col("p") < F.col("id")
    pick = lambda a, b: F.when(less, F.col(a)).otherwise(F.col(b))
    return met.select(pick("p", "id").alias("p"), pick("id", "p").alias("id"), pick("pn", "n").alias("pn"), pick("n", "pn").alias("n"), pick("pc", "comp").alias("pc"), pick("comp", "pc").alias("comp")).distinct()


def set_components(sets: DataFrame) -> DataFrame:
    """id and comp of every set of `shared_shingles`.

    First every list's pivot meets the others. Where a list still has several components, a few members of its
    largest one (PIVOTS, twice) meet what isn't in it. What then is left meets all of its list.
    """
    lists = _postings(sets)
    many = lists.groupBy("key", "band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = stored(lists.join(many, ["key", "band"], "left_semi"), "lists")
    labels, known = sets.select("id", F.col("id").alias("comp")), []
    for turn in range(4):
        rows = lists.join(labels, "id")
        if turn == 0:
            todo = _meetings(rows, rows.groupBy("key", "band").agg(*_member(0))).withColumn("sure", F.lit(False))
        else:
            several = rows.groupBy("key", "band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b")
            open_lists = stored(rows.join(several.select("key", "band"), ["key", "band"], "left_semi"), "open")
            discard(lists)  # from here on, lists whose members are all in one component are left out
            lists, rows = open_lists.drop("comp"), open_lists
            lists._mailweir_path = open_lists._mailweir_path
            by_comp = rows.groupBy("key", "band", "comp").agg(F.count(F.lit(1)).alias("m"), *(c for i in range(PIVOTS) for c in _member(PIVOTS * turn + i, str(i))))
            largest = by_comp.groupBy("key", "band").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
            left = rows.join(largest, ["key", "band"]).where("comp <> main").drop("main")
            if not rows.limit(1).count():
                discard(lists)
                break
            if turn < 3:
                each = F.array_distinct(F.array(*(F.struct(*(F.col(f"{c}{i}").alias(c) for c in _MEMBER)) for i in range(PIVOTS))))
                heads = by_comp.join(largest, ["key", "band"]).where("comp = main")
                some = heads.select("key", "band", F.explode(each).alias("pivot")).select("key", "band", "pivot.*")
            else:
                some = rows.select("key", "band", *(F.col(of).alias(c) for c, of in _MEMBER.items()))
            before = functools.reduce(DataFrame.unionAll, known)
            todo = _open_pairs(_meetings(left, some).join(before.select("p", "id"), ["p", "id"], "left_anti"), before)
        todo = stored(todo, "pairs")
        found = _overlaps(todo.where("NOT sure").drop("sure"), sets)
        found = stored(found.unionAll(todo.where("sure").select("p", "id", "pn", "n", "pc", "comp", F.lit(None).cast("int").alias("o"))), "overlaps")
        discard(todo)
        known.append(found)
        new = found.where(F.col("o").isNull() | _linked(F.col("o"), F.col("n"), F.col("pn")))
        merged = components(new.select(F.col("pc").alias("p"), F.col("comp").alias("id")))  # of components, not of sets
        merged = merged.select(F.col("id").alias("comp"), F.col("comp").alias("now"))
        old, labels = labels, stored(labels.join(merged, "comp", "left").select("id", F.coalesce("now", "comp").alias("comp")), "components")
        if turn:
            discard(old)
    discard(*known)
    return labels


def _open_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Drop pairs that can't link, mark those that must, by what both sets have in common with one pivot.

    Each set's best known pivot is that with which it shares most.
    """
    best = known.where("o IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("p", "pn", "o"), "o").alias("k"))
    of = lambda name: best.select(F.col("id").alias(name), F.col("k").alias(f"k_{name}"))
    both = pairs.join(of("p"), "p", "left").join(of("id"), "id", "left")
    same = F.col("k_p.p") == F.col("k_id.p")
    a, b = F.col("k_p.o"), F.col("k_id.o")
    most = F.least(a, b) + F.least(F.col("pn") - a, F.col("n") - b)
    least = a + b - F.col("k_p.pn")
    marked = both.withColumn("sure", F.coalesce(same & _linked(least, F.col("n"), F.col("pn")), F.lit(False)))
    return marked.where(~F.coalesce(same & ~_linked(most, F.col("n"), F.col("pn")), F.lit(False))).select("p", "id", "pn", "n", "pc", "comp", "sure")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of `left` has in common with each of `right`; a set's shingles are distinct."""
    known = np.unique(np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for side in (left, right):
        keys, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        some = known[at] == keys
        order = np.argsort(at[some], kind="stable")
        sides.append((at[some][order], owner[some][order]))
    for begin in range(0, len(known), COUNTED):
        both = []
        for (at, owner), side in zip(sides, (left, right), strict=True):
            i, j = np.searchsorted(at, (begin, begin + COUNTED))
            has = np.zeros((len(side), min(COUNTED, len(known) - begin)), np.float32)
            has[owner[i:j], at[i:j] - begin] = 1
            both.append(has)
        out += (both[0] @ both[1].T).astype(np.int64)
    return out


_TASK = ["comp", "a", "i", "b", "j"]


def _meeting_sides(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The sets (id, n, keys, copies) of each component of several, once for each meeting (_TASK) that they take part in; left: on which side.

    A component's sets are dealt into sides by size; any two sides whose sizes allow a link meet. `labels` has id, comp and copies.
    """
    own = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    rows = sets.select("id", "n", "keys").join(labels, "id").withColumn("own", own)
    groups = rows.groupBy("comp", "own").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("keys") / 8).alias("s"))
    sides = F.ceil(F.greatest(F.col("c") / SIDE_SETS, F.col("s") / SIDE_SHINGLES)).cast("int")
    groups = stored(groups.select("comp", "own", "c", sides.alias("k")), "groups")
    many = groups.groupBy("comp").agg(F.sum("c").alias("c")).where("c > 1").select("comp")
    near = lambda step, name: groups.select("comp", (F.col("own") - step).alias("own"), F.col("k").alias(name))
    dealt = groups.join(many, "comp", "left_semi").join(near(1, "up"), ["comp", "own"], "left").join(near(-1, "down"), ["comp", "own"], "left")
    rows = rows.join(dealt.select("comp", "own", "k", "up", "down"), ["comp", "own"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    meet = lambda a, i, b, j: F.struct(a.cast("int").alias("a"), i.cast("int").alias("i"), b.cast("int").alias("b"), j.cast("int").alias("j"))
    each = lambda n, f: F.when(F.col(n).isNull(), F.array().cast("array<struct<a:int,i:int,b:int,j:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1), f))
    mine, at = F.col("own"), F.col("side")
    meetings = F.concat(each("k", lambda x: meet(mine, F.least(at, x), mine, F.greatest(at, x))), each("up", lambda x: meet(mine, at, mine + 1, x)), each("down", lambda x: meet(mine - 1, x, mine, at)))
    return rows.select("comp", "id", "n", "keys", "copies", "own", "side", F.explode(meetings).alias("t")).select("comp", "t.*", "id", "n", "keys", "copies", ((mine == F.col("t.a")) & (at == F.col("t.i"))).alias("left"))


def _compared(sets: DataFrame, labels: DataFrame, emit: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `emit` makes of each meeting: ids and copies of both sides in a row, and for each link two places in these, and the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            one, two = [r for r in held if r[4]], [r for r in held if not r[4]]
            alone = now[1:3] == now[3:]
            two = one if alone else two
            if not one or not two or (alone and len(one) < 2):
                return
            o = _common([r[2] for r in one], [r[2] for r in two])
            n, m = (np.array([r[1] for r in side], np.int64) for side in (one, two))
            x, y = np.nonzero(_linked(o, n[:, None], m[None, :]) & (np.triu(np.ones(o.shape, bool), 1) if alone else True))
            if len(x):
                ids, copies = (np.array([r[k] for r in one] + [r[k] for r in two], np.int64) for k in (0, 3))
                yield from emit(ids, copies, x, y + len(one), o[x, y])

        for batch in batches:
            for *key, i, n, keys, copies, left in zip(*(batch.column(c).to_pylist() for c in (*_TASK, "id", "n", "keys", "copies", "left")), strict=True):
                if key != now:
                    if held:
                        yield from finish()
                    now, held = key, []
                held.append((i, n, np.frombuffer(keys, np.int64), copies, left))
        if held:
            yield from finish()

    return _meeting_sides(sets, labels).repartition(*_TASK).sortWithinPartitions(*_TASK).mapInArrow(lean(run), schema)


def set_links(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Every link between two distinct sets, once: p, id (p < id), pm, m (`copies` of either), o (overlap).

    `labels` has a column copies beside those of `set_components`.
    """

    def emit(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, y: np.ndarray, o: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, second = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        for k in range(0, len(x), 1 << 16):
            f, g = first[k : k + (1 << 16)], second[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[f], ids[g], copies[f], copies[g], o[k : k + (1 << 16)])], ["p", "id", "pm", "m", "o"])

    return _compared(sets, labels, emit, "p bigint, id bigint, pm bigint, m bigint, o bigint")


def link_counts(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """id and others, the number of documents with another set that a set links with; sets without any are left out.

    The links of a meeting are counted where they are found, and no row is made for a link. Two sets that are a component are linked.
    """
    comps = stored(labels.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("copies").alias("t")).where("c > 1"), "sizes")
    pairs = labels.join(comps.where("c = 2"), "comp").select("id", (F.col("t") - F.col("copies")).alias("others"))

    def emit(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, y: np.ndarray, o: np.ndarray) -> Iterator[pa.RecordBatch]:
        others = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
        some = np.flatnonzero(others)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(others[some].astype(np.int64))], ["id", "others"])

    large = labels.join(comps.where("c > 2").select("comp"), "comp", "left_semi")
    return _compared(sets, large, emit, "id bigint, others bigint").groupBy("id").agg(F.sum("others").alias("others")).unionByName(pairs)


def _labelled(docs: DataFrame, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, sig and comp (a name of the component; null for the empty set) of every document, and what else `docs` has beside its text.

    With `links` also n_links, the number of other documents that it links with.
    """
    ids = stored(set_ids(docs), "sets")
    total = ids.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return ids.withColumn("comp", F.col("sig")).withColumns({"n_links": F.lit(0).cast("bigint")} if links else {})
    sets = shared_shingles(docs, total)
    labels = set_components(sets)
    name = F.concat(F.lit("c"), F.col("comp").cast("string")).cast("binary").alias("comp")
    if not links:
        found = stored(sets.select("id", "sig").join(labels, "id").select("sig", name), "labels")
        discard(sets, labels)
        return ids.join(found, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    copies = stored(ids.where("sig IS NOT NULL").groupBy("sig").agg(F.count(F.lit(1)).alias("copies")), "copies")
    marked = stored(sets.select("id", "sig").join(copies, "sig").join(labels, "id"), "marked")
    found = marked.join(link_counts(sets, marked.drop("sig")), "id", "left").select("sig", name, "others")
    found = stored(copies.join(found, "sig", "left").select("sig", F.coalesce("comp", "sig").alias("comp"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "labels")
    discard(sets, labels, copies, marked)
    return ids.join(found, "sig", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def jaccard_components(docs: DataFrame, links: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    With `links` also n_links, the number of other documents that it links with.
    """
    joined = _labelled(docs.select("doc_id", "text"), links)
    least = joined.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *(["n_links"] if links else []))


def op3_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the set size, the component and the number of links of every document."""
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), links=True)


#: For tables whose doc_ids are distinct. Links by all pairs that share a shingle; components by following links from every document.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, hash(unnest(sh)) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * o >= 75 * (len(x.sh) + len(y.sh) - o)),
n AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, comp) AS (SELECT doc_id, doc_id FROM s UNION SELECT n.b, c.comp FROM c JOIN n ON n.a = c.doc_id),
m AS (SELECT doc_id, min(comp) AS component_id FROM c GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM n GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM s JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns, whatever their names: of the smallest doc_id (null last), the text with the smallest digest.

    Rows equal in doc_id and text are one key; any one of them stays. Each row with an empty set is its own
    component, and stays.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_digest")
    tagged = _labelled(docs.select("doc_id", "text", digest))
    rows = tagged.groupBy("comp", "doc_id", "_digest").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_digest", "n")).alias("k")).select("k.doc_id", "k._digest", "k.n")
    keys = stored(first.unionByName(rows.where("comp IS NULL").select("doc_id", "_digest", F.lit(1).cast("bigint").alias("n"))), "keys")
    rows_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), digest.alias("_key"))  # apart from the user's names

    def having(found: DataFrame) -> DataFrame:
        return rows_.join(found.select("doc_id", "_digest"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("_digest")), "left_semi")

    out = having(keys.where("n = 1")).select("row.*")
    repeated = keys.where("n > 1")
    if not repeated.limit(1).count():
        return out
    one = having(repeated).groupBy("_id", "_key").agg(F.first("row").alias("row"))  # combined before the exchange
    return out.unionByName(one.select("row.*"))
