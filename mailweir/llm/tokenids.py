"""Token-id files with a minimal perfect hash index.

A shard file holds the raw ids of documents (16 or 32 bits, as the vocabulary needs) in blocks, each framed by its length, with
the documents' keys and offsets. Documents are in ascending key order over all shards; shard bounds are quantiles of the
key, and a key that holds more than a shard is dealt over several.

The index maps a key to its shard file, the byte offset of its ids there and their number. It is cut by a hash of the key into
files of about INDEX_KEYS keys; each holds a minimal perfect hash of its keys (displacements by bucket; single keys get a free slot
directly), whose slots store a 32-bit fingerprint and the place. A key is found with one index file and one shard file, whatever
their number, and a foreign key is refused by its fingerprint, or else by the key that stands at its place.

Files are written and read by Spark alone: one task writes a shard, and its number is in the file's name.

Defined results: a null text counts as empty and has the end id only. Null keys come first, are
written, and aren't indexed. Of documents with the same key the index names the first in the files; these are in the order of
their ids within a shard, and in no order over the shards of a key that holds several. Keys are integers; others are refused with
a TypeError. Texts of any length are one document; an empty table gives no shard and finds no key. Extra columns, whatever their
names, are left out of the files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailweir.llm.bpe import ENCODE_BYTES, PieceCache, content, in_order, joinable, lengths, load, packed_rows, vocabulary
from mailweir.llm.common import fresh_path, lean, partitions, read_table, slices, stored, worker_model

#: Ids in a block, unless one document has more.
BLOCK_IDS = 1 << 20
#: Bytes of text in a shard; more shards are made than the session's shuffle width if that leaves more.
SHARD_BYTES = 256 << 20
#: Keys in an index file, on average.
INDEX_KEYS = 1 << 18
#: Index or shard files that a lookup names one by one; if its keys need more, all are read.
MOST_FILES = 1000
_LOW = -(1 << 63)
_HEAD = "<4sBBHIIQ"  # magic, id bytes, spare, spare, shard, documents, ids
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _parts(keys: np.ndarray, seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, base, step and fingerprint of each key, for n slots."""
    a, b = _mix(keys, seed), _mix(keys, seed + 77)
    buckets = np.uint64(n // 2 + 1)
    return (a >> np.uint64(32)) % buckets, a & np.uint64(0xFFFFFFFF), (b & np.uint64(0x7FFFFFFF)) * np.uint64(2) + np.uint64(1), (b >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed, displacement of each bucket (negative: the slot of its only key) and slot of each distinct key."""
    n = len(keys)
    for seed in range(1 << 16):
        bucket, base, step, _ = _parts(keys, seed, n)
        displace, slot, free = np.zeros(n // 2 + 1, np.int32), np.full(n, -1, np.int64), bytearray(n)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(1 << 63)))
        groups = np.split(order, starts[1:]) if n else []
        ok = True
        for g in sorted((g for g in groups if len(g) > 1), key=len, reverse=True):
            pairs = [(int(base[i]), int(step[i])) for i in g]
            for d in range(n):  # displacements repeat after n
                found = [(b + d * s) % n for b, s in pairs]
                if len(set(found)) == len(found) and not any(free[f] for f in found):
                    break
            else:
                ok = False
                break
            displace[int(bucket[g[0]])] = d
            slot[g] = found
            for f in found:
                free[f] = 1
        if ok:
            rest = (i for i, used in enumerate(free) if not used)
            for g in groups:
                if len(g) == 1:
                    f = next(rest)
                    displace[int(bucket[g[0]])], slot[g] = -f - 1, f
            return seed, displace, slot
    raise ValueError("no hash found: are the keys distinct?")


def _slots(keys: np.ndarray, seed: int, displace: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot and the fingerprint of each key."""
    bucket, base, step, mark = _parts(keys, seed, n)
    d = displace[bucket.astype(np.int64)].astype(np.int64)
    with np.errstate(over="ignore"):
        direct = (base.astype(np.int64) + np.maximum(d, 0) * step.astype(np.int64)) % max(n, 1)
    return np.where(d < 0, -d - 1, direct), mark


def _frame(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data


def _frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Where each block of a file begins, and its bytes; a line end follows each."""
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        yield at + 8, data[at + 8 : at + 8 + n]
        at += n + 9


class Block:
    """A block of a shard file: write it with `pack`, open its bytes with the constructor."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, _, _, self.shard, docs, ids = struct.unpack_from(_HEAD, data)
        self.first = at = struct.calcsize(_HEAD)
        if magic != b"TIDB":
            raise ValueError("not a token block")
        found = []
        for kind, n in ((f"<u{self.width}", ids), ("<i8", docs), ("<u8", docs + 1), ("u1", docs)):
            found.append(np.frombuffer(data, kind, n, at))
            at += found[-1].nbytes
        if at != len(data):
            raise ValueError(f"a token block of {len(data)} bytes should have {at}")
        self.ids, self.keys, self.offsets, self.null = found

    @staticmethod
    def pack(shard: int, keys: list[int | None], docs: list[bytes], width: int) -> bytes:
        offsets = np.concatenate([[0], np.cumsum([len(d) // width for d in docs])]).astype("<u8")
        head = struct.pack(_HEAD, b"TIDB", width, 0, 0, shard, len(docs), int(offsets[-1]))
        return b"".join([head, *docs, np.array([k or 0 for k in keys], "<i8").tobytes(), offsets.tobytes(), np.array([k is None for k in keys], np.uint8).tobytes()])


class IndexPart:
    """One file of the index: a minimal perfect hash of its keys, and a fingerprint and a place in each slot."""

    @staticmethod
    def pack(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, count: np.ndarray) -> bytes:
        seed, displace, slot = build_hash(keys)
        n = len(keys)
        parts = [np.array([n, seed], "<u4"), displace.astype("<i4")]
        for values, kind in ((_parts(keys, seed, n)[3], "<u4"), (shard, "<i4"), (offset, "<u8"), (count, "<u4")):
            placed = np.zeros(n, kind)
            placed[slot] = values
            parts.append(placed)
        return b"".join(x.tobytes() for x in parts)

    def __init__(self, data: bytes) -> None:
        n, self.seed = np.frombuffer(data, "<u4", 2).tolist()
        at, found = 8, []
        for kind, m in (("<i4", n // 2 + 1), ("<u4", n), ("<i4", n), ("<u8", n), ("<u4", n)):
            found.append(np.frombuffer(data, kind, m, at))
            at += found[-1].nbytes
        self.displace, self.marks, self.shard, self.offset, self.count = found

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which of the keys are found, and shard, offset and number of ids of those; constant time a key."""
        slot, mark = _slots(keys, self.seed, self.displace, len(self.marks))
        known = self.marks[slot] == mark
        at = slot[known]
        return known, self.shard[at], self.offset[at], self.count[at]


class LibraryEncoder:
    """The tokenizers library's encoder; many distinct pieces go to it as one text."""

    def __init__(self, content: bytes) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(content.decode())
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.cache = PieceCache(self.encode_pieces, self.kind)
        spec = json.loads(content)
        self.sizes = None
        if spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]:
            self.sizes = np.zeros(self.model.get_vocab_size(), np.int64)  # bytes of each token, by which joined pieces are told apart
            for token, i in spec["model"]["vocab"].items():
                self.sizes[i] = len(token)
            for t in spec["added_tokens"]:
                self.sizes[t["id"]] = len(t["content"].encode())

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces in a row, and how many each has."""
        beside = np.flatnonzero(joinable(pieces)) if self.sizes is not None and len(pieces) else np.empty(0, np.int64)
        out = []
        for start in range(0, len(beside), 2000):
            part = beside[start : start + 2000]
            some = pieces.take(pa.array(part))
            ids = self._ids(content(some).decode())
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths(some))) + 1
            out.append((part, ids, np.diff(ends, prepend=0)))
        for i in np.setdiff1d(np.arange(len(pieces)), beside).tolist():
            ids = self._ids(pieces[i].as_py().decode())
            out.append((np.array([i]), ids, np.array([len(ids)])))
        return in_order(len(pieces), out, self.kind)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each begin (one more at the end)."""
        if self.sizes is not None:
            return self.cache.texts(texts)
        each = [self._ids(t or "") for t in texts.to_pylist()]
        return np.concatenate([np.empty(0, self.kind), *each]), np.cumsum([0, *map(len, each)])


def _encoder(content: bytes) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_model("library", content, LibraryEncoder)


def _checked(df: DataFrame, key: str):
    """The key as a long, if it is an integer."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"keys of token files are integers; {key} is {df.schema[key].dataType.simpleString()}")
    return F.col(f"`{key}`").cast("bigint")


def write_ids(docs: DataFrame, vocabulary_path: str, out: str, key: str = "doc_id", text: str = "text", shards: int | None = None, end_id: int = 0, index_keys: int = INDEX_KEYS) -> None:
    """Write shard files of all documents, in ascending key order, and their index, under `out`.

    One exchange, of ids rather than texts, by shard number; the index exchanges places only. Shards are as many as the
    session's shuffle partitions, or as SHARD_BYTES makes necessary, unless given.
    """
    spark = docs.sparkSession
    rows = docs.select(_checked(docs, key).alias("key"), F.col(f"`{text}`").alias("text"))
    n = shards or max(partitions(spark), int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    found = rows.agg(F.percentile_approx(F.coalesce("key", F.lit(_LOW)), [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    cuts = np.array(found or [], np.int64)
    shared = load(spark, vocabulary_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = _encoder(shared.value), 0
        end = np.array([end_id], model.kind)
        for batch in batches:
            for b in slices(batch, "text", ENCODE_BYTES):
                keys = b.column("key").fill_null(_LOW).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
                several = np.maximum(high - low, 1)  # shards that a key fills, between two of its cuts
                shard = np.where(high > low, low + 1 + (seen + np.arange(len(keys))) % several, low)
                seen += len(keys)
                ids, bounds = model.encode(b.column("text"))
                ids, bounds = np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column("key"), packed_rows(ids, bounds)], ["shard", "key", "packed"])

    dealt = rows.mapInArrow(lean(encode, models=True), "shard int, key bigint, packed binary")
    ordered = dealt.repartitionById(n, "shard").sortWithinPartitions(F.col("key").asc_nulls_first(), "packed")
    width = _encoder(shared.value).width

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        held: list[bytes] = []
        shard = total = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_frame(Block.pack(shard, keys, held, width))], pa.binary())], ["block"])

        for b in batches:
            for shard, k, p in zip(b.column("shard").to_pylist(), b.column("key").to_pylist(), b.column("packed").to_pylist(), strict=True):  # noqa: B007
                keys.append(k)
                held.append(p)
                total += len(p)
                if total >= BLOCK_IDS * width:
                    yield flush()
                    keys, held, total = [], [], 0
        if keys:
            yield flush()

    ordered.mapInArrow(lean(blocks), "block binary").select(F.col("block").cast("string").alias("value")).write.text(f"{out}/shards")
    places = stored(read_shards(spark, out, crc=False).where("named").select("key", "shard", "offset", "n"), "places")
    parts = max(1, -(-places.count() // index_keys))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in [[b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "shard", "offset", "n")]]]
        if found:
            key, shard, offset, count = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((offset, shard, key))
            first = order[np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))]
            yield pa.RecordBatch.from_arrays([pa.array([_frame(IndexPart.pack(key[first], shard[first], offset[first], count[first]))], pa.binary())], ["block"])

    index = places.repartitionById(parts, _part(F.col("key"), parts)).mapInArrow(lean(hashed), "block binary")
    index.select(F.col("block").cast("string").alias("value")).write.text(f"{out}/index")
    spark.range(1).select(F.lit(str(parts)).alias("value")).write.text(f"{out}/parts")


def _part(key, parts: int):
    """The index file of a key."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _files(spark: SparkSession, path: str, numbers: DataFrame | None = None) -> DataFrame:
    """number (of the task that wrote it, which is its shard or part) and content of files; of those that `numbers` names only, if these are few."""
    reader = spark.read.format("binaryFile")
    if numbers is not None:
        few = [r[0] for r in numbers.distinct().limit(MOST_FILES + 1).collect()]
        if len(few) <= MOST_FILES:
            reader = reader.option("pathGlobFilter", "{" + ",".join(f"part-{i:05d}-*" for i in few or [99999]) + "}")
    return reader.load(path).select(F.regexp_extract("path", r"part-([0-9]+)-[^/]*$", 1).cast("int").alias("number"), "content")


def read_shards(spark: SparkSession, out: str, crc: bool = True) -> DataFrame:
    """key, shard, offset (of the ids in the file, in bytes), start (ids before it in the shard), n (ids), crc and named (whether it is the first
    of its key in its block) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column("number").to_pylist(), b.column("content").to_pylist(), strict=True):
                before = 0
                for at, block in _frames(data):
                    x = Block(block)
                    if x.shard != number:
                        raise ValueError(f"shard {x.shard} stands in file {number}")
                    begin, count = x.offsets[:-1].astype(np.int64), np.diff(x.offsets).astype(np.int64)
                    named = np.append(True, x.keys[1:] != x.keys[:-1])[: len(begin)] | np.append(False, x.null[:-1] == 1)[: len(begin)]
                    whole = memoryview(x.ids.astype("<u4").tobytes()) if crc else b""
                    sums = [zlib.crc32(whole[4 * i : 4 * j]) for i, j in zip(begin.tolist(), x.offsets[1:].tolist(), strict=True)] if crc else np.zeros(len(begin), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(x.keys, mask=x.null == 1), pa.array(np.full(len(begin), number, np.int32)), pa.array(at + x.first + x.width * begin),
                            pa.array(before + begin), pa.array(count), pa.array(sums, pa.int64()), pa.array(named & (x.null == 0)),
                        ],
                        ["key", "shard", "offset", "start", "n", "crc", "named"],
                    )
                    before += len(x.ids)

    return _files(spark, f"{out}/shards").mapInArrow(lean(run), "key bigint, shard int, offset bigint, start bigint, n bigint, crc bigint, named boolean")


def locate(spark: SparkSession, out: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, shard, offset and n of the given keys that the index holds, once a key.

    Keys meet the index file that their hash names: both are dealt by its number, and each task streams its keys past it.
    """
    parts = int(spark.read.text(f"{out}/parts").first()[0])
    wanted = keys.select(_checked(keys, key).alias("key")).dropna().distinct().withColumn("number", _part(F.col("key"), parts))
    files = _files(spark, f"{out}/index", wanted.select("number") if parts > 1 else None)
    both = files.select("number", F.lit(None).cast("bigint").alias("key"), "content").unionByName(wanted.select("number", "key", F.lit(None).cast("binary").alias("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for b in batches:
            numbers = b.column("number").to_numpy(zero_copy_only=False)
            key_, blob = b.column("key"), b.column("content")
            cut = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(cut, cut[1:], strict=False):
                if i == j:
                    continue
                if now != numbers[i]:
                    now, index = numbers[i], None
                if blob[i].is_valid:  # first of its number
                    index = next((IndexPart(x) for _, x in _frames(blob[i].as_py())), None)
                    i += 1
                if index is not None and i < j:
                    some = key_.slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                    known, shard, offset, count = index.places(some)
                    yield pa.RecordBatch.from_arrays([pa.array(some[known]), pa.array(shard.astype(np.int32)), pa.array(offset.astype(np.int64)), pa.array(count.astype(np.int64))], ["key", "shard", "offset", "n"])

    dealt = both.repartitionById(min(parts, partitions(spark)), F.col("number") % min(parts, partitions(spark))).sortWithinPartitions("number", F.col("key").asc_nulls_first())
    return dealt.mapInArrow(lean(run), "key bigint, shard int, offset bigint, n bigint")


def lookup(spark: SparkSession, out: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed 32-bit ids of the given keys that the files hold, once a key, by index: only index and shard files that the keys
    need are read, if these are few."""
    found = stored(locate(spark, out, keys, key), "located")
    files = _files(spark, f"{out}/shards", found.select("shard"))
    none = lambda kind: F.lit(None).cast(kind)
    both = files.select("number", none("bigint").alias("key"), none("bigint").alias("offset"), none("bigint").alias("n"), "content").unionByName(
        found.select(F.col("shard").alias("number"), "key", "offset", "n", none("binary").alias("content"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, blocks = b"", [], []
        for b in batches:
            rows = []
            for k, offset, n, blob in zip(*(b.column(c).to_pylist() for c in ("key", "offset", "n", "content")), strict=True):
                if blob is not None:
                    data, framed = blob, list(_frames(blob))
                    starts, blocks = [at for at, _ in framed], [Block(x) for _, x in framed]
                    continue
                i = int(np.searchsorted(starts, offset, side="right")) - 1
                x = blocks[i]
                at = (offset - starts[i] - x.first) // x.width
                doc = int(np.searchsorted(x.offsets, at))
                if not x.null[doc] and x.keys[doc] == k:  # a foreign key may have the fingerprint of a known one
                    rows.append((k, np.frombuffer(data, f"<u{x.width}", n, offset).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], [key, "ids"])

    wide = partitions(spark)
    return both.repartitionById(wide, F.col("number") % wide).sortWithinPartitions("number", F.col("key").asc_nulls_first()).mapInArrow(lean(run), f"`{key}` bigint, ids binary")


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files.

    The index decides: a document that is the first of its key comes by the place that the index has for its key. Documents
    without a key, and further ones of a key, come by their own place.
    """
    rows = stored(read_shards(spark, out), "documents")
    sizes = rows.groupBy("shard").agg(F.sum("n").alias("ids"))
    before = sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))  # a row for each shard
    named = rows.where("named")
    found = named.join(locate(spark, out, named.select("key"), "key").select(F.col("key").alias("by"), "shard", "offset"), ["shard", "offset"], "left")
    first = found.where("by IS NOT NULL").select("shard", F.col("by").alias("key"), "start", "n", "crc")
    known = found.where("by IS NULL").select("shard", "key", "start", "n", "crc").join(first.select("key"), "key", "left_semi")
    rest = rows.where("NOT named").select("shard", "key", "start", "n", "crc").unionByName(known.select("shard", "key", "start", "n", "crc"))
    return first.unionByName(rest).join(before, "shard").select(F.col("key").alias("doc_id"), (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write the ids of all documents, read the files back."""
    out = fresh_path(spark, "ids")
    write_ids(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), out)
    return read_documents(spark, out)
