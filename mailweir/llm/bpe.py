"""Byte-level BPE: encoding with a segment tree over adjacent pair ranks, and decoding.

The leaves of the tree hold, for every symbol of a word, the rank of its pair with the next symbol
(with the position, so that ties go left). The root is the leftmost pair of lowest rank. A merge
changes three leaves, each repaired along its path to the root; it ends when the root holds no pair.
Words of one tree size are merged together, a step of all of them at a time.

Texts are cut at places where the pre-tokenizer always cuts: before a space between two characters
that aren't white space. A batch's distinct pieces are found by Arrow, those that a worker has met before come from
a cache of bounded bytes, and the ids of the texts are put together by numpy.

Defined results: a null text counts as empty; an empty text has no ids and decodes to "". The special
token's string in a text is that token, as in the library. Ids outside the vocabulary decode to nothing. Texts of any
length are encoded whole, and an empty table gives no rows. A column named like an output is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweir.llm.common import MAX_BROADCAST_BYTES, add_columns, read_table, worker_model

#: The published split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are encoded at a time, if no text has more.
ENCODE_BYTES = 8 << 20
#: Bytes of pieces and ids that a worker remembers.
CACHE_BYTES = 24 << 20
#: Words that are merged side by side.
BESIDE_WORDS = 20_000
#: Longest word, in symbols, that is merged beside others; longer ones go one by one.
BESIDE = 65

_NONE = np.int64(1) << 62
_SHIFT = 32
#: Bytes that are white space to Python or to the library, and the first bytes of longer white space.
_WHITE, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space, or the first or last byte of a white character."""
    white = _WHITE[data]
    lead = np.flatnonzero(_LEAD[data[:-1]]) if len(data) > 1 else np.empty(0, np.int64)
    if len(lead):
        a, b = data[lead], data[lead + 1]
        c = data[np.minimum(lead + 2, len(data) - 1)]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        white[lead[two | three]] = True
        white[lead[two] + 1] = True
        white[np.minimum(lead[three] + 2, len(data) - 1)] = True
    return white


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in a row, and the number of each text's first one (one more at the end).

    A text is cut before a space between two characters that aren't white space, where every pre-tokenizer of this
    family cuts.
    """
    array = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    begin, end = (int(bounds[0]), int(bounds[-1])) if len(array) else (0, 0)
    data = pa.py_buffer(b"") if data is None else data.slice(begin, end - begin)
    raw, bounds = np.frombuffer(data, np.uint8), bounds - begin
    first = np.zeros(len(raw), bool)
    if len(raw):
        white = _white(raw)
        first[1:-1] = (raw[1:-1] == 32) & ~white[:-2] & ~white[2:]
        first[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(first)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32).tobytes()), data])
    return pieces, np.searchsorted(starts, bounds)


def lengths(array: pa.Array) -> np.ndarray:
    """Bytes of each value of a binary or string array with 32-bit offsets, as `cut` and `take` give it."""
    return np.diff(np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1])


def content(array: pa.Array) -> bytes:
    """The bytes of all values in a row."""
    ends = np.frombuffer(array.buffers()[1], np.int32)[[array.offset, array.offset + len(array)]].tolist()
    return array.buffers()[2].slice(ends[0], ends[1] - ends[0]).to_pybytes() if array.buffers()[2] is not None else b""


def gathered(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs number `at` of a row of runs of these sizes, in a row, and where each begins (one more at the end)."""
    begin, each = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each, dtype=np.int64)])
    small = np.int32 if max(int(ends[-1]), len(flat)) < 1 << 31 else np.int64
    return flat[np.arange(ends[-1], dtype=small) + np.repeat((begin[at] - ends[:-1]).astype(small), each)], ends


def in_order(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of n things in a row and how many each has, from parts: numbers of things, their ids in a row, how many each has."""
    counts = np.zeros(n, np.int64)
    for part, _, m in parts:
        counts[part] = m
    flat, begin = np.empty(int(counts.sum()), kind), np.cumsum(counts) - counts
    for part, ids, m in parts:
        flat[np.arange(len(ids)) + np.repeat(begin[part] - (np.cumsum(m) - m), m)] = ids
    return flat, counts


class PieceCache:
    """The ids of pieces that a worker has met, in Arrow and numpy arrays of bounded bytes."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], kind: str, most: int = CACHE_BYTES) -> None:
        self.encode, self.kind, self.most = encode, kind, most
        self._keep(pa.array([], pa.binary()), np.empty(0, kind), np.empty(0, np.int64))

    def _keep(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.pieces, self.ids, self.sizes = pieces, ids, sizes

    def find(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ids in a row, their sizes, and the number of the run of each of some distinct pieces."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
        at[new] = len(self.pieces) + np.arange(len(new))
        todo = pieces.take(pa.array(new))
        ids, sizes = self.encode(todo)
        ids, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        known = pa.concat_arrays([self.pieces, todo])
        if known.nbytes + ids.nbytes + sizes.nbytes <= self.most:
            self._keep(known, ids, sizes)
        else:  # start anew with what this batch holds, if that isn't too much
            some, ends = gathered(ids, sizes, at)
            if pieces.nbytes + some.nbytes + ends.nbytes <= self.most:
                self._keep(pieces, some, np.diff(ends))
            else:
                self._keep(pieces.slice(0, 0), some[:0], sizes[:0])
        return ids, sizes, at

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each begin (one more at the end)."""
        pieces, first = cut(texts)
        coded = pieces.dictionary_encode()
        ids, sizes, at = self.find(coded.dictionary)
        found, ends = gathered(ids, sizes, at[coded.indices.to_numpy(zero_copy_only=False)])
        return found, ends[first]


def joinable(pieces: pa.Array) -> np.ndarray:
    """Which pieces begin with one space and end without white space: between two of these every pre-tokenizer cuts."""
    raw, sizes = np.frombuffer(content(pieces), np.uint8), lengths(pieces)
    white, ends = _white(raw), np.cumsum(sizes)
    begin = ends - sizes
    return (sizes > 1) & (raw[begin] == 32) & ~white[np.minimum(begin + 1, len(raw) - 1)] & ~white[ends - 1]


def packed_rows(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each text's ids as bytes, from `PieceCache.texts`."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(ids).tobytes())])


def byte_letters() -> dict[str, int]:
    """Fixed values, the published alphabet of the vocabulary files: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, content: bytes) -> None:
        import regex

        spec = json.loads(content)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()], default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.base = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.size = np.int64(size)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        codes = left * self.size + right
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.pairs = dict(zip(codes.tolist(), range(len(codes)), strict=True))
        self.split = regex.compile(PATTERN)
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.tokens = pa.array(self.bytes_of, pa.large_binary())
        self.cache = PieceCache(self.encode_pieces, "<u4")

    # -- merging ------------------------------------------------------------------------------

    def _values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of pairs: rank and position, or _NONE."""
        if not len(self.codes):
            return np.full(left.shape, _NONE)
        code = left * self.size + right
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[i] == code) & (left >= 0) & (right >= 0), (self.ranks[i] << _SHIFT) | at, _NONE)

    def merge_beside(self, raw: np.ndarray, sizes: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge words of 2 to leaves + 1 bytes, given in a row; leaves is a power of two. Returns all ids and the ids in each word."""
        n, null = len(sizes), leaves + 1
        rows = np.repeat(np.arange(n), sizes)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol = np.full((n, leaves + 2), -1, np.int64)
        symbol[rows, cols] = self.base[raw]
        after = np.tile(np.arange(1, leaves + 3), (n, 1))
        after[np.arange(n), sizes - 1] = null
        before = np.tile(np.arange(-1, leaves + 1), (n, 1))
        before[:, 0] = null
        tree = np.full((n, 2 * leaves), _NONE)
        tree[:, leaves:] = self._values(symbol[:, :leaves], symbol[:, 1 : leaves + 1], np.arange(leaves)[None, :])
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = leaf + leaves
            tree[row, node] = value
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.arange(n)
        while True:
            root = tree[row, 1]
            more = root < _NONE
            row, root = row[more], root[more]
            if not len(row):
                break
            at, new = root & ((1 << _SHIFT) - 1), self.merged[root >> _SHIFT]
            gone = after[row, at]
            follow, lead = after[row, gone], before[row, at]
            symbol[row, at], symbol[row, gone] = new, -1
            after[row, at] = follow
            before[row, follow] = at
            put(row, at, np.where(follow == null, _NONE, self._values(new, symbol[row, follow], at)))
            inner = gone < leaves
            put(row[inner], gone[inner], _NONE)
            inner = lead != null
            put(row[inner], lead[inner], self._values(symbol[row[inner], lead[inner]], new[inner], lead[inner]))
        left = symbol >= 0
        return symbol[left], left.sum(axis=1)

    def merge_alone(self, word: bytes) -> list[int]:
        """The same for one word of any length, on plain lists."""
        symbol = self.base[np.frombuffer(word, np.uint8)].tolist()
        n, size, none = len(symbol), int(self.size), 1 << 62
        leaves = 1 << max(0, (n - 2).bit_length())
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        value = lambda i, j: (self.pairs.get(symbol[i] * size + symbol[j], -1) + 1 << _SHIFT | i) if j < n else 0
        put = lambda i, j: v if (v := value(i, j)) >> _SHIFT else none
        for i in range(n - 1):
            tree[leaves + i] = put(i, i + 1)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def repair(i: int, v: int) -> None:
            i += leaves
            tree[i] = v
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                v = a if a < b else b
                if tree[i] == v:
                    return
                tree[i] = v

        while n > 1 and (root := tree[1]) < none:
            i = root & ((1 << _SHIFT) - 1)
            j = after[i]
            symbol[i] = int(self.merged[(root >> _SHIFT) - 1])
            symbol[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            if j < leaves:
                repair(j, none)
            repair(i, put(i, k))
            if before[i] >= 0:
                repair(before[i], put(before[i], i))
        return [s for s in symbol if s >= 0]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens in a row, and how many each has."""
        sizes, out = lengths(words), []
        one = np.flatnonzero(sizes == 1)
        if len(one):
            out.append((one, self.base[np.frombuffer(content(words.take(pa.array(one))), np.uint8)], np.ones(len(one), np.int64)))
        for i in np.flatnonzero(sizes > BESIDE).tolist():
            ids = self.merge_alone(words[i].as_py())
            out.append((np.array([i]), np.array(ids, np.int64), np.array([len(ids)])))
        beside = np.flatnonzero((sizes > 1) & (sizes <= BESIDE))
        leaves = 1 << np.ceil(np.log2(np.maximum(sizes[beside] - 1, 1))).astype(np.int64)
        for size in np.unique(leaves).tolist():
            members = beside[leaves == size]
            for start in range(0, len(members), BESIDE_WORDS):
                part = members[start : start + BESIDE_WORDS]
                out.append((part, *self.merge_beside(np.frombuffer(content(words.take(pa.array(part))), np.uint8), sizes[part], size)))
        return in_order(len(words), out, "<u4")

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces in a row, and how many each has.

        Pieces that can stand side by side are split into pre-tokens as one text, the others and those with a special token alone.
        """
        if not len(pieces):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        beside = joinable(pieces)
        text = content(pieces.filter(pa.array(beside))).decode()
        if self.split_special and self.split_special.search(text):
            beside &= ~pc.match_substring_regex(pieces.cast(pa.string()), "|".join(re.escape(x) for x in self.special)).to_numpy(zero_copy_only=False)
            text = content(pieces.filter(pa.array(beside))).decode()
        words = self.split.findall(text)
        ends = np.cumsum(lengths(pa.array(words, pa.string())))
        number, counts = np.flatnonzero(beside), np.zeros(len(pieces), np.int64)
        counts[number] = np.diff(np.searchsorted(ends, np.cumsum(lengths(pieces)[number]), side="left") + 1, prepend=0)
        alone: dict[int, list[str | int]] = {}
        for i in np.flatnonzero(~beside).tolist():
            part: list[str | int] = []
            piece = pieces[i].as_py().decode()
            for k, run in enumerate(self.split_special.split(piece) if self.split_special else [piece]):
                part += [self.special[run]] if k % 2 else self.split.findall(run)
            alone[i], counts[i] = part, len(part)
        others = [w for part in alone.values() for w in part]
        coded = pa.array([*words, *("" if isinstance(w, int) else w for w in others)], pa.string()).dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary())
        ids, n = self.encode_words(distinct)
        at = coded.indices.to_numpy(zero_copy_only=False)
        if any(isinstance(w, int) for w in others):  # special tokens are words of one id
            known = {i: k for k, i in enumerate(self.special.values())}
            at = at.copy()
            for k, w in enumerate(others, len(words)):
                at[k] = len(distinct) + known[w] if isinstance(w, int) else at[k]
            ids, n = np.append(ids, np.array(list(known), np.uint32)), np.append(n, np.ones(len(known), np.int64))
        # words stand in the order of the joined pieces, then of the others: bring them into the order of the pieces
        order = np.concatenate([number, np.array(list(alone), np.int64)])
        per = counts[order]
        begin = np.empty(len(pieces), np.int64)
        begin[order] = np.cumsum(per) - per
        found, bounds = gathered(ids, n, at[np.arange(int(counts.sum())) + np.repeat(begin - (np.cumsum(counts) - counts), counts)])
        return found, np.diff(bounds[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each begin (one more at the end)."""
        return self.cache.texts(texts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each run of ids; what isn't UTF-8 is replaced, as the library does."""
        joined = self.tokens.take(pa.array(np.minimum(ids, len(self.bytes_of) - 1) if len(ids) else ids))
        sizes = np.diff(np.frombuffer(joined.buffers()[1], np.int64)[: len(ids) + 1]) if len(ids) else np.empty(0, np.int64)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ends, data = total[bounds], joined.buffers()[2] if len(ids) else None
        whole = data.slice(0, int(total[-1])).to_pybytes() if data is not None else b""
        raw = np.frombuffer(whole, np.uint8)
        try:
            whole.decode()
            apart = not len(raw) or not ((raw[np.minimum(ends[:-1], len(raw) - 1)] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            apart = False
        if apart and int(ids.max(initial=0)) < len(self.bytes_of) and ends[-1] < 1 << 31:
            return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(whole)])
        known, n = self.bytes_of, len(self.bytes_of)
        return pa.array([b"".join([known[i] for i in ids[a:b].tolist() if i < n]).decode("utf-8", "replace") for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], pa.string())


def load(spark: SparkSession, path: str):
    """A vocabulary file as a broadcast of checked size; the driver reads it, so executors need no file."""
    content = Path(path).read_bytes()
    if len(content) > MAX_BROADCAST_BYTES:
        raise ValueError(f"{path}: a vocabulary file of {len(content)} bytes is too large to broadcast")
    return spark.sparkContext.broadcast(content)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """Add the ids of every text (packed little-endian unsigned 32-bit) and their number; map-only."""
    shared = load(df.sparkSession, path)

    def make():
        model = worker_model("bpe", shared.value, Bpe)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found, bounds = model.encode(batch.column(text))
            return [pa.array(np.diff(bounds)), packed_rows(found, bounds)]

        return work

    return add_columns(df, text, [(count, "bigint"), (ids, "binary")], make, ENCODE_BYTES, models=True)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of packed ids, special tokens kept; null ids give an empty text; map-only."""
    shared = load(df.sparkSession, path)

    def make():
        model = worker_model("bpe", shared.value, Bpe)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            packed = [x or b"" for x in batch.column(ids).to_pylist()]
            return [model.decode(np.frombuffer(b"".join(packed), "<u4"), np.cumsum([0, *(len(x) // 4 for x in packed)]))]

        return work

    return add_columns(df, ids, [(text, "string")], make, ENCODE_BYTES, models=True)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`encode` and then `decode`, in one pass through Python."""
    shared = load(df.sparkSession, path)

    def make():
        model = worker_model("bpe", shared.value, Bpe)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found, bounds = model.encode(batch.column(text))
            return [pa.array(np.diff(bounds)), packed_rows(found, bounds), model.decode(found, bounds)]

        return work

    return add_columns(df, text, [("n_tokens", "bigint"), ("ids", "binary"), ("decoded", "string")], make, ENCODE_BYTES, models=True)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    coded = round_trip(docs.select("doc_id", "text"), path).drop("text")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: ids and decoded text of every document, as digests."""
    return round_trip_digests(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
