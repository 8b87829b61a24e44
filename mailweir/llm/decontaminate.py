"""Benchmark decontamination with a distributed positional inverted index.

The index is a table in the shared folder, dealt out by blocks of training texts. A block's row has its distinct terms, how
often each stands in it, and the positions of each term's tokens; also the rows of the texts themselves (or what is kept of them), so
that a search needs no join. Texts are read once; searching reads the index only, and counting terms only its terms and counts.

Phrases: a window of a benchmark item starts from the posting list of its rarest term in the whole corpus, moved back by the term's offset in
the window. Next comes, for all windows that agree so far, the offset whose terms are rarest; a start goes on with those windows whose term
has it in its list at that offset. So windows that share terms are searched together, and a start never meets a list of windows one by
one. Proximity: from the rarest term of a window, every other term of it must stand within a distance, in the same text.

Words are `[0-9a-z]` and all non-ASCII bytes, after A-Z is lower-cased; terms are compared byte for byte. Items come in parts of bounded size,
each a broadcast; a part's windows are laid out in arrays on the driver. No key is hot: a term's list is cut by blocks.

Defined results: null and empty texts have no words and no hits. Items without words are found nowhere; items shorter than a window are
one window. Rows of the benchmark that share an item_id are one item. Null item_ids and texts are left out. Item ids may be of any
simple type. A text of any length is a block of its own or part of one. An empty table of documents or items gives no hits. Repeated documents each get
their hits. `find_hits` replaces columns named like an output (in any case); `keep_clean` adds none, so it gives back all columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mailweir.llm.bpe import gathered
from mailweir.llm.common import discard, lean, read_table, slices, stored

WINDOW, WITHIN = 10, 20
#: Bytes of benchmark text that are searched for at a time.
PART_BYTES = 4 << 20
#: Bytes of text in a block of the index, if no text has more, and starts of phrases that are followed at a time.
BLOCK_BYTES, STARTS = 4 << 20, 1 << 19

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the number of each text's first one (one more at the end)."""
    array = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    word = _WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = bounds[:-1][np.diff(bounds) > 0]
    first[starts] = word[starts]  # texts are apart
    begin = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(word)])
    ends = np.append(kept[begin], kept[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(_LOWER[raw[word]].tobytes())]), np.searchsorted(begin, bounds)


_INDEX = "block bigint, terms binary, counts binary, positions binary, firsts binary, rows binary"


def build_index(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The stored index: for each block of texts its terms (between line ends), counts, positions, first word of each text, and the rows.

    `keep` names the columns of the rows that the index keeps (by default all).
    """
    names = docs.columns if keep is None else keep
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in slices(batch, text, BLOCK_BYTES):
                words, first = tokens(b.column(text))
                coded = words.dictionary_encode()
                at = coded.indices.to_numpy(zero_copy_only=False)
                counts = np.bincount(at, minlength=len(coded.dictionary)).astype("<u4")
                sink = pa.BufferOutputStream()
                kept = b.select(names)
                with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                    out.write_batch(kept)
                terms = b"\n".join(coded.dictionary.to_pylist())
                columns = (terms, counts.tobytes(), np.argsort(at, kind="stable").astype("<u4").tobytes(), first.astype("<u4").tobytes(), sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["block", "terms", "counts", "positions", "firsts", "rows"])
                number += 1

    return stored(docs.mapInArrow(lean(run), _INDEX), "postings", BLOCK_BYTES)


class Part:
    """Some benchmark items: their distinct terms, and the windows of a size as rows of term numbers, by length."""

    def __init__(self, items: list[tuple[object, bytes]], size: int) -> None:
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        words, first = tokens(pa.array([t for _, t in items], pa.binary()))
        coded = words.dictionary_encode()
        self.terms, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for (item, _), i, j in zip(items, first.tolist(), first[1:].tolist(), strict=False):
            n = min(j - i, size)
            if n:
                windows = at[i:j][np.arange(j - i - n + 1)[:, None] + np.arange(n)]
                found.setdefault(n, []).append((windows, place[item]))
        self.windows: dict[int, np.ndarray] = {}
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each window: item numbers in a row, how many
        for n, runs in found.items():
            windows, number = np.unique(np.concatenate([w for w, _ in runs]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([number.ravel(), np.repeat([i for _, i in runs], [len(w) for w, _ in runs])], 1), axis=0)
            self.windows[n], self.items[n] = windows, (pairs[:, 1], np.bincount(pairs[:, 0], minlength=len(windows)))

    def order(self, counts: np.ndarray) -> None:
        """Lay out the search of each length's windows: roots (term, offset), and for every further turn each node's offset and its branches."""
        self.plans, self.size = {}, len(self.terms)
        for n, windows in self.windows.items():
            rows = np.arange(len(windows))
            left = np.ones((len(windows), n), bool)
            offset = np.argmin(counts[windows], axis=1)  # the rarest term, the first of these
            root, node = np.unique(np.stack([windows[rows, offset], offset], 1), axis=0, return_inverse=True)
            node, turns = node.ravel(), []
            left[rows, offset] = False
            for _ in range(n - 1):
                nodes = int(node.max()) + 1
                cost = np.zeros((nodes, n))
                np.add.at(cost, node, np.where(left, counts[windows] + 1.0, np.inf))
                choice = np.argmin(cost, axis=1)
                left[rows, choice[node]] = False
                branches, node = np.unique(node * (self.size + 1) + windows[rows, choice[node]], return_inverse=True)
                turns.append((choice, branches))
            window = np.empty(len(windows), np.int64)
            window[node] = rows
            self.plans[n] = (root, turns, window)
        # a window's terms as sets, rarest first (then by their bytes), for proximity; equal sets are one
        place = np.empty(self.size, np.int64)
        place[np.argsort(np.array(self.terms.to_pylist(), object), kind="stable")] = np.arange(self.size)
        key = list(zip(counts.tolist(), place.tolist(), strict=True))
        sets: dict[tuple[int, ...], set[int]] = {}
        for n, windows in self.windows.items():
            ids, many = self.items[n]
            ends = np.cumsum(many).tolist()
            for row, i, j in zip(windows.tolist(), [0, *ends], ends, strict=False):
                sets.setdefault(tuple(sorted(set(row), key=key.__getitem__)), set()).update(ids[i:j].tolist())
        self.near_sets = list(sets)
        self.near_items = [sorted(x) for x in sets.values()]


class Block:
    """The posting lists of a part's terms in one block of the index."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, firsts: bytes, part: Part) -> None:
        self.first = np.frombuffer(firsts, "<u4").astype(np.int64)
        mine = pc.index_in(pa.array(terms.split(b"\n") if len(counts) else [], pa.binary()), value_set=part.terms)
        known = np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False))
        of = mine.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(of)
        at, ends = gathered(np.frombuffer(positions, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64), known[order])
        self.lists, each = at.astype(np.int64), np.diff(ends)
        self.count = np.zeros(part.size, np.int64)
        self.count[of[order]] = each
        self.begin = np.cumsum(self.count) - self.count
        self.codes = np.repeat(np.arange(part.size), self.count) << 32 | self.lists  # (term, position), in order
        self.term = np.full(int(self.first[-1]) if len(self.first) else 0, part.size, np.int32)  # the lists, addressed by position
        self.term[self.lists] = np.repeat(np.arange(part.size), self.count)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def phrases(self, part: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, starts and window numbers of every occurrence."""
        for n, (root, turns, window) in part.plans.items():
            many = self.count[root[:, 0]]
            some = np.flatnonzero(many)
            cut = np.flatnonzero(np.diff(np.cumsum(many[some]) // STARTS, prepend=0)).tolist()
            for i, j in zip([0, *cut], [*cut, len(some)], strict=True):
                roots = some[i:j]
                if not len(roots):
                    continue
                size = many[roots]
                at = self.lists[np.arange(size.sum()) + np.repeat(self.begin[root[roots, 0]] - (np.cumsum(size) - size), size)]
                for k in range(0, len(at), STARTS):  # one list may be long
                    node = np.repeat(roots, size)[k : k + STARTS]
                    start = at[k : k + STARTS] - root[node, 1]
                    good = start >= 0
                    good[good] = start[good] + n <= self.first[self.text_of(at[k : k + STARTS][good]) + 1]
                    good[good] = start[good] >= self.first[self.text_of(at[k : k + STARTS][good])]
                    start, node = start[good], node[good]
                    for choice, branches in turns:
                        if not len(start):
                            break
                        code = node * (part.size + 1) + self.term[start + choice[node]]
                        to = np.minimum(np.searchsorted(branches, code), len(branches) - 1)
                        on = branches[to] == code
                        start, node = start[on], to[on]
                    if len(start):
                        yield n, start, window[node]

    def near(self, part: Part, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of term sets and the positions of their rarest term which have every other term of the set near, in the same text."""
        if not part.near_sets:
            return
        sizes = np.array([len(s) for s in part.near_sets])
        wide = np.full((len(sizes), int(sizes.max())), -1, np.int64)
        for k, s in enumerate(part.near_sets):
            wide[k, : len(s)] = s
        some = np.flatnonzero(((self.count[wide] > 0) | (wide < 0)).all(axis=1))  # all terms stand in the block
        many = self.count[wide[some, 0]]
        cut = np.flatnonzero(np.diff(np.cumsum(many) // STARTS, prepend=0)).tolist()
        for i, j in zip([0, *cut], [*cut, len(some)], strict=True):
            sets, size = some[i:j], many[i:j]
            if not len(sets):
                continue
            all_at = self.lists[np.arange(size.sum()) + np.repeat(self.begin[wide[sets, 0]] - (np.cumsum(size) - size), size)]
            all_sets = np.repeat(sets, size)
            for k in range(0, len(all_at), STARTS):
                at, of = all_at[k : k + STARTS], all_sets[k : k + STARTS]
                text = self.text_of(at)
                low, high = np.maximum(at - within, self.first[text]), np.minimum(at + within, self.first[text + 1] - 1)
                for turn in range(1, wide.shape[1]):
                    term = wide[of, turn]
                    to = np.searchsorted(self.codes, term << 32 | low)
                    on = (term < 0) | (self.codes[np.minimum(to, len(self.codes) - 1)] <= (term << 32 | high)) & (to < len(self.codes))
                    at, of, low, high = at[on], of[on], low[on], high[on]
                if len(at):
                    yield of, at


def item_parts(benchmark: DataFrame, item: str, text: str, most: int = PART_BYTES) -> Iterator[list[tuple[object, bytes]]]:
    """Items in parts of bounded size, in the order of their ids."""
    part: list[tuple[object, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for r in rows.orderBy("i", "t").toLocalIterator():
        data = r["t"].encode()
        if part and size + len(data) > most:
            yield part
            part, size = [], 0
        part.append((r["i"], data))
        size += len(data)
    if part:
        yield part


def term_counts(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """How often each term stands in the whole corpus; reads terms and counts of the index, and a count a term comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for blob, counts in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist(), strict=True):
                found = pc.index_in(pa.array(blob.split(b"\n") if counts else [], pa.binary()), value_set=terms)
                known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                total[found.take(pa.array(known)).to_numpy(zero_copy_only=False)] += np.frombuffer(counts, "<u4")[known]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["term", "n"])

    counts = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(lean(run), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    return counts


def _found(block: Block, part: Part, within: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marks of the words in occurrences; (text, item) pairs of these; (text, item) pairs and places of near matches."""
    edge = np.zeros(len(block.term) + 1, np.int32)
    pairs, near = [np.empty((0, 2), np.int64)], [np.empty((0, 3), np.int64)]
    for n, start, window in block.phrases(part):
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n, -1)
        ids, many = part.items[n]
        item, _ = gathered(ids, many, window)
        pairs.append(np.unique(np.stack([np.repeat(block.text_of(start), many[window]), item], 1), axis=0))
    if within is not None:
        many = np.array([len(x) for x in part.near_items], np.int64)
        flat = np.array([i for x in part.near_items for i in x], np.int64)
        for of, at in block.near(part, within):
            item, _ = gathered(flat, many, of)
            near.append(np.unique(np.stack([np.repeat(block.text_of(at), many[of]), item, np.repeat(at, many[of])], 1), axis=0))
    places = np.unique(np.concatenate(near), axis=0)
    return np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0), places[:, :2], places[:, 2]


_HITS = [("n_words", "bigint"), ("hits", "array<array<bigint>>"), ("items", "array<{}>"), ("near_items", "array<{}>"), ("near_places", "array<bigint>")]


class _Search:
    """All parts of a benchmark, laid out and broadcast, and the search of one block."""

    def __init__(self, index: DataFrame, benchmark: DataFrame, item: str, item_text: str, size: int, within: int | None) -> None:
        self.within, self.parts = within, []
        context = index.sparkSession.sparkContext
        for items in item_parts(benchmark, item, item_text):
            part = Part(items, size)
            if len(part.terms):
                part.order(term_counts(index, part.terms))
                self.parts.append(context.broadcast(pickle.dumps(part)))  # of at most PART_BYTES of text

    def opened(self) -> Iterator[Part]:
        """The parts, one in memory at a time; a single one stays."""
        if len(self.parts) == 1:
            if not hasattr(self, "only"):
                self.only = pickle.loads(self.parts[0].value)
            yield self.only
        else:
            for p in self.parts:
                yield pickle.loads(p.value)

    def block(self, terms: bytes, counts: bytes, positions: bytes, firsts: bytes) -> list[tuple]:
        """(words, hits, items, near items, near places) of each text."""
        first = np.frombuffer(firsts, "<u4").astype(np.int64)
        n = len(first) - 1
        marks = np.zeros(int(first[-1]), bool)
        items: list[set] = [set() for _ in range(n)]
        near: list[dict] = [{} for _ in range(n)]
        for part in self.opened():
            found, pairs, places, _ = _found(Block(terms, counts, positions, firsts, part), part, self.within)
            marks |= found
            for text, i in pairs.tolist():
                items[text].add(part.ids[i])
            for (text, i), many in zip(*(x.tolist() for x in np.unique(places, axis=0, return_counts=True)), strict=True):
                near[text][part.ids[i]] = near[text].get(part.ids[i], 0) + many
        edge = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        cuts = np.setdiff1d(first[:-1][np.diff(first) > 0], begin)  # a run that goes on in the next text is two
        inside = cuts[marks[cuts]]
        begin, end = np.sort(np.concatenate([begin, inside])), np.sort(np.concatenate([end, inside]))
        text = np.searchsorted(first, begin, side="right") - 1
        spans: list[list[list[int]]] = [[] for _ in range(n)]
        for t, a, b in zip(text.tolist(), (begin - first[text]).tolist(), (end - first[text]).tolist(), strict=True):
            spans[t].append([a, b])
        return [(int(w), spans[t], sorted(items[t]), sorted(near[t]), [near[t][i] for i in sorted(near[t])]) for t, w in enumerate(np.diff(first).tolist())]


def _searched(index: DataFrame, search: _Search, rows: T.StructType, names: list[str], made: list[tuple[str, str]], emit) -> DataFrame:
    """What `emit` makes of the kept rows of a block and of its texts' findings."""
    schema = T.StructType([*(rows[n] for n in names), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, counts, positions, firsts, blob in zip(*(b.column(c).to_pylist() for c in ("terms", "counts", "positions", "firsts", "rows")), strict=True):
                found = search.block(terms, counts, positions, firsts)
                yield from emit(pa.ipc.open_stream(blob).read_next_batch(), found)

    return index.mapInArrow(lean(run), schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, within: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every row (its columns, or those that `keep` names) with n_words, hits (merged [begin, end) word ranges) and items (sorted ids).

    With `within` also near_items (sorted ids of items of which a window has all its terms so near to its rarest one) and near_places (how many
    positions of rarest terms that are). One pass over the texts, one over the index, and one for the counts of each part of the benchmark.
    """
    id_type = benchmark.schema[item].dataType.simpleString()
    made = [(n, t.format(id_type)) for n, t in (_HITS if within is not None else _HITS[:3])]
    taken = {n for n, _ in made}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    rows = docs.select(*(F.col(f"`{c}`") for c in names)).schema
    index = build_index(docs, text, names)
    search = _Search(index, benchmark, item, item_text, size, within)
    arrow = to_arrow_schema(T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in made]))

    def emit(batch: pa.RecordBatch, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = [pa.array([f[k] for f in found], arrow.field(k).type) for k in range(len(made))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *(n for n, _ in made)])

    return _searched(index, search, rows, names, made, emit)


def near_matches(docs: DataFrame, benchmark: DataFrame, within: int = WITHIN, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id and places: for each document and item, at how many positions a window's rarest term has all terms of the window within a distance.

    A window is a run of WINDOW words of the item, or of within + 1 if that is less, so that a copy always is a match.
    """
    found = find_hits(docs, benchmark, text, item, item_text, min(WINDOW, within + 1), within, ["doc_id"])
    return found.select("doc_id", F.explode(F.arrays_zip("near_items", "near_places")).alias("m")).select("doc_id", F.col("m.near_items").alias("item_id"), F.col("m.near_places").alias("places"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what of every document stands in benchmark items; n_near counts the items with a near match."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, read_table(spark, sf_dir, "benchmark"), within=WITHIN, keep=["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x[1] - x[0])
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near_items").cast("bigint").alias("n_near"))


ORACLE_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS word),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), word) AS ws FROM documents, low),
i AS (SELECT item_id, regexp_extract_all(translate(text, u, l), word) AS ws FROM benchmark, low WHERE item_id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w FROM d),
win AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: ws[k:k + n - 1])) AS win FROM (SELECT *, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: ws[k:k + n - 1])) AS win FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hits AS (SELECT doc_id, pos, n, item_id FROM dw JOIN win USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
sets AS (SELECT DISTINCT item_id, list_sort(list_distinct(win)) AS terms FROM win),
counted AS (SELECT w, count(*) AS c FROM t GROUP BY w),
rarest AS (SELECT item_id, terms, first(x ORDER BY coalesce(c, 0), x) AS rare FROM (SELECT item_id, terms, unnest(terms) AS x FROM sets) LEFT JOIN counted ON w = x GROUP BY item_id, terms),
near AS (SELECT r.item_id, t.doc_id, t.pos, r.terms, unnest(r.terms) AS x FROM rarest r JOIN t ON t.w = r.rare),
found AS (SELECT near.item_id, near.doc_id FROM near JOIN t ON t.doc_id = near.doc_id AND t.w = near.x AND abs(t.pos - near.pos) <= 20
  GROUP BY near.item_id, near.doc_id, near.pos, near.terms HAVING count(DISTINCT near.x) = len(near.terms)),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns, whatever their names."""
    index = build_index(docs, text)
    search = _Search(index, benchmark, item, item_text, WINDOW, None)

    def emit(batch: pa.RecordBatch, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        clean = batch.filter(pa.array([not f[1] for f in found], pa.bool_()))
        if len(clean):
            yield clean

    clean = stored(_searched(index, search, docs.schema, docs.columns, [], emit), "clean", BLOCK_BYTES)  # here, as a block with its texts has some MB
    discard(index)
    return clean

