"""Quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A text is compressed whole with each; by how
many bytes one result is shorter than the other says which kind it resembles. This difference is normalised by the larger result and
by the text's own length, and a logistic curve, fitted on labelled texts that the dictionaries haven't seen, turns it into a calibrated
score from 0 to 1; the text's length only decides how much a difference counts. A score uses nothing else of a text.

The fit takes a bounded sample of labelled rows (SAMPLE rows of each label, those of smallest hash,
of at most SAMPLE_BYTES bytes each); everything is scored. Scores depend on the text alone.

Defined results: null and empty texts get the share of good labels as score. Labels other than 0
and 1, and labels without a document, are left out. A label row that is repeated counts once in the sample, and as often as it stands in the
share of good labels; a doc_id with both labels is in both samples. With one kind of label only, or none, every text gets the smoothed share of
good labels. Texts of any length are scored whole; equal texts get equal scores. An empty table gives no rows. `score` replaces a column of its
output's name (in any case); `keep_good` adds none, so it gives back all columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweir.llm.common import add_columns, discard, lean, read_table, slices, stored, texts_of

SAMPLE, SAMPLE_BYTES = 4000, 16_384
DICTIONARY_BYTES, LEVEL = 262_144, 7
#: From which score a text is predicted good; from which the corpus filter keeps it.
PREDICT, KEEP = 0.7, 0.3


@dataclass
class QualityModel:
    """Dictionaries and curve; small, so that it goes to the tasks with the function."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    base: float


class Scorer:
    def __init__(self, model: QualityModel) -> None:
        self.model = model
        if len(model.weights):
            self.pair = [self._compressor(d) for d in (model.good, model.bad)]

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The difference in its two normalisations, each as it is and times the length's logarithm, and that."""
        n = np.array([len(t) for t in texts], float)
        g, b = (np.array([len(c.compress(t)) for t in texts], float) for c in self.pair)
        size, by_result, by_text = np.log(n + 1) / 5, np.clip(10 * (b - g) / np.maximum(g, b), -5, 5), np.clip(20 * (b - g) / (n + 1), -5, 5)
        return np.stack([np.ones(len(n)), by_result, by_text, by_result * size, by_text * size, size], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts or not len(self.model.weights):
            return np.full(len(texts), self.model.base)
        z = np.clip(self.features(texts) @ self.model.weights, -30, 30)
        return np.where([len(t) == 0 for t in texts], self.model.base, 1 / (1 + np.exp(-z)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _first_rows(rows: DataFrame, sample: int) -> list[tuple]:
    """The first distinct rows (place, doc_id, hash) by place, a uniform hash; only a cut around them reaches the driver."""
    share = 1.25 * sample / max(rows.count(), 1)
    while True:
        cut = min(int(share * 2**64) - 2**63, 2**63 - 1)
        found = rows.where(F.col("place") <= cut).distinct().orderBy("place", "doc_id", "hash").limit(sample).collect()
        if len(found) >= sample or share >= 1:
            return [tuple(r) for r in found]
        share *= 4


def _sample(docs: DataFrame, known: DataFrame, sample: int) -> dict[int, list[bytes]]:
    """At most `sample` short texts of each label, in an order of their own; repeated rows count once.

    Ids and hashes are joined with the labels, and only what is chosen of them is fetched as text.
    """
    hashed = docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text"))
    short = hashed.where(F.octet_length("text").between(1, SAMPLE_BYTES))
    place = F.xxhash64("doc_id", F.lit(17)).alias("place")
    rows = stored(short.select("doc_id", "hash").join(known, "doc_id").select(place, "doc_id", "hash", "quality"), "labelled")
    chosen = {label: _first_rows(rows.where(F.col("quality") == label).drop("quality"), sample) for label in (1, 0)}
    ids = docs.sparkSession.createDataFrame(list({r[1:] for x in chosen.values() for r in x}), rows.select("doc_id", "hash").schema)  # 2 * sample rows at most
    texts = short.join(F.broadcast(ids), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).collect()
    discard(rows)
    by_id = {(r["doc_id"], r["hash"]): r["text"].encode() for r in texts}
    return {label: [by_id[r[1:]] for r in x] for label, x in chosen.items()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learn from labelled rows that aren't held out; the driver gets a bounded sample of them."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    parts = _sample(docs, known, sample)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    base = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    half = {k: (v[::2], v[1::2]) for k, v in parts.items()}
    pair = [b"\n".join(half[k][0])[-DICTIONARY_BYTES:] for k in (1, 0)]  # what both dictionaries hold is text as it stands
    if not all(half[k][1] and half[k][0] for k in (0, 1)) or min(map(len, pair)) < 8:
        return QualityModel(b"", b"", np.empty(0), base)
    model = QualityModel(*pair, np.empty(0), base)
    learn = Scorer(QualityModel(*pair, np.ones(1), base))
    x = np.concatenate([learn.features(half[k][1]) for k in (1, 0)])
    y = np.repeat([1.0, 0.0], [len(half[1][1]), len(half[0][1])])
    weight = np.repeat([base / len(half[1][1]), (1 - base) / len(half[0][1])], [len(half[1][1]), len(half[0][1])]) * len(y)
    model.weights = _logistic(x, y, weight)
    return model


def _packed(model: QualityModel) -> bytes:
    """A model goes to every task with the function; its size is that of two dictionaries."""
    assert len(model.good) + len(model.bad) <= 2 * DICTIONARY_BYTES
    return pickle.dumps(model)


def score(df: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every whole text; map-only."""
    packed = _packed(model)

    def make():
        scorer = Scorer(pickle.loads(packed))
        return lambda batch: [pa.array(scorer.scores([t or b"" for t in texts_of(batch.column(text))]), pa.float64())]

    return add_columns(df, text, [(name, "double")], make)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP, text: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns, whatever their names."""
    packed = _packed(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(packed))
        for batch in batches:
            for b in slices(batch, text):
                good = scorer.scores([t or b"" for t in texts_of(b.column(text))]) >= threshold
                if good.any():
                    yield b.filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
