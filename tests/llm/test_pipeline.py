"""The pipeline's rows, stage by stage, against brute force."""

import hashlib
import random
import re

import corpus_pipeline
from mailweir.llm import bpe, quality

from .test_jaccard import brute

WINDOW = 10


def words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def leaked(text, items):
    """Whether a window of an item stands in a text."""
    have = words(text)
    for item in items:
        w = words(item)
        n = min(len(w), WINDOW)
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        if any(tuple(have[i : i + n]) in windows for i in range(len(have) - n + 1)):
            return True
    return False


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"plain{rng.randrange(97)} prose{rng.randrange(89)}" for _ in range(n))
    junk = lambda: "### " * 20 + " *** ".join(f"buy{rng.randrange(30)} now{rng.randrange(30)}" for _ in range(20))
    items = [prose(8), "Two words", None, ""]
    texts = [prose(40) if i % 2 else junk() for i in range(240)]
    for i in range(1, 60, 6):  # exact and near copies, and benchmark passages
        texts += [texts[i], texts[i] + " one more", prose(15) + ", " + items[0].upper() + ". " + prose(15), prose(30) + " two WORDS " + prose(10)]
    texts += [None, "", "  "]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(20), None, None, None)]
    labels = [(i, i % 2, 0) for i in range(240)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    good = [(r[0], r[1]) for r in rows if scores[r[0], r[1]] >= quality.KEEP]
    assert 120 < len(good) < len(rows)
    alone = {i for i, _, least in brute(good) if i == least}
    unlike = [r for r in good if r[0] in alone]
    clean = [r for r in unlike if not leaked(r[1], items)]
    assert len(clean) < len(unlike) < len(good)

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    want = [(i, len(model.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in clean]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
