"""Nulls, empty and odd texts, repeated rows, empty tables and clashing columns, for the operators on rows."""

import zlib

import numpy as np
import pytest

from mailweir.llm import bpe, quality, sharding, tokenids, topk, urls, wordpiece
from mailweir.llm.common import fresh_path

PATH = bpe.vocabulary("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b\n\nc", "x<|endoftext|>y", "word " * 3000, "é" * 500, "don't stop", "don't stop", "a" * 3000]
ROWS = [(i if i != 3 else None, t, "clash") for i, t in enumerate(TEXTS)] + [(8, "don't stop", "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, SIZE string")


def test_bpe_matches_the_library(spark, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["decoded"] == (r["text"] or "") and r["SIZE"] == "clash"
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_token_files(spark, docs):
    out = fresh_path(spark, "test")
    tokenids.write_ids(docs, PATH, out, shards=3)
    got = sorted(map(tuple, tokenids.read_documents(spark, out).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 0, 1, 2, 4, 5, 6, 7, 8, 8, 9] and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert got[1][2:] == (1, zlib.crc32(bytes(4)))
    keys = spark.createDataFrame([(5,), (77,), (None,), (8,)], "doc_id bigint")
    found = {r["doc_id"]: len(r["ids"]) // 4 for r in tokenids.lookup(spark, out, keys).collect()}
    assert found == {5: got[5][2], 8: got[8][2]}


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 7, 126, 1000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
        seed, displace, slot = tokenids.build_hash(keys)
        assert sorted(slot.tolist()) == list(range(n))
        assert (tokenids._slots(keys, seed, displace, n)[0] == slot).all() if n else True


def test_longest_match_counts(spark, docs):
    begins, continues = wordpiece.pieces_of_byte_bpe(open(PATH, "rb").read())

    def greedy(word):
        n = i = 0
        while i < len(word):
            some = begins if i == 0 else continues
            end = next((j for j in range(len(word), i, -1) if word[i:j] in some), None)
            if end is None:
                return 0
            n, i = n + 1, end
        return n

    for r in wordpiece.token_counts(docs, PATH).collect():
        counts = [greedy(w) for w in (r["text"] or "").encode().split()]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(counts) + counts.count(0), counts.count(0))


def test_urls(spark):
    cases = {None: (None, "allow"), "": (None, "allow"), "no scheme.org/": (None, "allow"), "http://ORG/a?b": ("org/", "allow"), "http://x.example.org/es/": ("example.org/es/", "block"),
             "http://myexample.org/es/1": ("org/", "allow"), "http://a.com/de/x": ("com/de/", "block"), "http://a.com/d/": (None, "allow"), "http://example.org/en/12#x": ("example.org/en/1", "block")}
    df = spark.createDataFrame([(u, 1) for u in cases] * 2, "url string, rule int")
    got = urls.judge_urls(df, urls.RULES).collect()
    assert len(got) == 2 * len(cases) and {r["url"]: (r["rule"], r["verdict"]) for r in got} == cases
    assert {r["verdict"] for r in urls.judge_urls(df, [], default="block").collect()} == {"block"}


def test_shards(spark, docs):
    got = sharding.histogram_sort(docs, shards=3).collect()
    assert len(got) == len(ROWS)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one hot text that many rows hold', concat('text ', id)) as text")
    sizes = [r["b"] for r in sharding.histogram_sort(hot, shards=7).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 7 and max(sizes) <= 1.03 * min(sizes)
    assert sharding.histogram_sort(hot.limit(0), shards=3).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(300 + i, [1.0] * 6) for i in range(90)]
    vectors += [(900, None), (950, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1000, [float("nan")] * 6), (None, [2.0] * 6), (100, [1.0, 2.0]), (901, [])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    whole = topk.whole_numbers(df)
    got = topk.top_k(whole, whole.where("id % 50 = 0"), block_bytes=300).collect()
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vectors if i is not None and v is not None and None not in v and not any(map(np.isnan, v))]
    want = []
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-int(v @ w), c) for c, w in good if c != q and len(w) == len(v))[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_repeated_ids(spark, tmp_path):
    """Against the SQL: query ids repeated with equal and other vectors, and many rows of one id and vector."""
    import duckdb

    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    vectors += [(50, [4.0] * 4)] * 9 + [(i, [4.0] * 4) for i in (51, 52, 77, 77, 100, 150)]  # the query's id fills the smallest rows
    vectors += [(0, [5.0 + i] * 4) for i in range(9)] + [(100, vectors[100][1])] * 2 + [(200, [-3.0] * 4)] * 14 + [(201, [-3.0] * 4)] * 8
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = base.execute(topk.ORACLE_SQL).fetchall()
    assert len(want) == 25
    assert sorted(map(tuple, topk.op8_exact_top_k(spark, str(tmp_path)).collect())) == sorted(want)
    whole = topk.whole_numbers(df)
    assert sorted(map(tuple, topk.top_k(whole, whole.where("id % 50 = 0"), block_bytes=90).collect())) == sorted(want)


def test_top_k_of_empty_vectors(spark):
    some = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 1.0])]
    for empty, want in (([50], []), ([50, 51, 100, 7], [(50, 1, 7, 0), (50, 2, 51, 0), (50, 3, 100, 0), (100, 1, 7, 0), (100, 2, 50, 0), (100, 3, 51, 0)])):
        whole = topk.whole_numbers(spark.createDataFrame(some + [(i, []) for i in empty], "vec_id bigint, embedding array<float>"))
        got = topk.top_k(whole, whole.where("id % 50 = 0")).collect()
        assert sorted(map(tuple, got)) == [(0, 1, 1, 6 * 256 * 256), (0, 2, 2, 3 * 256 * 256), *want]


def test_top_k_of_large_values(spark):
    """Products beyond 64 bits rank right if no answer has one, and are an error else; so are components beyond them."""
    import pytest

    big = 1e12
    rows = [(0, [big, -big]), (1, [big, big]), (2, [1.0, 2.0]), (3, [2.0, 1.0]), (50, [1.0, 1.0])]
    whole = topk.whole_numbers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = topk.top_k(whole, whole.where("id = 50"), k=4).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, int(big) * 2 * 65536), (2, 3 * 65536), (3, 3 * 65536), (0, 0)]
    low = topk.top_k(whole, whole.where("id = 0"), k=1).collect()  # the product with 1 is 0, that with 2 and 50 is small
    assert [(r["vec_id"], r["score"]) for r in low] == [(3, int(big) * 65536)]
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.top_k(whole.unionAll(whole.selectExpr("id + 90", "v")), whole.where("id = 0"), k=1).collect()
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.whole_numbers(spark.createDataFrame([(1, [1e30])], "vec_id bigint, embedding array<double>")).collect()


def test_top_k_reads_in_shares_and_tiles(spark, monkeypatch):
    """Many equal bounds, few rows a task and a tile: the same answers."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=3), 1)]) for i in range(400)]
    whole = topk.whole_numbers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    want = sorted(map(tuple, topk.top_k(whole, whole.where("id % 50 = 0")).collect()))
    for name, value in (("READ_ROWS", 3), ("SCAN_ROWS", 16), ("TILE", 32), ("SAMPLE_BYTES", 200)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(map(tuple, topk.top_k(whole, whole.where("id % 50 = 0")).collect())) == want
    assert topk.top_k(whole.limit(0), whole.limit(0)).count() == 0


def test_quality(spark):
    words = [f"plain{i % 97} prose{i % 89}" for i in range(900)]
    rows = [(i, " ".join(words[i : i + 60]) if i % 2 else "### " * 20 + " *** ".join(words[i : i + 20])) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(5000, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(quality.held_out("doc_id")).collect()} & set(range(400))
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in held]) > 0.95 and got[400] == got[401] and all(0 <= s <= 1 for s in got.values())
    empty = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
