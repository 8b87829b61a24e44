"""The classifier against a plain re-computation, on held-out labels, and on odd tables."""

import zlib

import numpy as np
import zstandard

from mailweir.llm import quality

SF = "/root/testdata/sf0.01"


def test_op10_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality.op10_quality_classifier(spark, SF).collect()}
    assert len(got) == 1000
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [d for d in labels if got[d]["held_out"]]
    good, bad = ([got[d]["score"] for d in held if labels[d] == k] for k in (1, 0))
    ranks = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    right = np.mean([got[d]["predicted"] == labels[d] for d in held])
    assert ranks > 0.9 and right > 0.85 and np.mean(np.array(good) >= quality.KEEP) > 0.97  # some 300 labels to learn from


def test_scores_match_a_plain_computation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: (r["text"], r["score"]) for r in quality.score(docs, model).collect()}

    def size(dictionary, text):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=7, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text))

    for text, score in list(got.values())[:60]:
        data = (text or "").encode()
        good, bad, n = size(model.good, data), size(model.bad, data), len(data)
        d, e, s = (min(max(x, -5), 5) for x in (10 * (bad - good) / max(good, bad), 20 * (bad - good) / (n + 1), np.log(n + 1) / 5))
        z = np.dot([1, d, e, d * s, e * s, s], model.weights)
        assert abs(score - (1 / (1 + np.exp(-z)) if data else model.base)) < 1e-9


def test_odd_tables(spark):
    good, bad = "a plain sentence of prose about the weather and the sea ", "### BUY now *** cheap $$$ click "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5) + str(i), "mine", 1.0) for i in range(400)]
    rows += [(400, None, "mine", 1.0), (401, "", "mine", 1.0), (1, rows[1][1], "mine", 1.0), (None, good * 4, "mine", 1.0), (402, good * 50_000, "mine", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _quality_score string, SCORE double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 1), (1, 1), (9, None), (9, 7), (9999, 1)], "doc_id bigint, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert {r["_quality_score"] for r in kept.collect()} == {"mine"} and ids.count(1) == 2 and 402 in ids and None in ids
    odd = np.mean([i in ids for i in range(1, 400, 2)])
    assert odd > 0.99 and np.mean([i in ids for i in range(0, 400, 2)]) < 0.05
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).collect()
    assert "SCORE" not in scored[0].asDict() and len({r["score"] for r in scored if not r["text"]}) == 1
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    only = quality.fit(docs, labels.where("quality = 1"))
    assert len({r["score"] for r in quality.score(docs, only).collect()}) == 1
