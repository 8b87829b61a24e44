"""Shards against a plain computation: sizes, digests, slots, groups, balance, and tasks for hot texts."""

import zlib

from mailweir.llm import sharding

SF = "/root/testdata/sf0.001"


def test_op9_matches_a_plain_computation(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = sharding.op9_histogram_shards(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert shards.keys() <= set(range(24))
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    sizes, largest = [sum(r["size"] for r in rows) for rows in shards.values()], max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * largest  # documents are large beside a shard here
    order = [(sum(x["size"] for x in shards[s]), s) for s in shards]
    total, before = sum(sizes), 0
    for size, _ in sorted(order, key=lambda x: x[1]):
        before += size
        assert abs(before / total * 24 - round(before / total * 24)) <= 24 * largest / total


def test_a_hot_text_is_several_tasks(spark):
    hot = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one hot text that many rows hold', concat('text number ', id)) as text", "'x' as _slice2").repartition(3)
    placed = sharding.histogram_sort(hot, shards=3)
    tasks = placed.rdd.glom().map(len).collect()
    assert max(tasks) <= 1200 and sum(tasks) == 6000
    rows = placed.collect()
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    held = {r["shard"] for r in rows if r["text"].startswith("one hot")}
    assert len(held) <= 2


def test_equal_texts_stay_together_if_that_is_balanced(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('group ', id % 500) as text")
    rows = sharding.histogram_sort(docs, shards=4).collect()
    of = {}
    for r in rows:
        of.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in of.values())


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, None, 2), (None, "", 3), (1, "x" * 100_000, 4), (1, "same", 5), (1, "same", 6), (2, "same", 7), (3, "\u00e9", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, SHARD int")
    got = sharding.histogram_sort(docs, shards=3).collect()
    assert sorted(r["size"] for r in got) == [8, 8, 8, 10, 12, 12, 12, 100_008] and "SHARD" not in got[0].asDict()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
