"""Every registered query: against DuckDB where SQL states it, its columns and rows on whole tables else; odd tables of the map-only operators."""

import duckdb
import pytest

from mailweir.llm import bpe, registry, urls, warc, wordpiece
from mailweir.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]
ROWS = {"op1": "pages", "op6": "pages", "op8": None}
COLUMNS = {
    "op1": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op2": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op3": {"doc_id", "n_shingles", "component_id"},
    "op4": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op5": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op6": {"page_id", "host", "path", "rule", "verdict"}, "op7": {"doc_id", "n_words", "n_tokens", "n_unknown"},
    "op8": {"query_id", "rank", "vec_id", "score"}, "op9": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op10": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF)
    key = name.split("_")[0]
    assert set(got.columns) >= COLUMNS[key]
    rows = got.collect()
    if table := ROWS.get(key, "documents"):
        ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select("page_id" if table == "pages" else "doc_id").collect()]
        assert sorted(r["page_id" if table == "pages" else "doc_id"] for r in rows) == sorted(ids)
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(registry.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(want.fetchall(), key=str)


def test_url_tables(spark):
    empty = spark.createDataFrame([], "url string, HOST string, rule int")
    judged = urls.judge_urls(empty, urls.RULES)
    assert judged.count() == 0 and [c for c in judged.columns if c.lower() == "host"] == ["host"]
    long = "http://a.example.org/es/" + "x/" * 500_000
    rows = spark.createDataFrame([(long, 1), (long, 2), ("http://" + "a." * 100_000 + "org/", 3), ("://", 4), ("x://?org/", 5)], "url string, k int")
    assert {r["k"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(rows, urls.RULES).collect()} == {1: ("example.org/es/", "block"), 2: ("example.org/es/", "block"), 3: ("org/", "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_word_piece_tables(spark):
    path = bpe.vocabulary("byte_bpe_50k.json")
    rows = spark.createDataFrame([("a b " * 200_000, "mine", 7), (None, "mine", 7)], "text string, N_WORDS string, n_tokens int")
    got = {r["text"] is None: (r["n_words"], r["n_unknown"]) for r in wordpiece.token_counts(rows, path).collect()}
    assert got == {False: (400_000, 0), True: (0, 0)}
    assert wordpiece.token_counts(rows.limit(0), path).count() == 0


def test_archives_of_odd_tables(spark):
    long = "<p>" + "é WARC/1.1\r\n" * 200_000
    rows = spark.createDataFrame([(1, "u", long, "x"), (2, None, long, "x"), (3, "u\nv", None, "x"), (3, "u", "", "x"), (None, "u", "one", "x")], "page_id bigint, url string, html string, type string")
    out = fresh_path(spark, "odd")
    warc.write_records(rows, out)
    got = sorted(((r["type"], r["record_id"], len(r["payload"] or b"")) for r in warc.read_records(spark, out).collect()), key=str)
    size = len(long.encode())
    assert got == sorted([("revisit", "<urn:record:1>", 0), ("response", "<urn:record:2>", size), ("response", "<urn:record:3>", 0), ("response", "<urn:record:3>", 0), ("response", "<urn:record:null>", 3)], key=str)
    empty = fresh_path(spark, "none")
    warc.write_records(rows.limit(0), empty)
    assert warc.read_records(spark, empty).count() == 0
