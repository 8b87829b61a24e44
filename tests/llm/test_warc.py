import pytest
from pyspark.sql import functions as F

from mailweir.llm import warc
from mailweir.llm.common import fresh_path

MAGIC = warc.MAGIC


def rows(spark, path):
    return {r["record_id"]: r.asDict() for r in warc.read_records(spark, path).collect()}


@pytest.mark.parametrize("width", ["100000", "700"])
def test_magic_in_payloads_is_rejected(spark, width):
    fake = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:record:66>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(i, f"http://a.example/{i}", ("x" * (i * 37 % 400) + (fake * (i % 4) if i % 3 == 0 else "") + MAGIC * (i % 2) + f"é{i}\r\n\r\n") * (6 if i == 30 else 1)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(2)
    out = fresh_path(spark, "test")
    warc.write_records(df, out)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in saved:
            spark.conf.set(k, width)
        got = rows(spark, out)
        if width == "700":
            assert warc.verified_entries(spark, out).count() > 20
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert {k: v["payload"].decode() for k, v in got.items()} == {f"<urn:record:{i}>": h for i, _, h in pages}
    assert all(v["type"] == "response" for v in got.values())


def test_repeats_nulls_and_odd_urls(spark):
    data = [(1, "u\r\nX: y", "a"), (2, None, "a"), (None, "n", "a"), (3, "u", None), (4, "u", ""), (5, "u", "b"), (5, "u", "b")]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    out = fresh_path(spark, "test")
    warc.write_records(df, out)
    got = sorted((r["record_id"], r["type"], r["refers_to"], r["uri"], bytes(r["payload"])) for r in warc.read_records(spark, out).collect())
    u = "<urn:record:{}>".format
    assert [g[:3] for g in got] == [(u(1), "revisit", u(2)), (u(2), "response", None), (u(3), "revisit", u(4)), (u(4), "response", None), (u(5), "response", None), (u(5), "response", None), (u("null"), "revisit", u(2))]
    assert got[0][3] == "u%0D%0AX: y" and got[1][3] is None
    out = fresh_path(spark, "test")
    warc.write_records(df, out, min_bytes=2)
    assert {r["type"] for r in warc.read_records(spark, out).collect()} == {"response"}


def test_broken_and_foreign_files(spark, tmp_path):
    good = f"{MAGIC}WARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    bad = f"{MAGIC}WARC-Type: resource\r\nWARC-Record-ID: <b>\r\nContent-Length: 900\r\n\r\nhi\r\n\r\n"
    (tmp_path / "cut.warc").write_bytes((good + bad + good.replace("<a>", "<c>")).encode())
    (tmp_path / "junk.warc").write_bytes(("junk" + good).encode())
    got = rows(spark, str(tmp_path))
    assert set(got) == {"<a>"} and bytes(got["<a>"]["payload"]) == b"hi"


def test_empty_table(spark):
    out = fresh_path(spark, "test")
    warc.write_records(spark.createDataFrame([], "page_id bigint, url string, html string, type int"), out)
    assert warc.read_records(spark, out).count() == 0


def test_ranges_stay_when_the_cores_change(spark):
    """Between the two passes, and before a second action, the parallelism that Spark cuts files by changes."""
    pages = [(i, f"http://a.example/{i}", "y" * (i * 53 % 700)) for i in range(200)]
    out = fresh_path(spark, "test")
    warc.write_records(spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1), out)
    cores, cost = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"
    try:
        spark.conf.set(cost, "100")
        spark.conf.set(cores, "7")
        found = warc.read_records(spark, out)
        for n in ("5", "31"):
            spark.conf.set(cores, n)
            assert sorted(r["record_id"] for r in found.select("record_id").collect()) == sorted(f"<urn:record:{i}>" for i in range(200))
    finally:
        spark.conf.unset(cores)
        spark.conf.unset(cost)


def test_a_chunk_without_a_range_is_an_error(spark, monkeypatch):
    out = fresh_path(spark, "test")
    warc.write_records(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id bigint, url string, html string").coalesce(1), out)
    entries = warc.verified_entries
    monkeypatch.setattr(warc, "verified_entries", lambda s, path: entries(s, path).withColumn("block", F.col("block") + 1))
    with pytest.raises(Exception, match="no byte range"):
        warc.read_records(spark, out).collect()
