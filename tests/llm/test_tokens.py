"""Token files and BPE against the tokenizers library, on whole tables and odd texts."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mailweir.llm import bpe, tokenids
from mailweir.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
PATH = bpe.vocabulary("byte_bpe_50k.json")
ODD = [None, "", " ", "a  b\n\nc", "x<|endoftext|>y <|endoftext|> z", "a b c  d e　 f \x1c g", " lead", "trail ", "don't  stop", "\xe9 \xa0\xe8\u0085 b c", "\xa0", "\n a b", "a\tb c", "日本 語 テ", "x" * 5000, "ab " * 4000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_both_encoders_match_the_library(library, monkeypatch):
    content = open(PATH, "rb").read()
    for make in (bpe.Bpe, tokenids.LibraryEncoder):
        model = make(content)
        for most in (24 << 20, 600, 0):  # with a cache that holds all, some and nothing
            model.cache.most = most
            for texts in (pa.array(ODD, pa.string()), pa.array(ODD[::-1], pa.string()), pa.array(ODD, pa.string()).slice(3, 4), pa.array([], pa.string())):
                ids, bounds = model.encode(texts)
                assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == [ids_of(library, t) for t in texts.to_pylist()]


def test_decoding_matches_the_library(library):
    model = bpe.Bpe(open(PATH, "rb").read())
    runs = [[int(model.base[0xE9])], [int(model.base[0x80])], [], [int(model.base[65]), int(model.base[0xFF])], ids_of(library, "ends in \xe9"), [50256, 7], [int(model.base[0xC3])], [int(model.base[0xA9])]]
    for some in (runs, runs[2:3], runs[4:6], runs[6:]):
        flat, bounds = np.array([i for r in some for i in r], np.uint32), np.cumsum([0, *map(len, some)])
        assert model.decode(flat, bounds).to_pylist() == [library.decode(r, skip_special_tokens=False) for r in some]


def test_op4_and_op5_queries_match_the_library(spark, library):
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    files = sorted(map(tuple, tokenids.op4_token_id_files(spark, SF).collect()))
    trips = sorted(map(tuple, bpe.op5_bpe_round_trip(spark, SF).collect()))
    start = 0
    for (doc, text), of_file, trip in zip(docs, files, trips, strict=True):
        ids = ids_of(library, text)
        ended = np.array([*ids, 0], "<u4").tobytes()
        assert of_file == (doc, start, len(ids) + 1, zlib.crc32(ended))
        decoded = library.decode(ids, skip_special_tokens=False)
        assert trip == (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        start += len(ids) + 1


def test_hot_and_null_keys_are_split_and_found(spark, library):
    """A third of the rows has one key and a third none; columns of the files' own names don't matter."""
    hot = spark.range(2000).selectExpr("if(id % 3 = 0, 7, if(id % 3 = 1, null, id)) as doc_id", "concat('t ', id) as text", "1 as key", "2 as shard")
    out = fresh_path(spark, "hot")
    tokenids.write_ids(hot, PATH, out, shards=9, index_keys=100)
    rows = tokenids.read_documents(spark, out).orderBy("start").collect()
    assert len(rows) == 2000 and [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert max(r["count"] for r in tokenids.read_shards(spark, out).groupBy("shard").count().collect()) < 500
    keys = spark.createDataFrame([(5,), (7,), (7,), (99_999,), (None,), (6,)], "doc_id bigint")
    found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokenids.lookup(spark, out, keys).collect()}
    assert found.keys() == {5, 7} and found[5] == [*ids_of(library, "t 5"), 0]


def test_a_lookup_opens_only_the_files_it_needs(spark, tmp_path):
    import shutil
    from pathlib import Path

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    out = fresh_path(spark, "few")
    tokenids.write_ids(docs, PATH, out, shards=10, index_keys=300)
    key = spark.createDataFrame([(1234,)], "doc_id bigint")
    place = tokenids.locate(spark, out, key).first()
    part = key.select(tokenids._part(key["doc_id"], int(spark.read.text(f"{out}/parts").first()[0]))).first()[0]
    folder = Path(out.removeprefix("file:"))
    for kind, keep in (("shards", place["shard"]), ("index", part)):  # without any other file the answer is the same
        for file in (folder / kind).glob("part-*"):
            if not file.name.startswith(f"part-{keep:05d}-"):
                file.unlink()
    assert len(tokenids.lookup(spark, out, key).collect()) == 1
    shutil.rmtree(folder)


def test_keys_of_other_types_are_refused_and_empty_tables_have_no_shard(spark):
    rows = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError, match="doc_id"):
        tokenids.write_ids(rows, PATH, fresh_path(spark, "bad"))
    out = fresh_path(spark, "none")
    none = spark.createDataFrame([], "doc_id int, text string, content binary")
    tokenids.write_ids(none, PATH, out)
    assert tokenids.read_documents(spark, out).count() == 0 and tokenids.lookup(spark, out, spark.createDataFrame([(1,)], "doc_id int")).count() == 0


def test_column_clashes_of_bpe(spark):
    rows = spark.createDataFrame([(1, "a b", "mine", b"mine", 5)], "doc_id int, text string, decoded string, IDS binary, n_tokens int")
    got = bpe.round_trip(rows, PATH).collect()[0].asDict()
    assert got["doc_id"] == 1 and got["decoded"] == "a b" and got["n_tokens"] == 2 and len(got["ids"]) == 8 and "IDS" not in got
    assert bpe.round_trip(rows.limit(0), PATH).count() == 0
