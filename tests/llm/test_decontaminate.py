"""Decontamination against brute force: phrases, near matches, odd texts, clashing columns, and common words."""

import hashlib
import os
import random
import re
import time
from pathlib import Path

import pytest

from mailweir.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(texts, items, size=10):
    """(n_words, n_hit, items) of each text."""
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), size)
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if of := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= of
        out.append((len(w), len(hit), sorted(found)))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda n=40: f"w{int(rng.random() ** 2 * n)}"
    items = [(i, " ".join(word() if rng.random() < 0.7 else f"only{i}x{k}" for k in range(rng.randint(1, 59)))) for i in range(20)]
    items += [(20, "Short, one"), (21, ""), (22, None), (None, "w1 w2"), (20, "also w3"), (23, "\u00e9t\u00e9 \u00c9 a"), (24, "a a a a a a a a a a a a")]
    texts = [None, "", " .,", "short one and SHORT: one", "also w3", "x\u00e9t\u00e9 \u00e9t\u00e9-\u00c9 A!", "a " * 40, "a " * 9]
    texts += [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(30)]
    for _, t in items[:20]:
        w = words(t)
        texts += [" ".join(w), " ".join(word() for _ in range(20)) + "; " + ", ".join(w[2:]).upper() + "\n" + word(), " ".join(w[:9])]
    return items, texts * 2


def test_op2_matches_brute_force(spark, tmp_path):
    items, texts = corpus()
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, decontaminate.op2_decontamination(spark, str(tmp_path)).collect()))
    want = [(d, n, hit, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), hit > 0) for d, (n, hit, ids) in enumerate(brute(texts, items))]
    assert [g[:6] for g in got] == want
    assert all(g[6] >= g[3] for g in got) and any(g[6] > g[3] for g in got)  # a hit is a near match


@pytest.mark.parametrize("limits", [{}, {"PART_BYTES": 300, "BLOCK_BYTES": 500, "STARTS": 7}])
def test_hits_in_parts_and_small_blocks(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(decontaminate, name, value)
    if limits:
        parts = decontaminate.item_parts
        monkeypatch.setattr(decontaminate, "item_parts", lambda b, i, t: parts(b, i, t, 300))
    items, texts = corpus(8)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(d, t, "mine") for d, t in enumerate(texts)], "items bigint, text string, `a b` string")
    got = sorted((r["text"] or "", r["n_words"], sum(b - a for a, b in r["hits"]), r["items"], r["a b"]) for r in decontaminate.find_hits(docs, bench).collect())
    assert got == sorted((t or "", *f, "mine") for t, f in zip(texts, brute(texts, items), strict=True))


@pytest.mark.parametrize("within", [20, 6])
def test_near_matches(spark, within):
    """All terms of a window near its rarest one; items longer than the distance, copies of parts, words that the corpus lacks."""
    rng = random.Random(4)
    word = lambda n=60: f"w{int(rng.random() ** 2 * n)}"
    items = [(i, [word() if rng.random() < 0.6 else f"only{i}x{k}" for k in range(rng.randint(15, 59))]) for i in range(8)] + [(20, ["w1"]), (21, []), (22, ["w1", "w2"]), (23, ["w1", "w9", "w2"])]
    texts = [[word() for _ in range(rng.randint(0, 120))] for _ in range(25)] + [w for _, w in items[:4]]
    texts += [[word() for _ in range(30)] + w[3:40] for _, w in items[4:]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id bigint, text string")
    count = {}
    for w in texts:
        for x in w:
            count[x] = count.get(x, 0) + 1
    size, want = min(10, within + 1), {}
    for i, w in items:
        for k in range(max(len(w) - size + 1, min(len(w), 1))):
            window = set(w[k : k + size])
            rarest = min(window, key=lambda x: (count.get(x, 0), x))
            for d, t in enumerate(texts):
                for at, x in enumerate(t):
                    if x == rarest and window <= set(t[max(0, at - within) : at + within + 1]):
                        want.setdefault((d, i), set()).add(at)
    got = {(r["doc_id"], r["item_id"]): r["places"] for r in decontaminate.near_matches(docs, bench, within=within).collect()}
    assert got == {k: len(v) for k, v in want.items()} and {(25 + i, i) for i in range(4)} <= set(got)


def test_string_ids_and_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([("b", item), ("a", item), ("c", "none of it")], "item_id string, text string")
    names = ["_h", "hits", "n_words", "items", "_n", "_i", "block", "terms"]
    docs = spark.createDataFrame([(1, item, *names), (2, "clean text", *names), (None, None, *names)], f"doc_id int, text string, {', '.join(n + ' string' for n in names)}")
    found = {r["doc_id"]: r for r in decontaminate.find_hits(docs, bench).collect()}
    assert found[1]["items"] == ["a", "b"] and found[1]["_h"] == "_h" and found[None]["n_words"] == 0
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.schema == docs.schema and sorted(map(tuple, clean.collect()), key=str) == sorted([(2, "clean text", *names), (None, None, *names)], key=str)
    assert decontaminate.keep_clean(docs.limit(0), bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == 3


def test_windows_of_common_words_in_a_long_text():
    """Memory follows the text, not its product with the windows: 1,024 windows of two words, in a text of those."""
    import resource

    import pyarrow as pa

    rng = random.Random(1)
    items = [(k, " ".join("ab"[k >> i & 1] for i in range(10)).encode()) for k in range(1024)]
    part = decontaminate.Part(items, 10)
    part.order(decontaminate.np.array([5, 5]))
    text = " ".join(rng.choice("ab") for _ in range(300_000))
    tokens, first = decontaminate.tokens(pa.array([text]))
    coded = tokens.dictionary_encode()
    at = coded.indices.to_numpy()
    counts = decontaminate.np.bincount(at).astype("<u4")
    block = decontaminate.Block(b"\n".join(coded.dictionary.to_pylist()), counts.tobytes(), decontaminate.np.argsort(at, kind="stable").astype("<u4").tobytes(), first.astype("<u4").tobytes(), part)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = decontaminate.np.concatenate([decontaminate.np.stack([s, w], 1) for _, s, w in block.phrases(part)])
    assert len(found) == 300_000 - 9 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    flat = text.split()
    for s, w in found[:: 5000].tolist():
        assert [part.terms[int(t)].as_py().decode() for t in part.windows[10][w]] == flat[s : s + 10]


def test_large_partitions_come_in_small_batches(spark, tmp_path, monkeypatch):
    """Texts of 2 MB in one partition: no function of the filter gets much more than a block of them at once."""
    real, name = decontaminate.lean, "spark.sql.execution.arrow.maxBytesPerBatch"

    def watched(run):
        def looked(batches):
            for k, batch in enumerate(batches):
                Path(f"{tmp_path}/{os.getpid()}-{time.time_ns()}-{k}").write_text(str(batch.nbytes))
                yield from run(iter([batch]))

        return real(looked)

    monkeypatch.setattr(decontaminate, "lean", watched)
    texts = [f"text{i} " + " ".join(f"w{(i + k) % 997}" for k in range(430_000)) for i in range(12)]
    texts[5] += " one leaked window of words"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(1, "leaked window of words")], "item_id bigint, text string")
    before = spark.conf.get(name, None)
    kept = decontaminate.keep_clean(docs, items)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [i for i in range(12) if i != 5]
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(sizes) > 40 << 20 and max(sizes) < 12 << 20
    assert spark.conf.get(name, None) == before
