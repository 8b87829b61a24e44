import random
import re

from mailweir.llm.jaccard import Shingler, jaccard_components


def brute(rows):
    """doc row number -> (set size, smallest reachable doc_id)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randint(0, 400))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):  # near copies in a chain, some below the threshold
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
    for _ in range(80):  # a common passage in many texts, some of which are hardly more than it
        texts.append(" ".join(passage + [word() for _ in range(rng.randint(0, 90))]))
    hot = [word() for _ in range(100)]
    for _ in range(150):  # a large group of near copies of one text
        copy = list(hot)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(100)] = word()
        texts.append(" ".join(copy))
    texts += ["a b c d e f g", "A B\tC d\n e F g", "a b c", "a  B C", "", None, " \n", "x", "x", "é É", "é É"] + ["same text of six words here"] * 20
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(None, "a b c"), (None, None), (7, "other row of a repeated id, long enough to count")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id bigint, text string, sig string")
    got = sorted(map(tuple, jaccard_components(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_tables(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [tuple(r) for r in jaccard_components(spark.createDataFrame([(3, None)], "doc_id bigint, text string")).collect()] == [(3, 0, 3)]


def test_long_texts_hash_in_segments():
    text = b" ".join(b"word%d" % (i % 70_000) for i in range(300_000))
    shingler = Shingler()
    pieces = shingler.word_hashes(__import__("numpy").frombuffer(text[:600_000], "u1"))
    whole = shingler.all_words(text)
    assert len(whole[0]) == 300_000 and (whole[1][:60_000] == pieces[1][:60_000]).all()
    assert len(shingler.sets([text])[0]) == 70_000


def test_components_of_long_chains(spark, monkeypatch):
    """Chains that no task holds whole need several levels; each ends as one component."""
    from mailweir.llm import jaccard

    monkeypatch.setattr(jaccard, "CHUNK_LINKS", 40)
    name = lambda c, i: (c << 40) + i * 7919
    links = [(name(c, i), name(c, i + 1)) for c in range(5) for i in range(60)] + [(name(9, 0), name(9, i)) for i in range(1, 200)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["comp"] for r in jaccard.components(spark.createDataFrame(links, "p bigint, id bigint").repartition(12)).collect()}
    groups = [{name(c, i) for i in range(61)} for c in range(5)] + [{name(9, i) for i in range(200)}]
    assert len(got) == sum(map(len, groups))
    firsts = [{got[x] for x in g} for g in groups]
    assert all(len(f) == 1 and f <= g for f, g in zip(firsts, groups, strict=True))


def test_one_row_of_each_group_stays(spark):
    """Repeated doc_ids and several null ids: one row a component, and every row without words."""
    from mailweir.llm.jaccard import keep_first

    base = " ".join(f"v{i}" for i in range(60))
    other, third, lone = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, base, k) for k in range(30)] + [(1, base + " more", 30), (2, base, 31), (None, base, 32)]  # one component
    rows += [(1, other, 33), (5, other, 34)]  # id 1 names another component as well
    rows += [(7, third, 35), (6, third + " more", 36), (6, third + " more", 37), (7, lone, 38)]
    rows += [(None, "only nulls hold this text", 39)] * 3 + [(None, "only nulls hold this text", 40)]
    rows += [(None, "", 41), (None, None, 42), (None, " ", 43), (1, "", 44), (1, "", 45), (None, "a null id alone", 46)]
    got = sorted(map(tuple, keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, k int").repartition(5)).collect()), key=str)
    keys = [(d, t) for d, t, _ in got if (t or "").strip()]
    assert sorted((d, t.split(" more")[0]) for d, t in keys if d is not None) == [(1, base), (1, other), (6, third), (7, lone)]
    assert sorted(t for d, t in keys if d is None) == ["a null id alone", "only nulls hold this text"]
    assert sorted(k for _, t, k in got if not (t or "").strip()) == [41, 42, 43, 44, 45]
    assert all(row in rows for row in got)


def test_every_link_is_found(spark, monkeypatch, tmp_path):
    """Numbers of links against brute force, with groups that are larger than a side."""
    from mailweir.llm import jaccard

    monkeypatch.setattr(jaccard, "SIDE_SETS", 16)
    monkeypatch.setattr(jaccard, "COUNTED", 50)
    rng = random.Random(9)
    word = lambda: "w" + str(rng.randint(0, 300))
    texts = []
    for size, many in ((100, 120), (40, 30), (12, 20), (300, 9)):
        base = [word() for _ in range(size)]
        for _ in range(many):  # near copies, shorter and longer ones
            copy = base[: rng.randint(size * 3 // 4, size)] + [word() for _ in range(rng.randint(0, size // 8))]
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            texts += [" ".join(copy)] * rng.choice((1, 1, 1, 3))
    texts += [" ".join(word() for _ in range(30)) for _ in range(20)] + ["a b", "A B", "x", "", None, " "]
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    links = [sum(i != j and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert max(links) > 40
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.op3_jaccard_components(spark, str(tmp_path)).collect())
    assert got == [(*b, k) for b, k in zip(sorted(brute(rows)), links, strict=True)]


def test_columns_of_the_operators_own_names(spark):
    """keep_first gives back all columns; jaccard_components takes doc_id and text alone."""
    from mailweir.llm import jaccard

    names = ["_digest", "_id", "_key", "row", "comp", "sig", "id", "n", "n_shingles", "keys", "last"]
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text, *names), (2, text + " more", *names), (2, text + " more", *names), (3, "another text of its own here", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {', '.join(n + ' string' for n in names)}")
    kept = jaccard.keep_first(docs)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
    assert sorted(map(tuple, jaccard.jaccard_components(docs, links=True).collect()), key=str) == sorted([(1, 56, 1, 2), (2, 57, 1, 2), (2, 57, 1, 2), (3, 2, 3, 0), (None, 0, None, 0)], key=str)


def test_very_long_texts_link(spark):
    long = " ".join(f"w{i % 50_000}x{i // 50_000}" for i in range(200_000))
    docs = spark.createDataFrame([(5, long), (4, long + " and a little more"), (6, "w1")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect()) == [(4, 4), (5, 4), (6, 6)]
