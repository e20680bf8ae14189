"""The Jaccard join on shared ids, clashing names, boilerplate and hot keys, against brute force."""

import random

from pyspark.sql import functions as F
from reportloom.llm import common, jaccard

from test_corpus_operators import brute_components, corpus, frame

A, B = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))


def test_rows_that_share_an_id(spark):
    rows = [(3, A), (5, A), (5, B), (7, B), (8, A + " z"), (9, ""), (9, ""), (None, A), (None, A), (3, B + " y"), (10, B + " y"), (10, B + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    # B, B y and what shares their ids: texts are linked, ids aren't.
    assert got == sorted([(3, 26, 3), (5, 26, 3), (5, 26, 3), (7, 26, 3), (8, 27, 3), (9, 0, 9), (9, 0, 9), (-1, 26, None), (-1, 26, None), (3, 27, 3), (10, 27, 3), (10, 27, 3)])
    kept = sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in jaccard.one_of_each(df).collect())
    assert kept == sorted([(-1, A), (-1, A), (3, A), (3, B + " y"), (9, "")])
    probe = spark.createDataFrame([(3, A), (5, A), (5, B)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard.one_of_each(probe).collect()) == [(3, A), (5, B)]


def test_versions_of_one_id(spark):
    df = spark.createDataFrame([(5, A), (5, A + " z"), (6, A)], "doc_id long, text string")
    kept = jaccard.one_of_each(df).collect()
    assert len(kept) == 1 and kept[0].doc_id == 5 and kept[0].text in (A, A + " z")


def test_clashing_columns(spark):
    names = "_id long, _h long, h long, _hot long, _salt int, component long, component_id long, n int, size int, `rep` long, node long, `a.b` string, column long"
    df = spark.createDataFrame([(k % 3, [A, B][k % 2], 0, *range(11), "x", 1) for k in range(4)], "doc_id long, text string, n_chars long, " + names)
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text) for r in out.collect()) == [(0, A), (0, B)]


def test_hot_keys_are_split(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(common, "SPLITS", 3)
    monkeypatch.setattr(jaccard, "TASK_LEVEL", 1)
    monkeypatch.setattr(jaccard, "LONG", 6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_long_chain_converges(spark):
    edges = spark.range(1, 3000).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    got = jaccard.components(edges)
    assert got.agg(F.count("*"), F.max("label"), F.min("id")).first() == (2999, 0, 1)


def test_boilerplate_of_thousands(spark):
    """Two thousand texts share a long passage; some are copies, some have half of their words in it, some nearly all."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = [word() for _ in range(120)]
    rows = []
    for k in range(2000):
        own = [word() for _ in range(rng.choice([3, 10, 20, 30, 60, 120]))]
        rows.append((k, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]), "s", "en", 1, 1, 1))
    for k in range(60):
        rows.append((2000 + k, rows[rng.randrange(2000)][1] + " " + word(), "s", "en", 1, 1, 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == quick_components(rows)


def quick_components(rows):
    """brute_components() by bit sets: all pairs, the passage's n-grams counted once."""
    from test_corpus_operators import brute_sets

    sets = brute_sets(rows)
    root = {i: i for i, _ in sets}
    where = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    common_to_many = {g for g, ks in where.items() if len(ks) > 200}
    held = [len(s & common_to_many) for _, s in sets]
    rest = [s - common_to_many for _, s in sets]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for m in range(k):
            j, b = sets[m]
            both = min(held[k], held[m])  # an upper bound of what they share of the passage
            if 100 * (both + len(rest[k] & rest[m])) >= 80 * (len(a) + len(b) - both - len(rest[k] & rest[m])) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}
