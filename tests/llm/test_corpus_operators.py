"""Fingerprints, mixing, toxicity, the Jaccard join and the pipeline against brute-force versions and on edge rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from reportloom.llm import fingerprints, jaccard, mixing, toxicity


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, n int, component_id int")


def saved(df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# ---- fingerprints ----


def test_fingerprints_edit_and_order(spark, tmp_path):
    random.seed(1)
    texts = ["\n".join(" ".join(random.choices("ab cd ef gh ij kl mn op".split(), k=12)) + str(random.random()) for _ in range(8)) for _ in range(12)]
    rows = [(k, t, "s", "en", len(t), 1, 1) for k, t in enumerate(texts)] + [(20, texts[3], "s", "en", 1, 1, 1), (21, "\n".join(reversed(texts[4].split("\n"))), "s", "en", 1, 1, 1), (22, None, "s", "en", 0, 1, 1), (23, "", "s", "en", 0, 1, 1)]
    got = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, saved(frame(spark, rows), tmp_path)).collect()}
    down = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    for k, (i, t) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        m = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[20].fingerprint == got[3].fingerprint and got[21].fingerprint == got[4].fingerprint and got[22].fingerprint == got[23].fingerprint
    assert len({r.fingerprint for r in got.values()}) == 13
    assert np.mean([got[k].near_edited for k in range(12)]) > np.mean([got[k].near_next for k in range(12)]) + 0.3


def test_fingerprints_are_homomorphic(spark):
    df = frame(spark, [(1, "a b\nc d e\nf", "", "", 1, 1, 1), (2, "f", "", "", 1, 1, 1), (3, "c d e\na b", "", "", 1, 1, 1)])
    v = {r.doc_id: r.v for r in fingerprints.fingerprints(df).collect()}
    one = spark.createDataFrame([(v[1], v[2], v[3])], "a array<long>, f array<long>, r array<long>")
    r = one.select((fingerprints.removed(F.col("a"), F.col("f")) == F.col("r")).alias("out"), (fingerprints.added(F.col("r"), F.col("f")) == F.col("a")).alias("in"), fingerprints.likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert r["out"] and r["in"] and r["same"] == 1.0


def test_fingerprints_edges(spark, edge, nothing, tmp_path):
    got = fingerprints.op4_fingerprints(spark, saved(edge, tmp_path)).collect()
    assert len(got) == edge.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.op4_fingerprints(spark, saved(nothing, tmp_path)).count() == 0
    one = fingerprints.op4_fingerprints(spark, saved(edge.limit(1), tmp_path)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# ---- mixing ----


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: most * sizes[s] for s in over})


def test_mixing_targets_and_sums(spark):
    random.seed(4)
    rows = [(k, " ".join(["w"] * random.randint(0, 40)), random.choice(["a", "b", "c", "d", "e", None, "zz"] + ["a"] * 8), "en", 1, 1, 1) for k in range(900)]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 21 for s in sizes) and len(got) == len(rows)
    again = mixing.mix(frame(spark, list(reversed(rows))).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixed_repeats_rows(spark, edge, nothing):
    plan = mixing.mix(edge)
    want = plan.where("taken > 0").agg(F.sum(F.expr("taken div size"))).first()[0]
    out = mixing.mixed(edge)
    assert out.columns == edge.columns and out.count() == want
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# ---- toxicity ----


def test_toxicity_restores_and_scores(spark, edge, nothing):
    random.seed(6)
    plain = "the and house river green walking with this that over under garden table people water idea".split()
    rows, labels = [], []
    for k in range(600):
        words = random.choices(plain, k=30)
        bad = k % 5 == 0
        if bad:
            words[7] = random.choice(["idiot", "scumbag", "moron"])
        rows.append((k, " ".join(words), "s", "en", 1, 1, 1))
        labels.append((k, int(bad)))
    for k, w in enumerate(["1d10t", "i d i o t", "idiiiiot", "m0r0n", "m.o.r.o.n", "s-c-u-m-b-a-g"]):
        rows.append((1000 + k, f"the house {w} and people", "s", "en", 1, 1, 1))
    rows += [(2000, None, None, None, None, 1, 1), (2001, "the house and people 123 a.b.c.d x-y-z", "s", "en", 1, 1, 1)]
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), lab).collect()}
    assert all(got[k].predicted == (k % 5 == 0) for k in range(600))
    assert all(got[1000 + k].predicted == 1 for k in range(6)), [(k, got[1000 + k].score) for k in range(6)]
    assert got[2000].predicted == 0 and got[2001].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.toxicity(edge, lab.limit(0)).collect()
    assert len(none) == edge.count() and all(r.score == 0 for r in none)
    assert toxicity.toxicity(nothing, lab).count() == 0


def test_toxicity_held_out_rows_are_not_learnt(spark):
    import zlib

    ids = spark.range(50).select(F.col("id"), toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in ids)


# ---- Jaccard join ----

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(rows):
    low = {c: c + 32 for c in range(65, 91)}
    out = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(low))
        out.append((r[0], frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, groups=6, copies=25, singles=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    line = [word() for _ in range(9)]
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words), "s", "en", 1, 1, 1))

    for _ in range(groups):
        base = [word() for _ in range(rng.randint(8, 150))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = line + own
            if rng.random() < 0.2:
                own = own[: int(len(own) * rng.uniform(0.7, 1))]
            add(own if rng.random() < 0.8 else base)
    for _ in range(singles):
        add(line + [word() for _ in range(rng.randint(0, 60))])
    for t in (["x"], ["X"], ["a", "b", "c", "d"], [], list("abcdefghi"), list("abcdefgh")):
        add(t)
    rng.shuffle(rows)
    return [(k, *r[1:]) for k, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "long"), [(1, 400), (2, 8), (3, 400)])
def test_jaccard_components(spark, monkeypatch, seed, long):
    """Short columns, and with a small LONG columns that are treated like frequent ones."""
    rows = corpus(seed)
    monkeypatch.setattr(jaccard, "LONG", long)
    if seed == 3:  # nearly all columns count as frequent
        monkeypatch.setattr(jaccard, "levels_of", lambda c: np.where(c > 3, np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.uint8))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_edges(spark, edge, nothing):
    got = jaccard.join(edge).collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[3] == by[4] == [(0, 3)] or by[3] == [(0, 3)] and by[4] == [(0, 4)]
    assert by[2] == [(396, 1)] * 2 and by[6] == [(399, 1)] and by[8] == [(1, 8)]
    assert all(c is None for _, c in by[None])
    assert jaccard.join(nothing).count() == 0
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 7, 8, 9]


# ---- pipeline ----


def test_pipeline_keeps_clean_rows(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, src)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert k + 1 == len(corpus_pipeline.STAGES) or docs.columns == names
    whole = spark.read.parquet(f"{src}/documents.parquet")
    after = {n: spark.read.parquet(f"{tmp_path}/{n}") for n, _ in corpus_pipeline.STAGES}
    assert after["language_id"].count() == whole.count()
    rows = [(r.doc_id, r.text) for r in after["language_id"].collect()]
    want = {c for _, c in brute_components(rows).values()}
    assert {r.doc_id for r in after["ngram_jaccard"].collect()} == want
    assert after["secret_scans"].count() == len(want)
    assert docs.count() == after["mixing"].count()


def test_mixing_sql_agrees(spark):
    src = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{src}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(c.execute(f"SELECT {', '.join(names)} FROM ({mixing.OP6_SQL})").fetchall())
    got = sorted(tuple(r) for r in mixing.op6_mixing(spark, src).select(*names).collect())
    assert [(a, b, d, round(t, 6), e) for a, b, d, t, e in got] == [(a, b, d, round(t, 6), e) for a, b, d, t, e in want]
