"""Vector codes: equal to assigning by all distances, bounds that hold, pruning that prunes, and odd rows."""

import math
import random

import duckdb
import numpy as np
from reportloom.llm import vectorcodes as vc

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows):
    """(vec_id, code, error, label_error) and codebooks by all distances, in Python integers."""
    kept = [(i, [min(max(math.floor(256 * x), -vc.MOST), vc.MOST) for x in v], lab) for i, v, lab, *_ in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 16
    cut = [[r[1][p * w : (p + 1) * w] for p in range(16)] for r in kept]
    books = [[cut[e][p] for e in range(min(64, len(kept)))] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(16)] for c in cut]
    for _ in range(2):
        codes = near()
        for p in range(16):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = near()
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(16)) for c, k in zip(cut, codes)]
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted((str(r[0]), "".join(f"{x:02x}" for x in k), e, by[r[2]]) for r, k, e in zip(kept, codes, errors)), vc.digest(np.array(books))


def result(df):
    coded, book = vc.coded_vectors(df)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in vc.with_label_errors(coded).collect()), vc.digest(book)


def test_query_equals_all_distances(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, sha = brute(rows)
    got = vc.op11_vector_codes(spark, SF).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {sha}


def test_sql_equals_all_distances():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    want, sha = brute(rows)
    got = con.execute(vc.OP11_SQL).fetchall()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == want and {r[4] for r in got} == {sha}


def test_odd_rows_and_ties(spark):
    rng = random.Random(4)
    coarse = lambda: [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(32)]  # noqa: E731  few values: many equal distances
    rows = [(k, coarse(), k % 3 or None, "x") for k in range(150)]
    rows += [(7, rows[7][1], 1, "x"), (7, rows[7][1], 1, "x"), (None, coarse(), None, None), (None, None, 1, None), (200, None, 1, "x"), (201, [], 1, "x")]
    rows += [(202, [None, *coarse()[1:]], 2, "x"), (203, [math.nan, *coarse()[1:]], 2, "x"), (204, [math.inf, *coarse()[1:]], 2, "x"), (205, coarse()[:16], 2, "x"), (206, [1e30, *coarse()[1:]], 2, "x")]
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(5, [0.1 * k for k in range(16)], 1, "x"), (3, [0.5] * 16, 1, "x")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    for rows in ([], [(1, None, 1, "x")], [(1, [0.5] * 7, 1, "x")]):
        assert vc.with_label_errors(vc.coded_vectors(spark.createDataFrame(rows, SCHEMA))[0]).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, (16, 64, 4))
    x = (centres.transpose(1, 0, 2)[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 16, 4))).astype(np.int64)
    book = x[:64].transpose(1, 0, 2).copy()
    now = vc.Bounds(book, max(1, -(-int(vc.Bounds(book, 1).between.max()) // 255)))
    codes, upper, lower = now.first(x)
    for _ in range(3):
        moved = book + rng.integers(-6, 7, book.shape)
        now = vc.Bounds(moved, now.step, book)
        codes, upper, lower, measured = now.again(x, codes, upper, lower)
        far = vc.distances(x, moved)
        assert (codes == far.argmin(axis=2)).all()
        own = np.take_along_axis(far, codes[:, :, None], 2)[:, :, 0]
        assert (upper**2 >= own * vc.FINE**2).all() and ((lower * now.step) ** 2 <= far * vc.FINE**2).all()
        assert measured < 0.2 * far.size
        book = moved
