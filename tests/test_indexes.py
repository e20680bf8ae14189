"""Facet bitmaps and lookup postings against what they stand for, over several buckets of ranks."""

import random

import pytest
from pyspark.sql import functions as F
from reportloom.operators import facetindex, lookup, query, resolve


@pytest.fixture(scope="module")
def reports(spark):
    rng = random.Random(6)
    words = ["Asia", "round", "Flood", "of", "a", "İzmir", "camp"]
    rows = []
    for k in range(70_000):  # three buckets
        date = rng.choice([None, f"20{rng.randint(10, 15)}-{rng.randint(1, 12):02d}-0{rng.randint(1, 9)}", "bad"])
        rows.append((f"/r/{k}" + ("#x" if k % 9 == 0 else ""), " ".join(rng.choices(words, k=2)), date, rng.choice(["k1", "k2", None]), rng.choice(["Alpha", "k1", None]), None if date in (None, "bad") else int(date[:4]), rng.choice([None, [], ["N"], ["N", "S"], ["S", "S"]]), rng.choice([None, ["B"], ["A", "B"]]), "Sum"))
    df = spark.createDataFrame(rows, "url string, title string, date string, component_key string, component string, year int, regions array<string>, states array<string>, summary string")
    folder = spark.conf.get("spark.checkpoint.dir") + "/ranked-reports"
    resolve.ranked(df).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def test_filters_and_counts(spark, reports):
    index = facetindex.build(reports).persist()
    cases = [{}, {"components": ["k1"]}, {"components": ["Alpha", "k2"], "years": [2011, 2013]}, {"months": [3, 12], "regions": ["S"]}, {"states": ["A"], "regions": ["N", "none"]}, {"years": [1900]}, {"months": [13]}]
    for case in cases:
        found = facetindex.matching(index, **case)
        want = {r.id for r in reports.where(query.facets(**case)).select("id").collect()}
        assert facetindex.count(found).first()["n"] == len(want)
        assert {r.id for r in facetindex.rows_of(found, reports.select("id")).collect()} == want
    distinct = reports.withColumn("regions", F.array_distinct("regions"))
    for by in ("none", "month", "year", "component", "region", "state"):
        assert sorted(map(str, facetindex.count_by(index, by).collect())) == sorted(map(str, query.count_by(distinct, by).collect())), by
    case = {"years": [2012], "regions": ["N"]}
    kept = distinct.where(query.facets(**case))
    assert sorted(map(str, facetindex.count_by(index, "state", facetindex.matching(index, **case)).collect())) == sorted(map(str, query.count_by(kept, "state").collect()))


def test_lookups_equal_the_full_scan(spark, reports, tmp_path):
    said = F.array(F.concat(F.lit("People in "), "title", F.lit(" saw 5 CAMPS")), F.when(F.col("id") % 1000 == 7, F.lit("A rare zebra of İzmir")).otherwise("none"))
    figure = F.array(F.struct(F.lit("camps").alias("label"), F.lit(5).cast("long").alias("value"), F.lit(0).alias("idx"), F.lit("").alias("subject"), F.lit("page").alias("source")))
    index = reports.where("id % 3 = 1").select(F.substring_index("url", "#", 1).alias("url"), said.alias("s"), F.when(F.col("id") % 2 == 0, figure).alias("f"))
    folder = f"file://{tmp_path}/lookup"
    lookup.build(reports, index, folder)
    for words, keyword, limit in [("asia ROUND", "camps", None), ("", "zebra", 20), ("", "ze", 3), ("a", "", 4), ("flood of", "none", 7), ("nothing", "camps", 5), ("", "no such text", 5), ("i̇zmir", "İzmir", 5)]:
        got = [(r.title, r.date, r.url, str(r.figures), r.sentences) for r in lookup.search(spark, folder, words, keyword, limit).collect()]
        want = [(r.title, r.date, r.url, str(r.figures), r.sentences) for r in query.figure_lookup(reports, index, words, keyword, limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), (words, keyword)
