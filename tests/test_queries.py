"""Every query with SQL gives DuckDB's rows on the smallest tables; golden values; models of the harder scalars."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from reportloom.functions import dates, rounds, text, urls
from reportloom.operators import classify, discovery, facts, query, reference, resolve
from reportloom.plans import registry
from reportloom.sources import files
from reportloom.streaming import harvest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def test_every_query_has_rows_or_a_reason(spark):
    for name in ("figure_dedupe", "fact_index"):
        assert registry.queries()[name](spark, SF).count() > 0


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_golden_dates(spark):
    x = F.col("x")
    assert values(spark, ["(19 December 2016—25 January 2017)", "(5 May 2024) updated 2 Jan 2023", "none", None], dates.title_date(x)) == [("2017-01-25",), ("2023-01-02",), (None,), (None,)]
    assert values(spark, ["May 25 2023 | 2024-01-01T00:00", "", None, "Foo 3, 2020 | 7 Mar 2021"], dates.parse_date(x)) == [("2023-05-25",), (None,), (None,), ("2021-03-07",)]


def test_golden_rounds(spark):
    x = F.col("x")
    got = values(spark, ["Round 44", "Displacement Report 43", "Round XXII", "Return Dashboard 1 (2025)", "Flash Round 3"], rounds.round_number(x, registry.STOP, registry.PRODUCTS))
    assert got == [(44,), (43,), (22,), (None,), (None,)]


def test_golden_figures(spark):
    page = "The flood affected 16,921 individuals and displaced 3,894 individuals in 12 locations."
    df = spark.createDataFrame([("u", page, None, None)], "url string, page string, summary string, pdf string")
    got = [(r.label, r.value, r.idx, r.subject, r.source) for r in facts.figures(facts.sentence_rows(df, ["url"]), ["url"]).orderBy("ord").collect()]
    assert got == [("individuals", 16921, 0, "affected", "page"), ("individuals", 3894, 0, "displaced", "page"), ("locations", 12, 0, "displaced", "page")]


def model_subject(s, start, end, label):
    if label in text.LABEL_SUBJECTS:
        return text.LABEL_SUBJECTS[label]
    before, after = s[max(0, start - 60) : start].lower(), re.split(r"\d", s[end : end + 30].lower())[0]
    places = [(before.rfind(w), -k, v) for k, (w, v) in enumerate(text.SUBJECTS)]
    at, _, who = max(places)
    if at >= 0:
        return "IDPs" if who == "displaced" and "internally displaced" in before[max(0, at - 12) : at + 25] else who
    return next((v for w, v in text.SUBJECTS if w in after), "")


def test_figures_equal_model(spark):
    random.seed(8)
    words = "In May the 1,200 345 12 2019 3 000 45% individuals households returnees IDPs internally displaced persons fled camps wards affected registered average of per arrivals were and 7.5 women".split(" ")
    rows = [(str(k), " ".join(random.choices(words, k=25)) + ".") for k in range(300)]
    want = []
    for url, s in rows:
        for k, (label, noun) in enumerate(text.METRICS):
            for m in re.finditer(rf"({text.NUMBER})\s+(?:\w+\s+){{0,2}}?(?:{noun})\b", s, re.I):
                value = float(m[1].replace(",", "").replace(" ", ""))
                if 1900 <= value <= 2035 and "," not in m[1] or re.search(r"\d\s*%|per ?cent", s[m.start() : m.end() + 3], re.I) or value != int(value):
                    continue
                if re.search(r"average|size of|\bper\b|ratio|rate of", s[max(0, m.start() - 22) : m.start()].lower()):
                    continue
                want.append((url, k, m[1], model_subject(s, m.start(), m.end(), label)))
    df = facts.metric_matches(spark.createDataFrame(rows, "url string, text string")).where(facts.is_count(F.col("before"), F.col("num"), F.col("noun"), F.col("after")))
    got = df.select("url", "ord", "num", text.local_subject(F.col("before"), F.col("after"), F.col("label"))).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300


def test_sentence_cap_lets_each_source_add_one(spark):
    page = " ".join(f"Sentence number {k} tells of {k} people there." for k in range(60))
    df = spark.createDataFrame([("u", page, "Summary says that 12 people came there. Then 13 others followed them on.", "Sentence number 59 tells of 59 people there. And 14 more came much later on.")], "url string, page string, summary string, pdf string")
    got = facts.sentence_rows(df, ["url"]).orderBy("idx").collect()
    assert len(got) == 47 and [r.source for r in got[45:]] == ["summary", "pdf"] and got[46].text.startswith("Sentence number 59")


def test_clean_page(spark):
    got = values(spark, ["Share x Activity Survey Other Survey The text Cite as ", "plain", "Share a Period Covered Jan 1 2015 Feb 2 2015 Text", None], facts.clean_page(F.col("x"), ["Survey", "Other"], "Place"))
    assert got == [("The text",), ("plain",), ("Text",), ("",)]


def test_urls(spark):
    x = F.col("x")
    page = F.lit("https://a.example.org/b/c?q=1")
    assert values(spark, ["d/", "/e;p=1#f", "//h.example.org/x/?y=2", "?z=1", "#top", "https://o.example.org/"], urls.canonical(x, page)) == [("https://a.example.org/b/d",), ("https://a.example.org/e",), ("https://h.example.org/x?y=2",), ("https://a.example.org/b/c?z=1",), ("https://a.example.org/b/c?q=1",), ("https://o.example.org",)]
    assert values(spark, ["/f/a%20b+c.pdf", "/f/%zz"], urls.file_name(x)) == [("a b+c.pdf",), ("%zz",)]


def test_count_by_and_defaults(spark):
    rows = [(1, "a", "2024-03-01", 2024, "C", ["r"], ["Borno", "Yobe"], "u1"), (2, "b", None, None, "C", [], [], "u2")]
    df = spark.createDataFrame(rows, "id long, title string, date string, year int, component string, regions array<string>, states array<string>, url string")
    by = lambda g: {r.key: r.n for r in query.count_by(df, g).collect()}
    assert by("state") == {"total": 2, "(none)": 1, "Borno": 1, "Yobe": 1} and by("year") == {"total": 2, "2024": 1, "None": 1} and by("month") == {"total": 2, "Mar": 1, "(no month)": 1}
    assert query.listed(df, 0).count() == 2


def test_dedupe_is_idempotent_and_stable(spark):
    rows = [("A  b!", "2020-01-01", "u2"), ("a b", "2020-01-01", "u1"), ("a-b", None, "u0"), (None, "2020-01-01", "u9")]
    df = spark.createDataFrame(rows, "title string, date string, url string")
    once = resolve.dedupe_earliest(df)
    assert {r.url for r in once.collect()} == {"u1", "u9"} and resolve.dedupe_earliest(once).count() == once.count()
    assert resolve.dedupe_earliest(df.limit(0)).count() == 0


def test_assert_rollup_raises(spark):
    d = spark.createDataFrame([(1, "a", 2, 1, 0, 0), (1, "b", 3, 1, 0, 0)], "round int, state string, idp_ind long, idp_hh long, ret_ind long, ret_hh long")
    good = spark.createDataFrame([(1, 5, 2, 0, 0)], "round int, idp_ind long, idp_hh long, ret_ind long, ret_hh long")
    reference.assert_rollup(d, good, "round")
    with pytest.raises(ValueError, match="idp_ind"):
        reference.assert_rollup(d, good.withColumn("idp_ind", F.lit(6).cast("long")), "round")


def test_reach_stops_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src long, dst long")
    got = {r.node: r.level for r in discovery.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_taxonomy_file_and_record(spark, tmp_path):
    import json

    spec = {"components": [{"key": "ewer", "label": "Early", "include": ["ewer", "early warning"], "exclude": []}], "regions": {"North": {"aliases": ["north"], "states": ["Aland", "Bland"]}}, "unclassified_label": "Other", "scope_title_regex": "^alpha", "state_patterns": {"_note": "x"}, "mobility_tracking_rounds": {"N": 3}, "needs_monitoring_rounds": {"N": [1, 2]}}
    path = tmp_path / "tax.json"
    path.write_text(json.dumps(spec))
    tax = files.read_taxonomy(spark, str(path))
    assert tax.rounds == {"N": 3} and tax.round_ranges == {"N": (1, 2)} and tax.states == ["Aland", "Bland"]
    df = spark.createDataFrame([("Alpha report Aland (5 May 2015)", "fewer people", "", None, None), ("Beta", "", "", None, None)], "title string, summary string, date_raw string, date string, fetched string")
    r = classify.record(df, tax, "2020-01-01").collect()
    assert len(r) == 1 and (r[0].component_key, r[0].matched_on, r[0].states, r[0].regions, r[0].date, r[0].year) == ("ewer", "summary:ewer", ["Aland"], ["North"], "2015-05-05", 2015)


def test_sinks_and_geometry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a</b>")], "id long, t string")
    files.write_csv(df, str(tmp_path / "csv"))
    files.write_script(df, str(tmp_path / "js"), "window.X")
    read = lambda d, g: next((tmp_path / d).glob(g)).read_text(encoding="utf-8")
    assert read("csv", "*.csv").startswith("\ufeffid,t") and read("js", "*.txt").strip() == 'window.X = [{"id":1,"t":"a<\\/b>"}];'
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"name":"P"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}},{"properties":{"name":"M"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}}]}')
    assert files.geometry_points(spark, str(tmp_path / "g.json")).groupBy("name").count().orderBy("name").collect() == [("M", 6), ("P", 3)]
    (tmp_path / "m.json").write_text('{"/a":{"url":"u","v":2},"/b":{"url":"w"}}')
    assert files.json_map(spark, str(tmp_path / "m.json"), "url string, v int").orderBy("key").collect() == [("/a", "u", 2), ("/b", "w", None)]


def test_streamed_harvest_is_last_write_wins(spark, tmp_path):
    import json

    land, out = tmp_path / "land", str(tmp_path / "table")
    land.mkdir()
    schema = "key string, title string, seq long"
    ran = []
    for k, rows in enumerate([[("a", "1", 1), ("b", "1", 2)], [("a", "2", 3), ("c", None, 4), ("a", "old", 0)]]):
        (land / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("key", "title", "seq"), r))) for r in rows))
        q = harvest.start(spark, str(land), schema, out, str(tmp_path / "cp"), "key", ["seq"], lambda s: ran.append(1))
        q.awaitTermination()
    got = {r.key: r.title for r in spark.read.parquet(out).collect()}
    assert got == {"a": "2", "b": "1", "c": None} and len(ran) == 2
