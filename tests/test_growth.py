"""Steps that grow with the input: one reading of each text, results equal to the plainer forms."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from reportloom.functions import text as tx
from reportloom.operators import facetindex, facts, lookup
from reportloom.plans import registry
from reportloom.sources import pages as html
from reportloom.sources import pdf, workbook

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matches_take_one_reading(spark):
    for name in ("metric_extract", "metric_reject", "local_subject"):
        assert plan(registry.queries()[name](spark, SF)).count("MapInArrow") == 1


def test_match_rows_equal_expressions(spark):
    random.seed(11)
    words = "1,200 345 12 2019 3 000 45% 12.5 1234 567 678 5 100 1,2345 per households returnees idps ſites wards average fled camps displaced internally persons ٣٤ new arrivals. Ten (The é".split(" ")
    rows = [(str(k), *(random.choice([None, " ".join(random.choices(words, k=random.randint(3, 60)))]) for _ in range(3))) for k in range(200)]
    df = spark.createDataFrame(rows, "url string, page string, summary string, pdf string")
    hits = facts.metric_matches(facts.sentence_rows(df, ["url"]))
    counts = facts.is_count(F.col("before"), F.col("num"), F.col("noun"), F.col("after"))
    want = hits.select("url", "idx", "ord", "label", "pos", "num", counts, tx.local_subject(F.col("before"), F.col("after"), F.col("label"))).collect()
    got = facts.match_rows(df, ["url"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 200


def test_sentences_that_differ_in_digits_share_what_is_found():
    search = facts.Searched(tx.METRICS)
    a, b = ([tuple(x) for x in search.told(f"The flood affected {n} individuals in {m} camps.")] for n, m in (("1,234", "1900"), ("5,678", "2899")))
    assert len(search.kept) == 1 and [x[3:5] for x in a] == [("1,234", True), ("1900", False)] and [x[3:5] for x in b] == [("5,678", True), ("2899", True)]


def test_bitmaps_are_made_without_rows_by_value(spark):
    found = facetindex.build(spark.createDataFrame([(1, "a", "b", None, None, ["x", "x"], None)], "id long, component_key string, component string, date string, year int, regions array<string>, states array<string>"))
    assert "Generate" not in plan(found) and found.count() == 8


def test_plain_pages_are_read_as_the_parser_reads_them():
    parts = ["<p>", "</p>", "<h1>", "</h1>", '<a href="/x" rel="next">', "</a>", "<br/>", '<div class="pager">', "</div>", "text ", "a & b ", "&amp;x", "&lt", "<title>", "</title>", "<script>", "</script>", "<!-- c -->", "<!DOCTYPE html>", "<", '<time datetime="2">', "<A HREF=\"/y?a=1&amp;b\">", "</li >", '<meta name="description" content="d">', "<textarea>", "<a href='z'>"]
    random.seed(3)
    plain = 0
    for _ in range(3000):
        source = "".join(random.choices(parts, k=random.randint(0, 12)))
        page = html._Page()
        page.feed(source)
        while page.open:
            page.close(page.open[-1][0])
        assert html._parse(source) == {name: of(page) for name, of in html._FIELDS.items()}
        plain += html._plain(source) is not None
    assert plain > 500


def test_headings_decode_what_their_sql_decodes(spark, tmp_path):
    import duckdb

    rows = [(k, "https://a", x) for k, x in enumerate(["<h1>a &amp;&nbsp; b &quot;c&quot; &amp</h1>", "<h1> x\ny </h1>", '<title>t</title><h1 id="a">b</h1>', "", None, "<h1></h1><h1>two</h1>", "<h1>a\r b\u000bc</h1>"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.queries()["html_title"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()["html_title"]).fetchall())


def test_pages_are_read_few_at_a_time(spark):
    df = spark.range(0, 1000, 1, 1).selectExpr("id", "'<a href=\"/x\">y</a>' AS html")
    got = html.parsed(df, "id", fields=("links",))
    assert got.schema["p"].dataType.names == ["links"] and got.where("p.links[0].href = '/x'").count() == 1000
    assert "ArrowEvalPython" not in plan(got)


def test_postings_are_made_without_rows_by_piece():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 32769]), pa.array(["ab", "abc"]), pa.array([f"xyz{lookup.CUT}yz", "wxyz"])], ["id", "title", "text"])
    got = {(r["kind"], r["piece"], r["bucket"]) for out in lookup._postings(iter([batch])) for r in out.to_pylist()}
    assert got == {("title", "abc", 2), ("text", "xyz", 1), ("text", "wxy", 2), ("text", "xyz", 2)}


def test_a_sheet_is_written_for_one_reader(spark, tmp_path):
    df = spark.range(0, workbook.PART_ROWS + 5, 1, 1).selectExpr("id AS n", "IF(id % 3 = 0, NULL, concat('s<', id % 7)) AS s")
    folder = f"file://{tmp_path}/books"
    assert workbook.write_workbooks(df, folder, "S") == 2
    assert len(workbook.WorkbookReader({"path": folder}).partitions()) == 2
    back = workbook.sheet(spark, folder, "S", "n long, s string")
    assert back.exceptAll(df).count() == 0 and back.count() == workbook.PART_ROWS + 5


def test_files_are_made_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100))], ["n"])
    assert [x.num_rows for x in pdf.slices(iter([batch]))] == [32, 32, 32, 4]
