"""Runs from discovery through publication over a small site; buckets of the harvest table."""

import pytest
from pyspark.sql import functions as F
from reportloom.operators import resolve
from reportloom.operators.classify import Region, Rule, Taxonomy
from reportloom.plans import harvest as whole
from reportloom.plans.views import pdf_of
from reportloom.sources import files
from reportloom.streaming import harvest

H = "https://h.org"
CONFIG = {"base_url": H, "report_path": "/reports/", "report_slug_must_contain": "nigeria", "publisher": "Press (P),", "seeds": [f"{H}/list"], "sitemaps": [f"{H}/sitemap.xml"], "keyword_search_templates": [f"{H}/search?q={{q}}"], "keywords": ["flood"], "max_listing_pages": 9}
TAX = Taxonomy(
    rules=[Rule("needs", "Needs", ["needs"]), Rule("atlas", "Atlas", ["round report"]), Rule("mt_dash", "Round files", ["dashboard"])],
    regions=[Region("East", ["east"], ["Borno"])], round_ranges={"E": (50, 60)},
)
ROUNDS = resolve.Rounds(stop="flash", products=["displacement report"], positive="round report", negative="list", preferred="displacement dashboard", zone="west", inside="W", outside="E", zones={"E": ["East"], "W": []}, dash_label="Round files")


def report(title, day, more=""):
    return f'<html><body><h1>{title}</h1><p>{title} of many people who were seen in 12 camps and 30 locations of Borno this week. Press (P), {day}</p>{more}</body></html>'


LANDED = [
    ("/sitemap.xml", f"<s><loc>{H}/sitemap2.xml</loc><loc>{H}/reports/nigeria-one</loc><loc>{H}/about</loc></s>"),
    ("/sitemap2.xml", f"<s><loc>{H}/reports/nigeria-two?x=1</loc><loc>{H}/reports/elsewhere</loc></s>"),
    ("/lost.xml", f"<s><loc>{H}/reports/nigeria-lost</loc></s>"),
    ("/list", '<a href="?page=1">2</a><article><a href="reports/../reports/nigeria-three">Third report of the round</a> 5 May 2020</article>'),
    ("/list?page=1", '<li><a href="/reports/nigeria-four">Fourth report, not landed yet</a> 6 May 2020</li>'),
    ("/search?q=flood", '<a rel="next" href="/reports/nigeria-two">x</a><a href="/reports/nigeria-five">Fifth report found by a word</a>'),
    ("/reports/nigeria-one", report("Round report Round 1 Borno", "May 1, 2020", '<a href="/sites/g/files/one.pdf">f</a>')),
    ("/reports/nigeria-two", report("Round report Round 2 Borno", "May 2, 2020", '<a href="/sites/g/files/Atlas-2.pdf">f</a>')),
    ("/reports/nigeria-three", report("", "May 3, 2020")),
    ("/reports/nigeria-five", report("A note", "May 5, 2020")),
]


def landed(spark, rows=LANDED):
    return spark.createDataFrame([(H + u, x) for u, x in rows], "url string, html string")


def documents(spark):
    rows = [(f"{H}/sites/g/files/one.pdf", pdf_of("Needs Monitoring of all in 77 camps of the state.", 1)), (f"{H}/sites/g/files/Atlas-2.pdf", b"broken")]
    return spark.createDataFrame(rows, "path string, content binary")


def test_runs(spark, tmp_path):
    site, table, root = whole.Settings.of(CONFIG), str(tmp_path / "cache"), f"file://{tmp_path}/out"
    go = lambda day, rows=LANDED, last=None, **flags: whole.harvested(spark, landed(spark, rows), table, site, TAX, ROUNDS, f"{day}T00:00:00Z", f"{root}/{day}", whole.Flags(**flags), documents(spark), last, root)
    first = go("2020-06-01")
    got = {r.url.rpartition("-")[2]: r for r in first.reports.collect()}
    assert set(got) == {"one", "two", "three", "four", "five"}
    assert got["three"].title == "Third report of the round" and got["four"].title == "Fourth report, not landed yet" and str(got["four"].date) == "2020-05-06"
    # What the document of the first says decides its kind, the second's name its own.
    assert got["one"].component_key == "needs" and "Needs Monitoring" in got["one"].matched_on and got["two"].component_key == "atlas"
    assert {(r.value, r.source) for r in first.figures.where("source = 'pdf'").collect()} == {(77, "pdf")}
    cache = {r.key: r for r in spark.read.parquet(table).collect()}
    assert cache["/reports/nigeria-two"].pdf_text.text == "" and cache["/reports/nigeria-four"].from_listing_only
    # A quick run sees new listing links alone; what has landed meanwhile isn't new, and other pages stay.
    more = [*LANDED[:3], ("/list", LANDED[3][1] + '<a href="/reports/nigeria-six">Sixth report of another day</a>'), *LANDED[4:], ("/reports/nigeria-six", report("Another note", "May 6, 2020")), ("/reports/nigeria-lost", report("Lost", "May 9, 2020"))]
    quick = go("2020-06-02", more, files.current(spark, root), quick=True)
    assert [r.url for r in quick.additions.collect()] == [f"{H}/reports/nigeria-six"] and quick.reports.count() == 6
    assert {r.key.rpartition("-")[2]: r.fetched for r in spark.read.parquet(table).collect()}["one"] == "2020-06-01"
    # Weeks later a full run reads stale pages again and finds a corrected title.
    corrected = [(u, x.replace("A note", "A corrected note")) for u, x in more]
    later = go("2020-07-01", corrected, files.current(spark, root))
    assert later.changed and "A corrected note" in {r.title for r in later.reports.collect()}
    again = {r.key.rpartition("-")[2]: r for r in spark.read.parquet(table).collect()}
    assert again["one"].fetched == "2020-07-01" and again["one"].pdf_check.kind == "needs" and again["four"].from_listing_only
    fresh = go("2020-07-02", corrected, None, refresh=True, sitemap=False, keywords=[], most=2)
    assert fresh.reports.count() == 2 and spark.read.parquet(table).count() == 2
    with pytest.raises(ValueError, match="No report pages"):
        go("2020-07-03", [("/about", "x")], None)


def test_buckets_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(harvest, "ROWS", 10)
    path, frame = str(tmp_path / "t"), lambda a, b, seq: spark.range(a, b).selectExpr("CAST(id AS STRING) AS key", f"{seq}L AS seq")
    harvest.upsert(spark, frame(0, 95, 1), path, "key", ["seq"])
    assert harvest.bucket_count(spark, path, 0) == 10
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    harvest.upsert(spark, frame(3, 4, 2), path, "key", ["seq"])
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    assert len(before.items() & after.items()) == len(before) - 1  # one bucket was written
    harvest.upsert(spark, frame(50, 600, 3), path, "key", ["seq"])
    assert harvest.rebucket(spark, path, "key") == 60 == harvest.bucket_count(spark, path, 0) and harvest.rebucket(spark, path, "key") == 60
    harvest.upsert(spark, frame(599, 601, 4), path, "key", ["seq"])
    got = {r.key: r.seq for r in spark.read.parquet(path).collect()}
    assert got == {str(k): 4 if k >= 599 else 3 if k >= 50 else 2 if k == 3 else 1 for k in range(601)}
    (tmp_path / "t").rename(tmp_path / "t.old")  # stopped between two renames
    harvest.upsert(spark, frame(0, 1, 5), path, "key", ["seq"])
    assert spark.read.parquet(path).count() == 601 and spark.read.parquet(path).where(F.col("key") == "0").first()["seq"] == 5
