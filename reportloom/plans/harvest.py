"""One run from discovery through publication, over what has landed.

Fetching is not done here: pages, listings and sitemaps are read from a table landed (url, html), documents from one of (path, content),
path being the address. A run discovers report addresses from sitemaps, listings and keyword searches, chooses which pages to read,
parses them, merges them into the cache table, reads documents, and publishes (plans.run). A page that is wanted and hasn't landed keeps what
its listing said of it. Only lists that the settings bound come to the driver: seeds, keywords, and the listing pages that are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, rounds, urls
from ..operators import classify, discovery, resolve
from ..sources import pages as html
from ..sources import pdf
from ..streaming import harvest
from .run import Run, run

#: Version of the records that parsing makes; days after which a page is read again; pages and characters of documents' texts.
VERSION = 3
STALE_DAYS = 21
KIND_PAGES, TEXT_PAGES, TEXT_CHARS = 6, 4, 9000
NO_PAGES = "No report pages could be reached; what was published is left as it was."


@dataclass
class Settings:
    """What a site's addresses look like and what a run reads, from files.read_config(); a run's own flags are given beside it."""

    base: str
    folder: str
    word: str
    publisher: str
    seeds: list[str]
    sitemaps: list[str]
    templates: list[str]
    keywords: list[str]
    listing_pages: int = 400
    documents: int = 300

    @classmethod
    def of(cls, config: dict) -> Settings:
        get = config.get
        return cls(config["base_url"], config["report_path"], config["report_slug_must_contain"], get("publisher", ""), config["seeds"], get("sitemaps", []), get("keyword_search_templates", []), get("keywords", []), get("max_listing_pages", 400), get("pdf_text_per_full_run", 300))

    def is_report(self, url: Column) -> Column:
        return urls.is_report(url, self.base.partition("://")[2].partition("/")[0], self.folder, self.word)


@dataclass
class Flags:
    """keywords replace those of the settings; quick reads the newest listing pages alone; refresh forgets the cache; most caps the pages read."""

    keywords: list[str] | None = None
    sitemap: bool = True
    listings: bool = True
    refresh: bool = False
    quick: bool = False
    most: int | None = None


def plain(url: Column) -> Column:
    """An address without its query."""
    return F.split_part(url, F.lit("?"), F.lit(1))


def from_sitemaps(landed: DataFrame, site: Settings) -> DataFrame:
    """url of the reports that the sitemaps name, and those that they lead to."""
    spark = landed.sparkSession
    named = landed.where(F.col("html").contains("<loc>")).select(F.col("url").alias("src"), F.explode(discovery.locations(F.col("html"))).alias("dst"))
    further = discovery.is_sitemap(F.col("dst"))
    seeds = spark.createDataFrame([(u,) for u in site.sitemaps], "node string")
    read = discovery.reachable(named.where(further), seeds).select(F.col("node").alias("src"))
    found = named.where(~further & site.is_report(F.col("dst"))).join(read, "src", "left_semi")
    return found.select(plain(urls.canonical(F.col("dst"), F.col("dst"))).alias("url")).distinct()


def from_listings(listings: DataFrame, site: Settings, seeds: list[str], limit: int) -> DataFrame:
    """key, url, ord, text, blob of each link to a report on the listing pages that are read. listings: url and p of parsed pages."""
    paged = listings.select("url", html.pagers(F.col("url"), site.is_report).alias("pagers"))
    read = discovery.listed_pages(paged, seeds, limit)
    links = listings.join(read, "url").select("url", "place", F.posexplode("p.links").alias("n", "x"))
    found = links.withColumn("to", urls.canonical(F.col("x.href"), F.col("url"))).where(site.is_report(F.col("to")))
    return found.select(urls.report_key(F.col("to")).alias("key"), plain(F.col("to")).alias("url"), F.struct("place", "n").alias("ord"), F.col("x.text").alias("text"), F.col("x.blob").alias("blob"))


def discovered(landed: DataFrame, site: Settings, flags: Flags) -> tuple[DataFrame, DataFrame]:
    """(url of each report found; what listings said of reports: key, title, date_raw)."""
    limits = discovery.quick_limits(site.seeds, site.listing_pages, flags.quick)
    keywords = (site.keywords if flags.keywords is None else flags.keywords) if limits["keywords"] else []
    listings = discovery.cut(html.parsed(landed.where(~site.is_report(F.col("url"))), "url"))
    links = [from_listings(listings, site, site.seeds, limits["listing_pages"])] if flags.listings else []
    for word in keywords:  # as many as a user types
        spark = landed.sparkSession
        asked = discovery.keyword_seeds(spark.createDataFrame([(t,) for t in site.templates], "template string"), spark.createDataFrame([(word,)], "keyword string"))
        links.append(from_listings(listings, site, sorted(r["url"] for r in asked.collect()), limits["listing_pages"]))
    nothing = from_listings(listings.limit(0), site, [], 0)
    every = reduce(DataFrame.unionByName, links, nothing)
    found = every.select("url")
    if flags.sitemap and limits["sitemaps"]:
        found = found.unionByName(from_sitemaps(landed, site))
    return discovery.cut(found.distinct()), discovery.first_hints(every)


def wanted(found: DataFrame, cache: DataFrame | None, flags: Flags, today: str) -> DataFrame:
    """url of the pages that this run reads: new ones, records of older versions and, unless it is quick, the stalest."""
    keyed = found.select(urls.report_key(F.col("url")).alias("key"), "url")
    todo = keyed.select("url")
    if cache is not None:
        todo = discovery.unseen(keyed, cache, "key").select("url").unionByName(discovery.to_upgrade(cache, VERSION).select("url"))
        if not flags.quick:
            todo = todo.unionByName(discovery.stale(cache, _days_before(today, STALE_DAYS)).select("url"))
    todo = todo.distinct()
    return discovery.first_by_url(todo, flags.most) if flags.most else todo


def _days_before(day: str, n: int) -> str:
    import datetime

    return (datetime.date.fromisoformat(day) - datetime.timedelta(days=n)).isoformat()


def records(todo: DataFrame, landed: DataFrame, hints: DataFrame, site: Settings, today: str) -> DataFrame:
    """What is kept of the pages: parsed where they have landed, else what a listing said of them."""
    source = todo.join(landed.select("url", "html"), "url", "left").where("html IS NOT NULL")
    read = html.parsed(source, "url", "html").withColumn("f", html.files(F.col("html"), F.col("url")))
    told = html.date_raw(site.publisher)
    made = read.select("url", html.title().alias("title"), told.alias("date_raw"), dates.parse_date(told).alias("date"), html.summary().alias("summary"), html.series().alias("series"), html.first_pdf(F.col("f")).alias("pdf"), html.attached(F.col("f")).alias("files"), html.body(site.publisher).alias("body"), F.lit(False).alias("from_listing_only"))
    keyed = made.withColumn("key", urls.report_key(F.col("url")))
    # A title that a page lacks, and pages that haven't landed.
    filled = keyed.join(hints.select("key", F.col("title").alias("_t"), F.col("date_raw").alias("_d")), "key", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    filled = filled.withColumn("title", F.when(blank("title"), F.coalesce("_t", F.lit(""))).otherwise(F.col("title"))).withColumn("date_raw", F.when(blank("date_raw"), F.coalesce("_d", F.lit(""))).otherwise(F.col("date_raw"))).drop("_t", "_d")
    missing = todo.join(landed.select("url"), "url", "left_anti").withColumn("key", urls.report_key(F.col("url"))).join(hints, "key")
    only = missing.select("key", "url", "title", "date_raw", dates.parse_date(F.col("date_raw")).alias("date"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("series"), F.lit("").alias("pdf"), F.array().cast("array<string>").alias("files"), F.lit("").alias("body"), F.lit(True).alias("from_listing_only"))
    return filled.unionByName(only).withColumn("fetched", F.lit(today)).withColumn("v", F.lit(VERSION))


def with_documents(cache: DataFrame, documents: DataFrame | None, site: Settings, tax: classify.Taxonomy, told: resolve.Rounds, quick: bool) -> DataFrame:
    """The cache with pdf_check and pdf_text: documents of undecided round reports are looked into, and the newest unread ones are read."""
    kinds = "struct<kind:string,evidence:string>", "struct<file:string,text:string>"
    for name, kind in zip(("pdf_check", "pdf_text"), kinds):
        if name not in cache.columns:
            cache = cache.withColumn(name, F.lit(None).cast(kind))
    if documents is None:
        return cache
    first = F.try_element_at(F.filter("files", lambda f: F.lower(f).endswith(".pdf")), F.lit(1))
    numbered = cache.withColumn("role", F.when(rounds.is_main(F.col("title"), told.positive, told.negative), "main")).withColumn("round", rounds.round_number(F.col("title"), told.stop, told.products)).withColumn("round_zone", rounds.zone(F.col("title"), told.zone, told.inside, told.outside))
    ranges = cache.sparkSession.createDataFrame([(z, a, b) for z, (a, b) in tax.round_ranges.items()], "zone string, lo int, hi int")
    check = discovery.undecided(resolve.in_range(numbered, ranges)).select("key", first.alias("path"))
    budget = discovery.quick_limits(site.seeds, quick=quick)["pdf_budget"] if quick else site.documents
    todo = cache.select("key", "date", first.alias("file"), (F.col("pdf_text.file") == first).alias("done")).where("file IS NOT NULL")
    read = discovery.budgeted(todo, budget).select("key", F.col("file").alias("path"))
    looked = pdf.texts(documents.join(check, "path", "left_semi"), KIND_PAGES).select("path", classify.document_kind(F.col("text")).alias("k"))
    texts = pdf.texts(documents.join(read, "path", "left_semi"), TEXT_PAGES).select("path", F.left(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")), F.lit(TEXT_CHARS)).alias("t"))
    kept = check.join(looked, "path").select("key", F.col("k").alias("_check"))
    said = read.join(texts, "path", "left").select("key", F.struct(F.col("path").alias("file"), F.coalesce("t", F.lit("")).alias("text")).alias("_text"))
    out = cache.join(kept, "key", "left").join(said, "key", "left")
    return out.withColumn("pdf_check", F.coalesce("_check", "pdf_check")).withColumn("pdf_text", F.coalesce("_text", "pdf_text")).drop("_check", "_text")


def harvested(spark: SparkSession, landed: DataFrame, cache_path: str, site: Settings, tax: classify.Taxonomy, told: resolve.Rounds, now: str, out: str | None = None, flags: Flags | None = None, documents: DataFrame | None = None, last: str | None = None, root: str | None = None) -> Run:
    """The whole run; ValueError, with all left as it was, if no report is found at all."""
    flags = flags or Flags()
    today, at = now[:10], harvest._Folder(spark, cache_path)
    cache = spark.read.parquet(cache_path).drop("bucket") if at.exists() and not flags.refresh else None
    found, hints = discovered(landed, site, flags)
    hints = discovery.cut(hints)
    if found.isEmpty():
        raise ValueError(NO_PAGES)
    new = records(wanted(found, cache, flags, today), landed, hints, site, today)
    if cache is not None:
        # What an earlier run read of a page's documents stays with the page.
        new = new.join(cache.select("key", "pdf_check", "pdf_text"), "key", "left")
        both = new.unionByName(cache.join(new.select("key"), "key", "left_anti").select(*new.columns))
    else:
        both = new
    whole = discovery.cut(with_documents(both, documents, site, tax, told, flags.quick).withColumn("at", F.lit(now)))
    if flags.refresh and at.exists():
        at.fs.delete(at.at(), True)
    changed = whole if cache is None else whole.join(cache.withColumn("_row", F.struct(*[c for c in cache.columns if c != "at"])).select("key", "_row"), "key", "left").where(~F.col("_row").eqNullSafe(F.struct(*[c for c in cache.columns if c != "at"]))).select(*whole.columns)
    harvest.upsert(spark, changed, cache_path, "key", ["at"])
    return run(whole.drop("key", "at", "from_listing_only"), tax, told, today, now, out, last, root=root)
