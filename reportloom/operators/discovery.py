"""Link graphs and work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """node, level: breadth first from the seeds over (src, dst), until no new node is found, or for depth levels where a depth is
    given. A level's frontier is joined with the edges; what has been seen is left out. Levels are few, so the driver only counts.
    Each level is checkpointed; without a checkpoint folder (local runs) it is kept in memory until the next one is made."""
    seen = seeds.select("node").distinct().withColumn("level", F.lit(0))
    frontier, level = seen.select("node"), 0
    while depth is None or level < depth:
        level += 1
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen.select("node"), "node", "left_anti"))
        if new.isEmpty():
            break
        frontier = new
        seen = cut(seen.unionByName(frontier.withColumn("level", F.lit(level))))
    return seen


def listed_pages(pages: DataFrame, seeds: list[str], limit: int = 400) -> DataFrame:
    """url, place of the listing pages that are read: the seeds, then what they lead to in the order of the queue, a page's pagers by their
    page number, until limit pages are read. pages: url, pagers (array of addresses) of each page that can be read; a page that
    is missing is read as empty. The limit is the feature: the queue holds at most the limit's pages and their pagers, and each
    round looks up the pages that stand in it at once, so that rounds follow the depth, not the number, of pages."""
    from ..functions.urls import page_number

    spark = pages.sparkSession
    known: dict[str, list[str]] = {}
    seen: list[str] = []
    queue, done = list(seeds), set()
    while queue and len(seen) < limit:
        asked = [u for u in dict.fromkeys(queue) if u not in known][:limit]
        if asked:
            wanted = spark.createDataFrame([(u,) for u in asked], "url string")
            sorted_pagers = F.transform(F.array_sort(F.transform(F.array_distinct("pagers"), lambda p: F.struct(page_number(p).alias("n"), p.alias("p")))), lambda x: x["p"])
            known |= dict.fromkeys(asked, []) | {x["url"]: x["pagers"] or [] for x in pages.join(F.broadcast(wanted), "url").select("url", sorted_pagers.alias("pagers")).collect()}
        while queue and len(seen) < limit and (queue[0] in done or queue[0] in known):
            url = queue.pop(0)
            if url in done:
                continue
            done.add(url)
            seen.append(url)
            queue += [p for p in known[url] if p not in done]
    return spark.createDataFrame([(u, k) for k, u in enumerate(seen)], "url string, place int")


def quick_limits(seeds: list[str], full: int = 400, quick: bool = False) -> dict[str, object]:
    """What a run reads: a quick one only the newest listing pages (three for each seed), no sitemaps and no keyword searches."""
    return {"sitemaps": not quick, "keywords": not quick, "listing_pages": 3 * len(seeds) if quick else full, "pdf_budget": 40 if quick else 300, "stale": not quick}


def first_by_url(todo: DataFrame, limit: int) -> DataFrame:
    """The first addresses of a work list in their order."""
    return todo.orderBy("url").limit(limit)


def undecided(rounds: DataFrame) -> DataFrame:
    """Main round reports whose kind neither a range rule, a file name nor an earlier look into the document has told: their documents
    are to be read. Columns role, ruled, files, pdf_check."""
    from ..functions.urls import file_name
    from .resolve import ATLAS_FILE, NEEDS_FILE

    pdf = lambda f: F.lower(f).endswith(".pdf")
    named = F.exists("files", lambda f: pdf(f) & (F.concat(F.lit(" "), file_name(f)).rlike(NEEDS_FILE) | file_name(f).rlike(ATLAS_FILE)))
    some = F.exists("files", pdf)
    return rounds.where((F.col("role") == "main") & ~F.coalesce("ruled", F.lit(False)) & F.coalesce(some, F.lit(False)) & ~F.coalesce(named, F.lit(False)) & F.col("pdf_check").isNull())


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the checkpoint folder, where the session has one; else keep the rows in memory and on disk."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist()


def locations(xml: Column) -> Column:
    """Addresses of a sitemap's loc elements."""
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def is_sitemap(loc: Column) -> Column:
    return loc.endswith(".xml") | (loc.contains("sitemap") & loc.contains("page="))


def first_hints(links: DataFrame) -> DataFrame:
    """key, title, date_raw: of each report the first link with a useful text (over 15 characters, not cut off)."""
    good = links.where((F.length("text") > 15) & ~F.col("text").endswith("…"))
    return good.groupBy("key").agg(F.min(F.struct("ord", "text", F.substring("blob", 1, 400).alias("blob"))).alias("h")).select("key", F.col("h.text").alias("title"), F.col("h.blob").alias("date_raw"))


def keyword_seeds(templates: DataFrame, keywords: DataFrame) -> DataFrame:
    """url of each template with each keyword. Templates are a small list; Catalyst broadcasts them while they are."""
    coded = F.replace(F.replace(F.url_encode("keyword"), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return keywords.crossJoin(templates).select(F.replace("template", F.lit("{q}"), coded).alias("url"))


def union_all(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def unseen(found: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return found.join(cached.select(key).distinct(), key, "left_anti")


def to_upgrade(cache: DataFrame, version: int = 3) -> DataFrame:
    """Records of an older version that are no mere listing entries."""
    return cache.where((F.coalesce("v", F.lit(1)) < version) & ~F.coalesce("from_listing_only", F.lit(False)))


def stale(cache: DataFrame, before: str, limit: int = 100) -> DataFrame:
    """The oldest records read before a day."""
    return cache.where(~F.coalesce("from_listing_only", F.lit(False))).withColumn("_f", F.coalesce("fetched", F.lit("0000"))).where(F.col("_f") < before).orderBy("_f", "url").limit(limit).drop("_f")


def budgeted(files: DataFrame, budget: int) -> DataFrame:
    """Files to read next: newest first, those already read left out."""
    return files.where(~F.coalesce("done", F.lit(False))).orderBy(F.coalesce("date", F.lit("")).desc(), F.col("key").desc(), F.col("file").desc()).limit(budget)
