"""Facets, counts, lists and figures that users ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def facets(components: list[str] = (), years: list[int] = (), months: list[int] = (), regions: list[str] = (), states: list[str] = (), keyword: str = "") -> Column:
    """OR inside a facet, AND between facets; a component is named by key or label; no facet holds for all. For where(): null counts as no."""
    # Cheap conditions first: Catalyst keeps the order, and what they reject isn't classified where the rest is computed.
    out = F.lit(True)
    if years:
        out &= F.col("year").isin(*years)
    if months:
        out &= F.substring("date", 6, 2).try_cast("int").isin(*months)
    if keyword:
        out &= F.contains(F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")))), F.lit(keyword.lower()))
    if components:
        out &= F.coalesce(F.col("component_key").isin(*components), F.lit(False)) | F.coalesce(F.col("component").isin(*components), F.lit(False))
    for name, wanted in (("states", states), ("regions", regions)):
        if wanted:
            out &= F.arrays_overlap(name, F.array(*[F.lit(x) for x in wanted]))
    return out


def count_by(df: DataFrame, group_by: str = "none") -> DataFrame:
    """key, n: total, and reports for each value of a facet; of several values each counts. One pass: the total counts the first
    value of each report, and a rollup sums both."""
    if group_by == "none":
        return df.agg(F.lit("total").alias("key"), F.count("*").alias("n"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("(none)")))
    names = F.array(*[F.lit(m) for m in MONTHS])
    values = {
        "month": F.array(F.coalesce(F.try_element_at(names, F.substring("date", 6, 2).try_cast("int")), F.lit("(no month)"))),
        "year": F.array(F.coalesce(F.col("year").cast("string"), F.lit("None"))),
        "component": F.array(F.col("component")),
        "region": some("regions"),
        "state": some("states"),
    }[group_by]
    sums = df.select(F.posexplode(values).alias("at", "key")).rollup("key").agg(F.count("*").alias("each"), F.count_if(F.col("at") == 0).alias("whole"), F.grouping("key").alias("all"))
    every = F.col("all") == 1
    return sums.select(F.when(every, "total").otherwise(F.col("key")).alias("key"), F.when(every, F.col("whole")).otherwise(F.col("each")).alias("n"))


def listed(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The first reports by rank: 15 unless told, at most 50."""
    return df.orderBy("id").limit(min(limit or 15, 50)).select("id", "title", "date", "component", "url")


def figure_lookup(reports: DataFrame, index: DataFrame, title_words: str = "", keyword: str = "", limit: int | None = None) -> DataFrame:
    """Newest reports whose title has all words and whose text has the keyword in some sentence: figures with their
    sentences (at most 25), sentences with the keyword (at most 15)."""
    both = reports.join(index, F.substring_index(reports["url"], "#", 1) == index["url"]).drop(index["url"])
    return stated(both, title_words, keyword, limit)


def titled(title_words: str) -> Column:
    """Has the title all words?"""
    asked = F.lit(True)
    for w in title_words.lower().split():
        asked &= F.lower("title").contains(w)
    return asked


def stated(both: DataFrame, title_words: str = "", keyword: str = "", limit: int | None = None) -> DataFrame:
    """figure_lookup() over reports that are joined with their sentences s and figures f."""
    asked = titled(title_words)
    hits = F.filter("s", lambda x: F.lower(x).contains(keyword.lower())) if keyword else F.col("s")
    found = both.where(asked).withColumn("sentences", hits).where(F.size("sentences") > 0)
    told = F.slice(F.transform(F.coalesce("f", F.array()), lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value"), F.element_at("s", f["idx"] + 1).alias("sentence"))), 1, 25)
    newest = found.orderBy(F.coalesce("date", F.lit("")).desc(), "id").limit(min(limit or 5, 20))
    return newest.select("title", "date", "url", told.alias("figures"), F.slice("sentences", 1, 15).alias("sentences"))
