"""Pivot, change detection, counters and published forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_by_year(df: DataFrame, years: list[int] | None = None, label: str = "component", year: str = "year") -> DataFrame:
    """Dated rows counted by label and year, zero where there are none, with their total; years: by default all that occur, in order."""
    if years is None:
        years = sorted(r[year] for r in df.where(F.col(year) != 0).select(year).distinct().collect())
    counts = df.where(F.col(year).isin(*years)).groupBy(label).pivot(year, years).agg(F.count(F.lit(1))).na.fill(0)
    return counts.select(label, *[F.col(str(y)) for y in years], sum((F.col(str(y)) for y in years), F.lit(0)).alias("total"))


def changed_rows(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (with their multiplicity) of either snapshot that the other lacks; empty: nothing changed."""
    a, b = old.select(*columns), new.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


#: Buckets of keys whose digests are kept with a snapshot.
DIGESTS = 1024


def digest_bucket(key: str = "url") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(DIGESTS)).cast("int")


def digests(df: DataFrame, columns: list[str], key: str = "url") -> DataFrame:
    """bucket, n, a, b: for each bucket of keys the number of rows and two sums of their 64-bit hashes. Sums don't depend on the order of rows
    and count each as often as it stands, so equal multisets have equal digests, and unlike ones equal digests with a
    probability of about 2^-128. Partial sums are formed before the shuffle: a few numbers a task and bucket."""
    # Each column is hashed with the names around it as text, since hashes pass over nulls.
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    total = lambda x: F.sum(F.xxhash64(F.lit(x), row).cast("decimal(20,0)")).cast("string")
    return df.groupBy(digest_bucket(key).alias("bucket")).agg(F.count("*").alias("n"), total(0).alias("a"), total(1).alias("b"))


def changed_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """bucket of each pair of digests() that differs; a bucket that one side lacks differs."""
    both = old.select("bucket", F.struct("n", "a", "b").alias("o")).join(new.select("bucket", F.struct("n", "a", "b").alias("w")), "bucket", "full")
    return both.where(~F.col("o").eqNullSafe(F.col("w"))).select("bucket")


def changed_rows_of(old: DataFrame, new: DataFrame, columns: list[str], old_digests: DataFrame, new_digests: DataFrame, key: str = "url") -> DataFrame:
    """changed_rows(), where only rows of buckets whose digests differ are compared; equal snapshots aren't read at all."""
    differ = [r["bucket"] for r in changed_buckets(old_digests, new_digests).collect()]  # at most DIGESTS
    if not differ:
        return changed_rows(old.limit(0), new.limit(0), columns)
    inside = digest_bucket(key).isin(differ) if len(differ) < DIGESTS else F.lit(True)
    return changed_rows(old.where(inside), new.where(inside), columns)


def additions(old: DataFrame, new: DataFrame, limit: int = 50, key: str = "url") -> DataFrame:
    """The first rows by rank whose key the old snapshot lacks; none without an old snapshot."""
    return new.join(old.select(key).distinct(), key, "left_anti").orderBy("id").limit(limit)


def additions_or_last(old: DataFrame, new: DataFrame, last: DataFrame, limit: int = 50, key: str = "url") -> DataFrame:
    """The new additions, or the list published last where there are none; both are at most a page of rows."""
    fresh = additions(old, new, limit, key).select(*last.columns)
    return fresh.unionByName(last.join(fresh.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left").where("_any IS NULL").drop("_any"))


#: Columns whose change makes a new publication.
FINGERPRINT = ("url", "title", "date", "component_key", "regions", "states", "round", "round_zone", "mt_main", "matched_on", "date_basis", "period_date", "pdf")


def status_row(old: DataFrame | None, new: DataFrame, last_changed: str | None, now: str, seconds: float | None = None, columns: tuple[str, ...] = FINGERPRINT, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row: checked_at, last_changed, count, changed_this_run, new_this_run, crawl_seconds. Without an old snapshot all is changed
    and nothing new; where nothing changed, last_changed is that of the last run. With kept, the digests() of both snapshots, rows aren't compared."""
    total = new.agg(F.count("*").alias("count"))
    if old is None:
        found = total.select("*", F.lit(True).alias("changed_this_run"), F.lit(0).cast("long").alias("new_this_run"))
    else:
        differ = (changed_buckets(*kept) if kept else changed_rows(old, new, list(columns))).agg((F.count("*") > 0).alias("changed_this_run"))
        fresh = additions(old, new).agg(F.count("*").alias("new_this_run"))
        found = total.crossJoin(differ).crossJoin(fresh)  # one row each
    since = F.when(F.col("changed_this_run"), F.lit(now)).otherwise(F.coalesce(F.lit(last_changed), F.lit(now)))
    return found.select(F.lit(now).alias("checked_at"), since.alias("last_changed"), "count", "changed_this_run", "new_this_run", F.lit(seconds).cast("double").alias("crawl_seconds"))


def joined(c: Column) -> Column:
    return F.array_join(c, "; ")


def csv_rows(df: DataFrame) -> DataFrame:
    """The columns of the published list, lists joined."""
    return df.select("id", "year", "date", "component", joined(F.col("regions")).alias("regions"), joined(F.col("states")).alias("states"), "title", "url", "pdf", "matched_on")


def counters(df: DataFrame, scoped: Column, unclassified: Column, key: Column, figures: DataFrame | None = None) -> DataFrame:
    """One row: rows skipped by scope, duplicates among the rest, rows that no rule matched; with figures, their number and that
    of the reports that have some."""
    kept = F.when(scoped, key)
    if figures is not None:
        told = figures.agg(F.count("*").alias("figures"), F.count_distinct("url").alias("reports_with_figures"))
        return counters(df, scoped, unclassified, key).crossJoin(told)  # one row each
    return df.agg(F.count_if(~scoped).alias("skipped"), (F.count(kept) - F.count_distinct(kept)).alias("dupes"), F.count_if(scoped & unclassified).alias("unclassified"))
