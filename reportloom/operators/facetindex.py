"""An index of facets: for each value of a facet, bitmaps of the ranks of the reports that have it.

A bitmap holds 32,768 ranks, one row of 4 kB for each value and bucket of ranks that has some, so that a filter is OR of the wanted
values inside a facet and AND between facets, bucket by bucket, and a count is a population count: no report is read again. Facets
with many values have many rows but each report is in few of them; buckets are as many as reports / 32,768, and all steps are
aggregates by bucket with partial results before the shuffle.

Columns of the reports: id (rank from 1, each once), url, component_key, component, date, year, regions, states. A null component,
year or date and empty or null regions and states are values of their own, under the names that counts show.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import MONTHS

#: Values of reports that lack one.
NO_YEAR, NO_MONTH, NONE = "None", "(no month)", "(none)"

#: Ranks of a bitmap, as Spark's bitmap functions have them, and bitmaps that a task holds.
BITS = 32768
HELD = 8192


def build(reports: DataFrame) -> DataFrame:
    """facet, value, bucket, bits."""
    month = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.substring("date", 6, 2).try_cast("int") - 1)
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(NONE)))
    facets = {
        "all": F.array(F.lit("total")),
        "component": F.array(F.col("component")),
        # Filters name a component by key or label; what is both is one value.
        "named": F.array_distinct(F.array_compact(F.array("component_key", "component"))),
        "year": F.array(F.coalesce(F.col("year").cast("string"), F.lit(NO_YEAR))),
        "month": F.array(F.coalesce(month, F.lit(NO_MONTH))),
        "region": F.array_distinct(some("regions")),
        "state": F.array_distinct(some("states")),
    }
    found = reports.select("id", *[v.alias(f) for f, v in facets.items()]).mapInArrow(_bitmaps(list(facets)), "facet string, value string, bucket long, bits binary")
    return found.groupBy("facet", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _bitmaps(facets: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part of the bitmaps: bits are set in numpy, so that neither a row for each report and value is made nor are such rows sorted,
    which bitmaps as aggregates of binary values ask for. At most HELD bitmaps are in memory; what is put out early is joined by OR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = list(zip(*held)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64())
            columns = [*map(pa.array, keys, kinds), pa.array([x.tobytes() for x in held.values()], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["facet", "value", "bucket", "bits"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) - 1
            for facet, lists in zip(facets, batch.columns[1:]):
                values = lists.flatten().dictionary_encode()
                at = ids[lists.value_parent_indices().to_numpy(zero_copy_only=False)]
                codes = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                # Runs of one value and bucket.
                order = np.lexsort((at, codes))
                codes, at = codes[order], at[order]
                starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (at[1:] // BITS != at[:-1] // BITS)]) if len(at) else []
                for a, b in zip(starts, [*starts[1:], len(at)]):
                    bucket = int(at[a] // BITS)
                    key = (facet, values.dictionary[int(codes[a])].as_py() if codes[a] >= 0 else None, bucket + 1)
                    bits = held.setdefault(key, np.zeros(BITS // 8, np.uint8))
                    place = at[a:b] - bucket * BITS
                    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
                    if len(held) >= HELD:
                        yield out()
        yield out()

    return run


def matching(index: DataFrame, components: list[str] = (), years: list[int] = (), months: list[int] = (), regions: list[str] = (), states: list[str] = ()) -> DataFrame:
    """bucket, bits of the reports that query.facets() with these wants, but for a keyword."""
    wanted = {"named": components, "year": [str(y) for y in years], "month": [MONTHS[m - 1] for m in months if 1 <= m <= 12] or ([""] if months else []), "region": regions, "state": states}
    wanted = {f: list(dict.fromkeys(x)) for f, x in wanted.items() if x} or {"all": ["total"]}
    test = F.lit(False)
    for facet, values in wanted.items():
        test |= (F.col("facet") == facet) & F.col("value").isin(values)
    either = index.where(test).groupBy("bucket", "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
    return either.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("facets")).where(F.col("facets") == len(wanted)).select("bucket", "bits")


def count(found: DataFrame) -> DataFrame:
    """n: how many reports of matching()."""
    return found.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def count_by(index: DataFrame, group_by: str = "none", found: DataFrame | None = None) -> DataFrame:
    """key, n as query.count_by() gives them, of all reports or of those of matching()."""
    own = index.where(F.col("facet").isin("all", *([] if group_by == "none" else [group_by]))).select("facet", F.col("value").alias("key"), "bucket", "bits")
    if found is not None:
        # AND by a second row of the same group: a value's bitmap and the filter's, where both have the bucket.
        both = own.join(found.select(F.col("bucket").alias("b"), F.col("bits").alias("kept")), F.col("bucket") == F.col("b"))
        own = both.select("facet", "key", "bucket", F.explode(F.array("bits", "kept")).alias("bits")).groupBy("facet", "key", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    sums = own.groupBy("facet", "key").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return sums.where((F.col("n") > 0) | (F.col("facet") == "all")).select("key", "n")


def has(bits: Column, place: Column) -> Column:
    """Is the bit of a place set? (A byte of binary is read by way of its hexadecimal form.)"""
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0


def rows_of(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of a table with column id whose ranks are in matching(); buckets without any aren't looked at."""
    both = ranked.withColumn("_bucket", F.bitmap_bucket_number("id")).join(found.where(F.bitmap_count("bits") > 0), F.col("_bucket") == F.col("bucket"))
    return both.where(has(F.col("bits"), F.bitmap_bit_position("id"))).select(*ranked.columns)
