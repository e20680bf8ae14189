"""Reference totals of rounds and states, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("idp_ind", "idp_hh", "ret_ind", "ret_hh")


def clean_key(c: Column) -> Column:
    """Trimmed, upper case; a missing value becomes the text NAN."""
    return F.coalesce(F.upper(F.trim(c.cast("string"))), F.lit("NAN"))


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).cast("int")


def sums(df: DataFrame, keys: list[str], measures: tuple[str, ...] = MEASURES, zero_is_null: bool = True) -> DataFrame:
    """Sums of measures, rows with a null key left out; sums of 0 as null if told."""
    held = df.dropna(subset=keys)
    total = lambda m: F.sum(F.coalesce(m, F.lit(0))).cast("long")
    return held.groupBy(*keys).agg(*[(F.nullif(total(m), F.lit(0)) if zero_is_null else total(m)).alias(m) for m in measures])


def violations(detail: DataFrame, totals: DataFrame, key: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """key, measure, total, detail where the detail's sum isn't the total; none: the totals hold."""
    d = sums(detail, [key], measures, False).select(key, *[F.col(m).alias(f"d_{m}") for m in measures])
    both = totals.join(d, key, "left")
    parts = F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(m), F.lit(0)).alias("total"), F.coalesce(F.col(f"d_{m}"), F.lit(0)).alias("detail")) for m in measures])
    return both.select(key, F.explode(parts).alias("x")).select(key, "x.*").where("total <> detail")


def assert_rollup(detail: DataFrame, totals: DataFrame, key: str, measures: tuple[str, ...] = MEASURES) -> None:
    """Fail, and name a few, if totals do not hold."""
    bad = violations(detail, totals, key, measures).limit(5).collect()
    if bad:
        raise ValueError(f"totals differ from the sum of their parts: {bad}")


def distinct_places(df: DataFrame, key: str, wards: list[str], lgas: list[str]) -> DataFrame:
    """key, wards, lgas: distinct combinations without null parts."""
    return df.groupBy(key).agg(F.count_distinct(*wards).alias("wards"), F.count_distinct(*lgas).alias("lgas"))


def nested(df: DataFrame, key: str, name: str, measures: tuple[str, ...], out: str) -> DataFrame:
    """key and a map from name to a struct of measures."""
    entries = F.array_sort(F.collect_list(F.struct(name, F.struct(*measures).alias("v"))))
    return df.groupBy(key).agg(F.map_from_entries(entries).alias(out))


def reconciled(summary: DataFrame, detail: DataFrame, key: str, tolerance: int = 1) -> DataFrame:
    """key, figure, total: summary figures that differ from the detail's sum by more than the tolerance."""
    return summary.join(detail, key).where(F.abs(F.col("figure") - F.col("total")) > tolerance).select(key, "figure", "total")


def notes(idp: Column, idp_sum: Column, ret: Column, ret_sum: Column) -> Column:
    """Texts on what does not agree in a round."""
    n = lambda c: F.format_number(c, 0)
    has = ret.isNotNull() & (ret != 0)
    told = F.array(
        F.when(F.abs(idp - idp_sum) > 1, F.concat(F.lit("summary IDP total "), n(idp), F.lit(" differs from the sum of ward rows "), n(idp_sum))),
        F.when(has & ret_sum.isNotNull() & (F.abs(ret - ret_sum) > 1), F.concat(F.lit("summary returnee total "), n(ret), F.lit(" differs from the sum of ward rows "), n(ret_sum))),
        F.when(has & ret_sum.isNull(), F.lit("no ward-level returnee rows for this round; the summary figure may be carried over from the previous round")),
    )
    return F.filter(told, lambda x: x.isNotNull())


def with_known(df: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """The column, replaced where the known table (key, column; one row a round) has a value."""
    k = known.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return df.join(k, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")
