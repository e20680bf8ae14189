"""Duplicates, one main report for each round, gap filling, ranks, and all of it in turn."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import title_key
from ..functions.urls import file_name
from .classify import Taxonomy
from .discovery import cut

LATE = "9999"


def dedupe_earliest(df: DataFrame, title: str = "title", date: str = "date", url: str = "url") -> DataFrame:
    """One row for each normalised title: the earliest by date (none: last), then address."""
    least = F.struct(F.coalesce(date, F.lit(LATE)).alias("_date"), F.col(url).alias("_url"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    # An aggregate, not a window: rows of a hot title are reduced before the shuffle.
    keyed = df.select(title_key(F.coalesce(F.col(title), F.lit(""))).alias("_key"), least.alias("_v"))
    return keyed.groupBy("_key").agg(F.min_by("_v._row", F.struct("_v._date", "_v._url")).alias("_row")).select("_row.*")


def in_range(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with ruled: is the round inside its zone's range? ranges: zone, lo, hi. Catalyst broadcasts them while they are few."""
    r = ranges.select(F.col("zone").alias("_z"), F.col("lo").alias("rule_lo"), F.col("hi").alias("rule_hi"))
    out = df.join(r, (F.col("round_zone") == F.col("_z")) & F.col("round").between(F.col("rule_lo"), F.col("rule_hi")), "left")
    return out.withColumn("ruled", F.col("_z").isNotNull() & (F.col("round") != 0)).drop("_z")


#: File name patterns of the two kinds, and the phrase in a page's text.
NEEDS_FILE = r"(?iuU)needs?[\s_-]*monitoring|(?:^|[\s_(-])NM[\s_-]"
ATLAS_FILE = r"(?iuU)atlas"
NEEDS_TEXT = r"(?iuU)needs?\s+monitoring"


def cascade(files: Column, check_kind: Column, check_evidence: Column, body: Column, key: Column, matched: Column, ruled: Column, lo: Column, hi: Column, zone: Column) -> Column:
    """struct(kind, why, file): evidence in order: the zone's range of rounds, file names, the document's text, the
    page's text, the title. file is what stands in for a missing document link."""
    pdfs = F.filter(F.coalesce(files, F.array().cast("array<string>")), lambda f: F.lower(f).endswith(".pdf"))
    needs = F.try_element_at(F.filter(pdfs, lambda f: F.concat(F.lit(" "), file_name(f)).rlike(NEEDS_FILE)), F.lit(1))
    atlas = F.try_element_at(F.filter(pdfs, lambda f: file_name(f).rlike(ATLAS_FILE)), F.lit(1))
    any_file = F.coalesce(needs, atlas, F.try_element_at(pdfs, F.lit(1)))
    pick = lambda kind, why: F.struct(kind.alias("kind"), why.alias("why"), any_file.alias("file"))
    name = lambda f: F.concat(F.lit("file name: "), F.substring(file_name(f), 1, 70))
    rule = F.concat(F.lit("rule: "), zone, F.lit(" rounds "), lo.cast("string"), F.lit("–"), hi.cast("string"), F.lit(" are needs reports"))
    return (
        F.when(ruled, pick(F.lit("needs"), rule))
        .when(needs.isNotNull(), pick(F.lit("needs"), name(needs)))
        .when(atlas.isNotNull(), pick(F.lit("atlas"), name(atlas)))
        .when(check_kind.isin("needs", "atlas"), pick(check_kind, F.concat(F.lit("inside PDF: “"), F.substring(F.coalesce(check_evidence, F.lit("")), 1, 120), F.lit("”"))))
        .when(F.coalesce(body, F.lit("")).rlike(NEEDS_TEXT), pick(F.lit("needs"), F.lit("report page says it contains needs monitoring findings")))
        .otherwise(pick(F.when(key == "needs", "needs").otherwise("atlas"), F.concat(F.coalesce(matched, F.lit("")), F.lit(" (title only; PDF not yet checked)"))))
    )


def route(df: DataFrame, positive: str, negative: str, kinds: tuple[str, ...] = ("needs", "atlas", "mt_dash"), dash: str = "mt_dash") -> DataFrame:
    """role of each row: other, dash (a dashboard already), demoted (no round or not a main title), main."""
    from ..functions.rounds import is_main

    no_round = F.col("round").isNull() | (F.col("round") == 0)
    role = F.when(~F.col("component_key").isin(*kinds), "other").when(F.col("component_key") == dash, "dash").when(no_round | ~is_main(F.col("title"), positive, negative), "demoted").otherwise("main")
    return df.withColumn("role", role)


def one_per_group(df: DataFrame, keys: list[str], kind: str = "kind", date: str = "date", url: str = "url") -> DataFrame:
    """action of each row of a group: keep (the earliest), drop (later, of the same kind as it), demote (of another)."""
    first = df.groupBy(*keys).agg(F.min(F.struct(F.coalesce(date, F.lit(LATE)).alias("d"), F.col(url).alias("u"), F.col(kind).alias("k"))).alias("_first"))
    both = df.join(first, keys)
    keep = (F.col(url) == F.col("_first.u")) & (F.coalesce(F.col(date), F.lit(LATE)) == F.col("_first.d"))
    return both.withColumn("action", F.when(keep, "keep").when(F.col(kind) == F.col("_first.k"), "drop").otherwise("demote")).drop("_first")


def gap_fill(mains: DataFrame, candidates: DataFrame, expected: DataFrame, preferred: str) -> DataFrame:
    """zone, round, url of each expected number without a main report: the best candidate (a preferred title first,
    then the earliest), null where there is none. expected: zone, rounds (1 to rounds are expected)."""
    wanted = expected.select("zone", F.explode(F.sequence(F.lit(1), F.col("rounds"))).alias("round"))
    missing = wanted.join(mains.select("zone", "round").distinct(), ["zone", "round"], "left_anti")
    best = candidates.groupBy("zone", "round").agg(F.min(F.struct((~F.coalesce(F.col("title").rlike(f"(?iuU){preferred}"), F.lit(False))).alias("n"), F.coalesce("date", F.lit(LATE)).alias("d"), F.col("url").alias("u"))).alias("b"))
    return missing.join(best, ["zone", "round"], "left").select("zone", "round", F.col("b.u").alias("url"))


def zone_override(df: DataFrame, zones: dict[str, list[str]], tax: Taxonomy) -> DataFrame:
    """Main reports have the regions of their zone, and only the states in them."""
    region = F.lit(None).cast("array<string>")
    inside = F.lit(None).cast("array<string>")
    for z, names in zones.items():
        region = F.when(F.col("round_zone") == z, F.array(*[F.lit(n) for n in names])).otherwise(region)
        inside = F.when(F.col("round_zone") == z, F.array(*[F.lit(s) for r in tax.regions if r.name in names for s in r.states])).otherwise(inside)
    main = F.coalesce(F.col("mt_main"), F.lit(False))
    return df.withColumn("regions", F.when(main, region).otherwise(F.col("regions"))).withColumn("states", F.when(main, F.array_intersect("states", inside)).otherwise(F.col("states")))


def ranked(df: DataFrame, parts: int = 200) -> DataFrame:
    """id: rank by (date or '' desc, title desc, url), in two levels: counts of ranges of (date, title), then places inside a range,
    so that no single task orders all rows, nor all that lack a date. Bounds are at most parts keys, picked by their hash; rows that equal each other in date and title share a range."""
    key = F.concat(F.coalesce("date", F.lit("")), F.lit("\u0001"), F.coalesce("title", F.lit("")))
    keyed = df.withColumn("_k", key)
    # Strings have no percentiles: the key of least hash in each of parts classes of another hash is a random one.
    picked = keyed.groupBy(F.pmod(F.xxhash64("_k"), F.lit(parts)).alias("_b")).agg(F.min_by("_k", F.xxhash64(F.col("_k"), F.lit(1))).alias("_k"))
    bounds = picked.agg(F.array_sort(F.collect_list("_k")).alias("_bounds"))  # one row of at most parts keys
    ranged = keyed.join(F.broadcast(bounds)).withColumn("_g", F.size(F.filter("_bounds", lambda b: b <= F.col("_k")))).drop("_bounds")
    counts = ranged.groupBy("_g").count()
    before = counts.select(F.col("_g").alias("_h"), (F.sum("count").over(W.orderBy(F.col("_g").desc())) - F.col("count")).alias("_before"))  # at most parts + 1 rows
    place = F.row_number().over(W.partitionBy("_g").orderBy(F.coalesce("date", F.lit("")).desc(), F.col("title").desc(), "url"))
    placed = ranged.withColumn("_place", place).join(F.broadcast(before), F.col("_g") == F.col("_h"))
    return placed.withColumn("id", (F.col("_before") + F.col("_place")).cast("long")).drop("_k", "_g", "_h", "_before", "_place")


@dataclass
class Rounds:
    """How reports of rounds are told, held as data: patterns of titles, product phrases, zones, expected rounds of a zone, regions of a
    zone, and the type and label of a round's other files."""

    stop: str
    products: list[str]
    positive: str
    negative: str
    preferred: str
    zone: str
    inside: str
    outside: str
    zones: dict[str, list[str]]
    kinds: tuple[str, ...] = ("needs", "atlas", "mt_dash")
    dash: str = "mt_dash"
    dash_label: str = "Dashboards"
    expected: dict[str, int] = field(default_factory=dict)


#: The reasons that are written for files which are no round's report, or become one.
NOT_A_ROUND = " (Mobility Tracking file, not a round report)"
SECOND = "second report for the same round, filed with the round's other files"
FILLED = "; the round has no full report, so its dashboard is the round's report"


def catalogue(records: DataFrame, tax: Taxonomy, r: Rounds) -> DataFrame:
    """Reports from classified records (of classify.record, with files, pdf, body and pdf_check where there are such), in order:
    one for each title, round reports told from their other files, their kind by evidence, one for each round, gaps filled,
    regions and states by zone, ranks. Adds round, round_zone, mt_main (null: no file of a round), id.

    Defined results: no rows give no rows; a null title is the empty title; rows that equal each other are one."""
    from ..functions.rounds import round_number, zone

    for name, kind in (("files", "array<string>"), ("pdf", "string"), ("body", "string"), ("pdf_check", "struct<kind:string,evidence:string>")):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    spark = records.sparkSession
    labels = {x.key: x.label for x in tax.rules} | {r.dash: r.dash_label}
    label = lambda key: F.coalesce(*[F.when(key == k, F.lit(x)) for k, x in labels.items()], key)
    c = dedupe_earliest(records)
    of_round = F.col("component_key").isin(*r.kinds)
    number = F.nullif(round_number(F.coalesce("title", F.lit("")), r.stop, r.products), F.lit(0))
    c = c.withColumn("round", F.when(of_round, number))
    c = c.withColumn("round_zone", F.when(F.col("round").isNotNull(), zone(F.coalesce("title", F.lit("")), r.zone, r.inside, r.outside)))
    ranges = spark.createDataFrame([(z, lo, hi) for z, (lo, hi) in tax.round_ranges.items()], "zone string, lo int, hi int")
    c = route(in_range(c, ranges), r.positive, r.negative, r.kinds, r.dash)

    def evidence() -> Column:
        return cascade(F.col("files"), F.col("pdf_check.kind"), F.col("pdf_check.evidence"), F.col("body"), F.col("component_key"), F.col("matched_on"), F.coalesce(F.col("ruled"), F.lit(False)), F.col("rule_lo"), F.col("rule_hi"), F.col("round_zone"))

    def rewritten(df: DataFrame, which: Column, key: Column, why: Column, main: Column, file: Column | None = None) -> DataFrame:
        """Type, label, reason and flag of some rows, and the document they lack."""
        new = {"component_key": key, "component": label(key), "matched_on": why, "mt_main": main} | ({} if file is None else {"pdf": F.coalesce(F.nullif(F.col("pdf"), F.lit("")), file)})
        return df.select(*[F.when(which, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(f"`{x}`") for x in df.columns])

    reason = F.coalesce(F.col("matched_on"), F.lit(""))
    c = c.withColumn("mt_main", F.when(F.col("role") == "dash", False)).withColumn("_x", evidence())
    c = rewritten(c, F.col("role") == "demoted", F.lit(r.dash), F.concat(reason, F.lit(NOT_A_ROUND)), F.lit(False))
    c = rewritten(c, F.col("role") == "main", F.col("_x.kind"), F.col("_x.why"), F.lit(True), F.col("_x.file"))
    # What follows looks at these rows several times: they are made once.
    c = cut(c)
    # The first of a round is an aggregate of fixed size, joined to its rows.
    of_main = F.coalesce(F.col("mt_main"), F.lit(False))
    acted = one_per_group(c.where(of_main), ["round_zone", "round"], "component_key").where("action <> 'drop'")
    acted = rewritten(acted, F.col("action") == "demote", F.lit(r.dash), F.lit(SECOND), F.lit(False))
    c = acted.drop("action").unionByName(c.where(~of_main))
    c = cut(c)
    if r.expected:
        expected = spark.createDataFrame(list(r.expected.items()), "zone string, rounds int")
        named = c.where("round IS NOT NULL").select(F.col("round_zone").alias("zone"), "round", "title", "date", "url", "mt_main")
        fill = gap_fill(named.where("mt_main"), named.where("NOT mt_main"), expected, r.preferred).where("url IS NOT NULL").select(F.col("url").alias("_fill"))
        c = c.join(fill, F.col("url") == F.col("_fill"), "left").withColumn("_x", evidence())
        c = rewritten(c, F.col("_fill").isNotNull(), F.col("_x.kind"), F.concat(F.col("_x.why"), F.lit(FILLED)), F.lit(True), F.col("_x.file")).drop("_fill")
    c = zone_override(c.drop("_x", "role", "ruled", "rule_lo", "rule_hi"), r.zones, tax)
    return ranked(cut(c))
