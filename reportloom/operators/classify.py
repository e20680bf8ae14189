"""Classification of records by rules held as data: types, states, regions, dates of default regions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised
from .matcher import matched
from .spread import spread


@dataclass
class Rule:
    key: str
    label: str
    include: list[str]
    exclude: list[str] = field(default_factory=list)
    require_state: bool = False


@dataclass
class Region:
    name: str
    aliases: list[str]
    states: list[str]


@dataclass
class Taxonomy:
    rules: list[Rule]
    regions: list[Region]
    state_patterns: dict[str, str] = field(default_factory=dict)
    default_region: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    component_states: dict[str, list[str]] = field(default_factory=dict)
    subject_state_from_summary: list[str] = field(default_factory=list)
    gazetteer: dict[str, list[str]] = field(default_factory=dict)
    rounds: dict[str, int] = field(default_factory=dict)
    round_ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    scope: str = ""
    other: tuple[str, str] = ("other", "Other")
    states_from_summary: bool = False

    @property
    def states(self) -> list[str]:
        return [s for r in self.regions for s in r.states]

    def pattern(self, state: str) -> str:
        return self.state_patterns.get(state, rf"\b{re.escape(state.lower())}\b")


def _norm(text: str) -> str:
    text = re.sub("[‐-―]", "-", text.lower())
    return " " + " ".join(re.sub(r"[^\w&/\-\s]", " ", text).split()) + " "


def in_scope(title: Column, tax: Taxonomy) -> Column:
    return title.rlike(f"(?iuU){tax.scope}") if tax.scope else F.lit(True)


def _ordered(names: list[str], test) -> Column:
    found = F.array(*[F.when(test(n), F.lit(n)) for n in names]) if names else F.array().cast("array<string>")
    return F.filter(found, lambda x: x.isNotNull())


def states(text: Column, tax: Taxonomy) -> Column:
    """States whose pattern is in the text, in taxonomy order."""
    text = F.coalesce(text, F.lit(""))
    return _ordered(tax.states, lambda s: text.rlike(f"(?iuU){tax.pattern(s)}"))


@dataclass
class Noted:
    """What several rules ask of a record, as columns: states named in the title and, from matcher.matched(), the first rule that
    hits and the rest; or else the normalised title and summary."""

    states: Column
    told: Column | None = None
    title: Column | None = None
    summary: Column | None = None


def noted(df: DataFrame, title: Column, summary: Column, tax: Taxonomy) -> tuple[DataFrame, Noted]:
    """The rows with what all terms of the taxonomy find in both texts, read once by an automaton, and the columns."""
    name = "_told"
    while name in df.columns:
        name += "_"
    out = spread(df).select("*", matched(title, summary, tax).alias(name))
    return out, Noted(F.col(f"{name}.states"), F.col(name))


def noted_of(title: Column, summary: Column, tax: Taxonomy) -> Noted:
    return Noted(states(title, tax), None, normalised(title), normalised(summary))


def classified(title: Column, summary: Column, tax: Taxonomy, n: Noted | None = None) -> Column:
    """struct(key, label, matched_on): the first rule that hits, all rules on the title before any on the summary.

    One CASE chain over two normalised texts, for taxonomies of a few terms; evaluation stops at the first hit. With noted() terms
    of any number take one reading."""
    n = n or noted_of(title, summary, tax)
    if n.told is not None:
        return F.struct(*[n.told[x].alias(x) for x in ("key", "label", "matched_on")])
    has_state = F.size(n.states) > 0
    out = None
    for where, c in (("title", n.title), ("summary", n.summary)):
        for rule in tax.rules:
            veto = F.lit(False)
            for x in rule.exclude:
                if x.strip():
                    veto = veto | c.contains(_norm(x).strip())
            for term in rule.include:
                t = term.lower()
                hit = c.contains(t if t != t.strip() else _norm(t).strip()) & ~veto
                if rule.require_state:
                    hit = hit & has_state
                value = F.struct(F.lit(rule.key).alias("key"), F.lit(rule.label).alias("label"), F.lit(f"{where}:{term.strip()}").alias("matched_on"))
                out = F.when(hit, value) if out is None else out.when(hit, value)
    none = F.struct(F.lit(tax.other[0]).alias("key"), F.lit(tax.other[1]).alias("label"), F.lit("").alias("matched_on"))
    return none if out is None else out.otherwise(none)


def regions(title: Column, summary: Column, found_states: Column, tax: Taxonomy, n: Noted | None = None) -> Column:
    """States named in the title decide; else those found, and aliases in the title; else aliases in the summary."""
    region_of = {s: r.name for r in tax.regions for s in r.states}
    names = [r.name for r in tax.regions]
    n = n or noted_of(title, summary, tax)
    own = n.states
    of = lambda array, name: F.arrays_overlap(array, F.array(*[F.lit(s) for s, r in region_of.items() if r == name] or [F.lit(None).cast("string")]))
    alias = {r.name: "|".join(rf"(?<![a-z]){re.escape(a.lower())}(?![a-z])" for a in r.aliases) or r"(?!)" for r in tax.regions}
    by_title = _ordered(names, lambda n: F.coalesce(of(own, n), F.lit(False)))
    in_title = lambda r: n.title.rlike(alias[r]) if n.told is None else F.array_contains(n.told["title_regions"], r)
    mixed = _ordered(names, lambda r: F.coalesce(of(found_states, r), F.lit(False)) | in_title(r))
    last = _ordered(names, lambda r: n.summary.rlike(alias[r])) if n.told is None else n.told["summary_regions"]
    return F.when(F.size(own) > 0, by_title).when(F.size(mixed) > 0, mixed).otherwise(last)


def default_region(key: Column, date: Column, found_states: Column, tax: Taxonomy) -> Column:
    """A region that a type of report had until a day; only where no state is known. Null where no rule holds."""
    out = F.lit(None).cast("array<string>")
    for k, rules in reversed(list(tax.default_region.items())):
        for before, name in reversed(rules):
            out = F.when((key == k) & (date < before), F.array(F.lit(name))).otherwise(out)
    return F.when((F.size(found_states) == 0) & date.isNotNull(), out)


#: How a summary names its states, and how a cover line does, in capitals or not.
OF_STATE = r"(?U)([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\s+States?\b"
SPACED = r"(?<=[A-Z]{3}) (?=[A-Z]\b)"
COVER_CAPITALS = r"\bIN\s+((?:[A-Z][A-Z]+[ ,]*(?:AND\s+)?){1,6}?)\s*STATES?\b"
COVER = r"\b(?:in|across)\s+((?:[A-Z][a-z]+,?\s+(?:and\s+)?){1,4}?)States?\b"


def subject_states(summary: Column, tax: Taxonomy) -> Column:
    """States named as "X State(s)" in the opening sentence."""
    opening = F.split(F.coalesce(summary, F.lit("")), r"(?<=[.!?])\s", 2)[0]
    names = F.array_join(F.regexp_extract_all(opening, F.lit(OF_STATE), F.lit(1)), " ")
    return states(names, tax)


def cover_states(cover: Column, tax: Taxonomy) -> Column:
    """States of a cover line "... IN A AND B STATES" or "in A and B States"; letter-spaced capitals are closed up."""
    c = F.regexp_replace(F.substring(F.coalesce(cover, F.lit("")), 1, 1500), SPACED, "")
    first = lambda rx: F.nullif(F.regexp_extract(c, rx, 1), F.lit(""))
    hit = F.coalesce(first(COVER_CAPITALS), first(COVER))
    return states(hit, tax)


def gazetteer_states(summary: Column, tax: Taxonomy) -> Column:
    """States of places named in the opening sentence that lie in one state only, sorted."""
    opening = F.split(F.coalesce(summary, F.lit("")), r"(?<=[.!?])\s", 2)[0]
    places = {p: s[0] for p, s in tax.gazetteer.items() if len(s) == 1}
    if not places:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(opening.rlike(rf"\b{re.escape(p)}\b"), F.lit(s)) for p, s in places.items()]), lambda x: x.isNotNull())))


def allowed(found: Column, key: Column, tax: Taxonomy) -> Column:
    """Only the states that a type of report runs in, where it is restricted."""
    out = found
    for k, names in tax.component_states.items():
        out = F.when(key == k, F.array_intersect(found, F.array(*[F.lit(n) for n in names]))).otherwise(out)
    return out


#: The phrases of each kind, in order of precedence, and the most characters of evidence before and after them.
KINDS = [
    ("needs", r"needs?\s+monitoring", 70, 70),
    ("atlas", r"(?:idp and returnee atlas|idp atlas|\batlas\b)", 70, 50),
    ("atlas", r"(?:baseline assessment|site assessment|mobility tracking)", 60, 60),
]


def document_kind(text: Column) -> Column:
    """struct(kind, evidence): needs before atlas before baseline words in a document's text. The first place of a phrase is
    searched, and the evidence cut from what is around it, so that long texts take linear time."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    out = None
    for kind, phrase, before, after in KINDS:
        at = F.regexp_instr(t, F.lit(f"(?iuU){phrase}"))
        start = F.greatest(at - before, F.lit(1))
        # Near the beginning a later phrase may lie in reach as well; so the window holds one that begins before characters later.
        window = F.substring(t, start, F.lit(2 * before + after + 60))
        found = F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_extract(window, f"(?iuU).{{0,{before}}}{phrase}.{{0,{after}}}", 0)).alias("evidence"))
        out = F.when(at > 0, found) if out is None else out.when(at > 0, found)
    return out.otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit("").alias("evidence")))


def record(df: DataFrame, tax: Taxonomy, as_of: str, seen: Column | None = None) -> DataFrame:
    """All of it for columns title, summary, date_raw, date, fetched, and, where there are such, pdf_text and series
    (put before the summary, but for the column itself). seen is the day of reading by which a page without a date is told; by default
    that of fetched, and for records of version 2, where there is a column v, the day that FIRST_READ names."""
    from ..functions.dates import FIRST_READ, parse_date, resolved, title_date, year_from_title

    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    told = F.trim(F.concat_ws(" ", F.array_join("series", " "), summary)) if "series" in df.columns else summary
    if seen is None and "v" in df.columns:
        seen = F.coalesce(F.col("fetched"), F.when(F.col("v") == 2, F.lit(FIRST_READ)))
    c, n = noted(df.where(in_scope(title, tax)), title, told, tax)
    c = c.withColumn("_c", classified(title, told, tax, n))
    own = n.states
    if tax.states_from_summary:
        own = F.when(F.size(own) > 0, own).otherwise(n.told["told_states"])
    cover = F.col("pdf_text.text") if "pdf_text" in df.columns else F.lit("")
    steps = [subject_states(told, tax), cover_states(cover, tax), n.told["places"]]
    fallback = F.when(F.size(steps[0]) > 0, steps[0]).when(F.size(steps[1]) > 0, steps[1]).otherwise(steps[2])
    found = F.when((F.size(own) == 0) & F.col("_c.key").isin(tax.subject_state_from_summary), fallback).otherwise(own)
    c = c.withColumn("states", allowed(found, F.col("_c.key"), tax))
    c = c.withColumn("_d", resolved(F.coalesce(parse_date(F.col("date_raw")), F.col("date")), title, F.col("fetched"), as_of, seen))
    c = c.withColumn("component_key", F.col("_c.key")).withColumn("component", F.col("_c.label")).withColumn("matched_on", F.col("_c.matched_on"))
    c = c.withColumn("date", F.col("_d.date")).withColumn("date_basis", F.col("_d.basis")).withColumn("period_date", title_date(title))
    c = c.withColumn("year", F.when(F.col("date").isNotNull(), F.substring("date", 1, 4).cast("int")).otherwise(year_from_title(title)))
    c = c.withColumn("regions", F.coalesce(default_region(F.col("component_key"), F.col("date"), F.col("states"), tax), regions(title, told, F.col("states"), tax, n)))
    return c.select(*df.columns, *[x for x in ("component_key", "component", "matched_on", "states", "date", "date_basis", "period_date", "year", "regions") if x not in df.columns])
