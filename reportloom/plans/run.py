"""One run over parsed pages: classify, resolve, extract facts, compare with the last run, publish what changed."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import classify, facts, publish, resolve
from ..operators.classify import Taxonomy
from ..operators.discovery import cut
from ..operators.resolve import Rounds
from ..sources import files


#: Columns of the published list and of its latest additions.
PUBLISHED = ("id", "title", "date", "year", "component_key", "component", "regions", "states", "url", "pdf", "summary", "matched_on", "date_basis", "period_date", "round", "round_zone", "mt_main")
ADDED = ("title", "url", "date", "added")


@dataclass
class Run:
    """What a run made: tables, and whether the list of reports changed."""

    reports: DataFrame
    sentences: DataFrame
    figures: DataFrame
    status: DataFrame
    additions: DataFrame
    changed: bool


def run(pages: DataFrame, tax: Taxonomy, rounds: Rounds, as_of: str, now: str, out: str | None = None, last: str | None = None, activities: list[str] | None = None, place: str = "", years: list[int] | None = None, seconds: float | None = None, root: str | None = None) -> Run:
    """Reports, facts and status of the pages (url, title, summary, date_raw, date, fetched, and, where there are such, files, pdf, body,
    series, pdf_check, pdf_text). out is a folder of this run's own, last that of the run before. Facts and status are written always, the
    list of reports, its CSV, JSON and script and the counts by year (by default of all years that occur) only if they changed; so last_changed
    and the list's folder are carried over, and the latest additions until there are new ones. With a root, its pointer (files.current) is
    set to out once all is written.

    Facts are of pages that are in scope, one for each title, before rounds are resolved. No pages give an empty catalogue."""
    spark = pages.sparkSession
    records = cut(classify.record(pages, tax, as_of))
    reports = cut(resolve.catalogue(records, tax, rounds))
    unique = resolve.dedupe_earliest(records)
    body = F.col("body") if "body" in pages.columns else F.lit(None).cast("string")
    pdf = F.col("pdf_text.text") if "pdf_text" in pages.columns else F.lit(None).cast("string")
    text = unique.select("url", facts.clean_page(body, activities, place).alias("page") if activities else body.alias("page"), "summary", pdf.alias("pdf"))
    told = cut(facts.read(text, ["url"]))  # texts are read once
    sentences = told.select("url", F.explode("s").alias("x")).select("url", "x.*")
    figures = told.select("url", F.explode("f").alias("x")).select("url", "x.*")
    old, before, listed, shown = None, None, None, None
    if last:
        row = spark.read.parquet(f"{last}/status").first()
        before, listed = row["last_changed"], row["reports_at"]
        old = spark.read.parquet(listed)
        shown = spark.read.parquet(f"{last}/additions")
    sums = cut(publish.digests(reports, list(publish.FINGERPRINT)))
    kept = (spark.read.parquet(f"{last}/digests"), sums) if last else None
    status = publish.status_row(old, reports, before, now, seconds, kept=kept)
    state = status.first()
    changed = bool(state["changed_this_run"])
    dated = reports.withColumn("added", F.lit(now[:10]))
    # The list shown last stays until there are new reports; the first run has none.
    added = publish.additions_or_last(old, dated.select("id", *ADDED), shown) if old is not None else dated.select(*ADDED).limit(0)
    if out:
        where = f"{out}/reports" if changed else listed
        status.withColumn("reports_at", F.lit(where)).write.parquet(f"{out}/status")
        told.write.parquet(f"{out}/facts")
        sums.write.parquet(f"{out}/digests")
        added.write.parquet(f"{out}/additions")
        added = spark.read.parquet(f"{out}/additions")
        read = told.join(unique.select("url", (F.length(pdf) > 0).alias("_read")), "url").agg(F.count_if("_read").alias("n"), F.count("*").alias("m")).first()
        facts_head = f'{{"v": 1, "pdf_read": {read["n"]}, "pages": {read["m"]}, "reports": {{'
        entry = F.concat(F.to_json(F.struct("url")).substr(F.lit(8), F.length(F.to_json(F.struct("url"))) - 8), F.lit(": "), F.to_json(F.struct(F.transform("s", lambda x: x["text"]).alias("s"), F.transform("f", lambda x: x.dropFields("ord")).alias("f"))))
        _both(told.where(F.size("s") > 0), out, "facts", "REPORT_FACTS", facts_head, "}}", [F.col("url")], entry)
        if changed:
            reports.write.parquet(f"{out}/reports")
            files.write_csv(publish.csv_rows(reports), f"{out}/reports_csv", [F.col("id")])
            files.write_csv(publish.pivot_by_year(reports, years), f"{out}/counts_csv", [F.col("component")])
            head = {
                "generated_at": state["last_changed"], "latest_additions": [r.asDict() for r in added.collect()],  # at most a page
                "components": [{"key": r.key, "label": r.label} for r in tax.rules] + [dict(zip(("key", "label"), tax.other))],
                "regions": {r.name: r.states for r in tax.regions}, "mt_rounds": tax.rounds, "count": state["count"],
            }
            begun = json.dumps(head, ensure_ascii=False)[:-1] + ', "reports": ['
            shape = F.to_json(F.struct(*[c for c in PUBLISHED if c in reports.columns]), {"ignoreNullFields": "false"})
            _both(reports, out, "reports_json", "REPORT_DATA", begun, "]}", [F.col("id")], shape)
        if root:
            files.point(spark, root, out)
    return Run(reports, sentences, figures, status, added, changed)


def _both(rows: DataFrame, out: str, name: str, variable: str, head: str, tail: str, order: list[Column], item: Column) -> None:
    """A document as JSON and as a script that sets a variable."""
    files.write_document(rows, f"{out}/{name}_file", head, tail, order, item)
    files.write_document(rows, f"{out}/{name}_script", f"window.{variable} = {head.replace('</', '<' + chr(92) + '/')}", f"{tail};", order, item, script=True)
