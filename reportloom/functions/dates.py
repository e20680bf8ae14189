"""Dates, kept as ISO strings that are not validated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates as pages write them (month day year, day month year, ISO), and month and year in a title, with or without a day.
MONTH_DAY_YEAR = r"\b([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\b"
DAY_MONTH_YEAR = r"\b(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\b"
ISO = r"(\d{4})-(\d{2})-(\d{2})"
IN_TITLE = r"(?:(\d{1,2})\s*(?:st|nd|rd|th)?\s+)?([A-Za-z]{3,9})\.?,?\s+(\d{4})\b"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def month(c: Column) -> Column:
    """1 to 12 from a month's first three letters, else null."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(c, 1, 3)))
    return F.when(at > 0, at)


def iso(year: Column, mon: Column, day: Column) -> Column:
    """Null where the month is."""
    return F.concat(year, F.lit("-"), F.lpad(mon.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("int").cast("string"), 2, "0"))


def _first(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_date(c: Column) -> Column:
    """The first date of candidates joined by " | ": month day year, then day month year, then ISO, for each candidate."""
    a, b, d = MONTH_DAY_YEAR, DAY_MONTH_YEAR, ISO

    def one(part: Column) -> Column:
        return F.coalesce(
            iso(_first(part, a, 3), month(_first(part, a, 1)), _first(part, a, 2)),
            iso(_first(part, b, 3), month(_first(part, b, 2)), _first(part, b, 1)),
            _first(part, d, 0),
        )

    found = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r" \| "), lambda p: one(F.trim(p))), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


def title_date(c: Column, first: int = 2010, last: int = 2035) -> Column:
    """The last month and year in a title's text order, of day 1 if there is no day."""
    c = F.coalesce(c, F.lit(""))
    hits = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(IN_TITLE), F.lit(g)).alias(n) for g, n in ((1, "d"), (2, "m"), (3, "y"))])
    dates = F.transform(hits, lambda h: F.when(h["y"].cast("int").between(first, last), iso(h["y"], month(h["m"]), F.coalesce(F.nullif(h["d"], F.lit("")), F.lit("1")))))
    return F.try_element_at(F.filter(dates, lambda x: x.isNotNull()), F.lit(-1))


def year_from_title(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(20[1-3]\d)\b"), F.lit(1)), F.lit(-1)).cast("int")


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(F.try_to_date(F.substring(a, 1, 10)), F.try_to_date(F.substring(b, 1, 10))))


#: The day on which records of version 2 were read, and the labels of a date's basis.
FIRST_READ = "2026-09-24"
NO_PAGE_DATE = "date in title (page shows no publication date)"
NO_SITE_DATE = "no date on the site (counted on the day it was read)"


def resolved(date: Column, title: Column, fetched: Column, as_of: str, seen: Column | None = None) -> Column:
    """struct(date, basis): a page without a date of its own shows the day it was read; then the title's date counts.
    Dates that are no calendar dates are never taken for placeholders. seen: day of reading for the last rule."""
    tdate = title_date(title)
    year = lambda c: F.substring(c, 1, 4).cast("int")
    held = F.when(fetched.isNotNull(), (days_apart(date, fetched) <= 2) & (year(date) > year(tdate))).otherwise((year(date) - year(tdate) >= 2) & (days_apart(date, F.lit(as_of)) <= 45))
    placeholder = F.coalesce(held, F.lit(False)) & date.isNotNull() & tdate.isNotNull()
    from_title = placeholder | (date.isNull() & tdate.isNotNull())
    seen = fetched if seen is None else seen
    read_day = date.isNotNull() & tdate.isNull() & F.coalesce(days_apart(date, seen) <= 1, F.lit(False))
    return F.struct(F.when(from_title, tdate).otherwise(date).alias("date"), F.when(from_title, NO_PAGE_DATE).when(read_day, NO_SITE_DATE).otherwise("publication date").alias("basis"))
