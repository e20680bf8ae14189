"""Sequence numbers of periodic reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman digits.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50}


def roman(c: Column) -> Column:
    """Value of roman digits, subtractive, not validated."""
    values = F.transform(F.split(F.upper(c), ""), lambda x: F.coalesce(*[F.when(x == k, v) for k, v in ROMAN.items()], F.lit(0)))
    signed = F.zip_with(values, F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: F.when(b > a, -a).otherwise(a))
    return F.aggregate(signed, F.lit(0), lambda s, x: s + x)


def round_number(title: Column, stop: str, products: list[str]) -> Column:
    """Number of a round report: "round 44" first, then a product phrase and a number, then a roman "Round XXII"; null
    where a stop phrase (a pattern) is in the title."""
    first = lambda rx: F.nullif(F.regexp_extract(title, rx, 1), F.lit(""))
    arabic = F.coalesce(first(r"(?iuU)\bround\s*#?\s*(\d{1,2})\b"), first(rf"(?iuU)(?:{'|'.join(products)})\s*#?\s*(\d{{1,2}})\b"))
    letters = first(r"\b[Rr]ound\s+([IVXL]{1,7})\b")
    return F.when(~title.rlike(f"(?iuU){stop}"), F.coalesce(arabic.try_cast("int"), roman(letters)))


def zone(title: Column, pattern: str, inside: str, outside: str) -> Column:
    return F.when(title.rlike(f"(?iuU){pattern}"), inside).otherwise(outside)


def is_main(title: Column, positive: str, negative: str) -> Column:
    """A round's main report, not one of its lists or dashboards."""
    return title.rlike(f"(?iuU){positive}") & ~title.rlike(f"(?iuU){negative}")
