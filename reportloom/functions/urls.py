"""Address expressions; bad addresses give null instead of failing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once however often use names it: by a lambda over an array of one. Nested uses by name would
    grow an expression with each level."""
    return F.element_at(F.transform(F.array(value), use), 1)


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query; empty where missing."""
    return F.regexp_extract(url, _URL, k)


def without_dots(path: Column) -> Column:
    """A path whose . and .. segments are followed; .. at the root is dropped."""
    empty = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    # A last segment of dots is a folder.
    walked = lambda p: F.concat(F.array_join(F.aggregate(F.split(p, "/"), empty, step), "/"), F.when(p.rlike(r"(^|/)\.\.?$"), "/").otherwise(""))
    rooted = lambda t: F.when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t))
    return bound(path, lambda p: F.when(p.rlike(r"(^|/)\.\.?(/|$)"), bound(walked(p), rooted)).otherwise(p))


def resolve(href: Column, page: Column) -> Column:
    """An absolute address from a link on a page: full, //host, /path, ?query, #fragment or a relative path; dot segments of the
    latter two are followed and empty segments of a relative path's left out."""

    def on(x: Column) -> Column:
        href, scheme, origin, at, query = (x[n] for n in ("href", "scheme", "origin", "at", "query"))
        path = F.regexp_extract(href, "^[^?#]*", 0)
        folder = F.regexp_replace(at, "[^/]*$", "")
        inner = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), path), "/+", "/")
        walked = without_dots(F.when(href.startswith("/"), path).otherwise(inner))
        return (
            F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("?"), F.concat(origin, at, href))
            .when((href == "") | href.startswith("#"), F.concat(origin, at, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
            .otherwise(F.concat(origin, walked, F.substring(href, F.length(path) + 1, F.length(href))))
        )

    parts = F.struct(href.alias("href"), part(page, 1).alias("scheme"), F.concat(part(page, 1), F.lit("://"), part(page, 2)).alias("origin"), part(page, 3).alias("at"), part(page, 4).alias("query"))
    return bound(parts, on)


def canonical(href: Column, page: Column) -> Column:
    """Resolved, without parameters of the last path segment, fragment and closing slashes; the query stays."""

    def on(u: Column) -> Column:
        path = F.rtrim(F.regexp_replace(part(u, 3), ";[^/]*$", ""), F.lit("/"))
        return F.concat(part(u, 1), F.lit("://"), part(u, 2), path, F.when(part(u, 4) != "", F.concat(F.lit("?"), part(u, 4))).otherwise(""))

    return bound(resolve(href, page), on)


def is_report(url: Column, host: str, folder: str, word: str) -> Column:
    """Host ends in this one (a plain suffix test), the folder is in the path, what follows it holds the word."""

    def on(x: Column) -> Column:
        path = x["path"]
        slug = F.when(F.instr(path, folder) > 0, F.substring(path, F.instr(path, folder) + len(folder), F.length(path)))
        return F.coalesce(F.endswith(x["host"], F.lit(host)) & (F.length(slug) > 0) & F.lower(slug).contains(word), F.lit(False))

    return bound(F.struct(part(url, 2).alias("host"), part(url, 3).alias("path")), on)


def report_key(url: Column) -> Column:
    return F.rtrim(part(url, 3), F.lit("/"))


def page_number(url: Column) -> Column:
    """Last integer of the query's page parameter, else 0."""
    value = F.regexp_extract(part(url, 4), r"(?:^|&)page=([^&]*)", 1)
    digits = F.regexp_extract_all(F.coalesce(F.try_url_decode(value), F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.coalesce(F.try_element_at(digits, F.lit(-1)).try_cast("int"), F.lit(0))


def file_name(f: Column) -> Column:
    """Last path segment, percent-decoded; a plus sign stays."""
    name = F.substring_index(f, "/", -1)
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
