"""Report-shaped views over the test tables, each in DataFrame form and as DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import Region, Rule, Taxonomy
from ..operators.spread import spread
from ..sources.pdf import slices

#: The day on which the test runs stand.
AS_OF = "2016-06-30"

#: Names under which summaries speak of the nations, in the order of their numbers.
STATE_NAMES = "Alba Borea Cetra Dorum Elva Fonda Garra Hestia Ilmar Jorva Kelda Lunor Morva Nessa Orlan Pelda Quira Ronda Selma Torva Ulmar Vesta Wilma Xanta Yelva".split()
TAXONOMY = Taxonomy(
    rules=[
        Rule("urgent", "Urgent reports", ["1-urgent"], exclude=["middle east"]),
        Rule("needs", "Needs reports", ["2-high"], require_state=True),
        Rule("ewer", "Early warning", ["ewer"]),
        Rule("ring", "Ring notes", [" ring ", "small bolt"]),
        Rule("atlas", "Atlas", ["5-low", "not specified"], exclude=["europe"]),
    ],
    regions=[
        Region("Africa", ["africa"], ["NATION_0", "NATION_5", "NATION_10"]),
        Region("America", ["america"], ["NATION_1", "NATION_6"]),
        Region("Asia", ["asia"], ["NATION_2", "NATION_7"]),
        Region("Europe", ["europe", "not specified"], ["NATION_3", "NATION_8", "NATION_20"]),
    ],
    default_region={"urgent": [("2015-01-01", "Asia")], "ring": [("2017-01-01", "Europe")]},
    component_states={"needs": ["NATION_0", "NATION_2", "NATION_20"]},
    subject_state_from_summary=["ewer", "ring"],
    state_patterns={f"NATION_{k}": rf"\b(?:nation_{k}|{x.lower()})\b" for k, x in enumerate(STATE_NAMES)},
    gazetteer={"Ringville": ["NATION_2"], "Boltham": ["NATION_3", "NATION_7"], "Widgetby": ["NATION_5"]},
    round_ranges={"AFRICA": (40, 50), "ASIA": (10, 12)},
    scope=r"^\s*(africa|asia|europe|am[eé]rica)\b",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def report_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: url, title, summary, date_raw, date, fetched, key, nation, zone, round, status, price."""
    t = lambda n: read(spark, sf_dir, n)
    o = spread(t("orders")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    # Every order has a part, one of those with keys that the remainder allows: a bounded table, however large part is.
    o = o.join(F.broadcast(t("part").where("p_partkey BETWEEN -198 AND 200")), F.col("o_orderkey") % 200 + 1 == F.col("p_partkey"))
    day = F.add_months(F.to_date("o_orderdate"), 18 * 12)
    told = F.date_format(day, "d MMMM yyyy")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("/reports/"), k.cast("string")).alias("url"),
        F.concat("r_name", F.lit(" — "), "n_name", F.lit(" "), "o_orderpriority", F.lit(" Report Round "), (k % 60).cast("string"), F.lit(" ("), told, F.lit(")")).alias("title"),
        F.concat(F.lit("The "), "p_name", F.lit(" of "), F.element_at(F.array(*[F.lit(x) for x in STATE_NAMES]), (k % 25 + 1).cast("int")), F.when(k % 4 == 0, " State").otherwise(""), F.when(k % 3 == 0, " saw fewer delays.").otherwise(" went on near Ringville."), F.lit(" More in Widgetby.")).alias("summary"),
        F.when(k % 5 == 0, F.concat(F.lit("no date | "), F.date_format(day, "MMM d, yyyy"))).when(k % 5 == 1, F.concat(F.date_format(day, "d MMM yyyy"), F.lit(" | 2001-01-01T00:00"))).when(k % 5 == 2, F.concat(F.date_format(F.date_add(day, 900), "yyyy-MM-dd"), F.lit("T10:00"))).otherwise("").alias("date_raw"),
        F.when(k % 7 != 0, F.date_format(day, "yyyy-MM-dd")).alias("date"),
        F.when(k % 2 == 0, F.date_format(F.date_add(day, F.when(k % 3 == 0, 900).otherwise(1)), "yyyy-MM-dd")).alias("fetched"),
        k.alias("key"), F.col("n_name").alias("nation"), F.col("r_name").alias("zone"), (k % 60).cast("int").alias("round"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.year(day).alias("year"),
    )


V1 = f"""report_titles AS (
  SELECT '/reports/' || o_orderkey AS url,
    r_name || ' — ' || n_name || ' ' || o_orderpriority || ' Report Round ' || (o_orderkey % 60) || ' (' || strftime(day, '%-d %B %Y') || ')' AS title,
    'The ' || p_name || ' of ' || {STATE_NAMES!r}[o_orderkey % 25 + 1] || CASE WHEN o_orderkey % 4 = 0 THEN ' State' ELSE '' END
      || CASE WHEN o_orderkey % 3 = 0 THEN ' saw fewer delays.' ELSE ' went on near Ringville.' END || ' More in Widgetby.' AS summary,
    CASE o_orderkey % 5 WHEN 0 THEN 'no date | ' || strftime(day, '%b %-d, %Y') WHEN 1 THEN strftime(day, '%-d %b %Y') || ' | 2001-01-01T00:00'
      WHEN 2 THEN strftime(day + 900, '%Y-%m-%d') || 'T10:00' ELSE '' END AS date_raw,
    CASE WHEN o_orderkey % 7 <> 0 THEN strftime(day, '%Y-%m-%d') END AS date,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(day + CASE WHEN o_orderkey % 3 = 0 THEN 900 ELSE 1 END, '%Y-%m-%d') END AS fetched,
    o_orderkey AS key, n_name AS nation, r_name AS zone, (o_orderkey % 60)::INT AS round, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority, year(day)::INT AS year
  FROM (SELECT *, (o_orderdate::DATE + INTERVAL 18 YEAR)::DATE AS day FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON o_orderkey % 200 + 1 = p_partkey)"""

#: Normalised text in SQL; {0} is the text.
NORM = r"""(' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[‐-―]', '-', 'g'), '[^\p{{L}}\p{{N}}_&/\-\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' ')"""
TITLE_KEY = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def states_sql(text: str) -> str:
    parts = ", ".join(rf"CASE WHEN regexp_matches({text}, '(?i){TAXONOMY.pattern(s)}') THEN '{s}' END" for s in TAXONOMY.states)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


V1B = r"""dup_titles AS (
  SELECT url, date, CASE WHEN floor(key / 60)::INT % 2 = 0 THEN zone || ' — ' || priority || ' Report Round ' || round ELSE lower(zone) || ': ' || priority || '  report, round #' || round END AS title FROM report_titles)"""


def dup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = report_titles(spark, sf_dir)
    odd = F.floor(F.col("key") / 60).cast("int") % 2 == 0
    a = F.concat("zone", F.lit(" — "), "priority", F.lit(" Report Round "), F.col("round").cast("string"))
    b = F.concat(F.lower("zone"), F.lit(": "), "priority", F.lit("  report, round #"), F.col("round").cast("string"))
    return v.select("url", "date", F.when(odd, a).otherwise(b).alias("title"))


def fact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: url, page, summary, pdf: sentences with figures, shares, years and averages."""
    o = spread(read(spark, sf_dir, "orders"))
    k, p = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    s = lambda c: c.cast("string")
    return o.select(
        F.concat(F.lit("/reports/"), s(k)).alias("url"),
        F.concat(F.lit("The flood affected "), F.format_number(p, 0), F.lit(" individuals and displaced "), s(k % 977), F.lit(" households in "), s(k % 13), F.lit(" locations. In 2019 there were "), F.format_number(p % 90000, 0), F.lit(" IDPs in "), s(k % 40), F.lit(" camps; about 35% of people fled.")).alias("page"),
        F.concat(F.lit("An average of "), s(k % 9), F.lit(" persons per household was seen in "), s(k % 31), F.lit(" wards. The flood affected "), F.format_number(p, 0), F.lit(" individuals and displaced "), s(k % 977), F.lit(" households in "), s(k % 13), F.lit(" locations.")).alias("summary"),
        F.concat(F.lit("Returnees were registered in "), F.format_number(p % 7000, 0), F.lit(" households. New sites hosted "), s(k % 500 + 3), F.lit(" women and "), s(k % 300 + 2), F.lit(" children.")).alias("pdf"),
    )


V3 = r"""fact_text AS (
  SELECT '/reports/' || o_orderkey AS url,
    'The flood affected ' || format('{:,}', p) || ' individuals and displaced ' || (o_orderkey % 977) || ' households in ' || (o_orderkey % 13) || ' locations. In 2019 there were ' || format('{:,}', p % 90000) || ' IDPs in ' || (o_orderkey % 40) || ' camps; about 35% of people fled.' AS page,
    'An average of ' || (o_orderkey % 9) || ' persons per household was seen in ' || (o_orderkey % 31) || ' wards. The flood affected ' || format('{:,}', p) || ' individuals and displaced ' || (o_orderkey % 977) || ' households in ' || (o_orderkey % 13) || ' locations.' AS summary,
    'Returnees were registered in ' || format('{:,}', p % 7000) || ' households. New sites hosted ' || (o_orderkey % 500 + 3) || ' women and ' || (o_orderkey % 300 + 2) || ' children.' AS pdf
  FROM (SELECT *, floor(o_totalprice)::BIGINT AS p FROM orders))"""


def round_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: round, state, lga, ward, kind and four measures."""
    t = lambda n: read(spark, sf_dir, n)
    l = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    q = F.col("l_quantity").cast("long")
    return l.select(
        (F.col("o_orderkey") % 19).cast("int").alias("round"), F.when(F.col("o_orderkey") % 50 != 0, F.concat(F.lit(" "), F.lower("n_name"))).alias("state"), F.col("l_suppkey").alias("lga"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")).alias("ward"), F.col("l_returnflag").alias("kind"),
        q.alias("idp_ind"), F.floor(q / 5).cast("long").alias("idp_hh"), F.when(F.col("o_orderkey") % 19 > 5, q * 2).otherwise(0).cast("long").alias("ret_ind"), F.when(F.col("o_orderkey") % 19 > 5, F.floor(q / 3)).otherwise(0).cast("long").alias("ret_hh"),
    )


V5 = r"""round_state AS (
  SELECT (o_orderkey % 19)::INT AS round, CASE WHEN o_orderkey % 50 <> 0 THEN ' ' || lower(n_name) END AS state, l_suppkey AS lga, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey END AS ward, l_returnflag AS kind,
    l_quantity::BIGINT AS idp_ind, floor(l_quantity::BIGINT / 5)::BIGINT AS idp_hh, CASE WHEN o_orderkey % 19 > 5 THEN l_quantity::BIGINT * 2 ELSE 0 END::BIGINT AS ret_ind, CASE WHEN o_orderkey % 19 > 5 THEN floor(l_quantity::BIGINT / 3) ELSE 0 END::BIGINT AS ret_hh
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def ring_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: name, poly, ring, seq, x, y."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("S"), (k % 5).cast("string")).alias("name"), (F.floor(k / 5) % 5).cast("int").alias("poly"), F.when(F.floor(k / 25) % 7 == 6, 1).otherwise(0).cast("int").alias("ring"), k.alias("seq"), (F.floor(F.col("o_custkey") / 20) % 60 / 4).alias("x"), (F.floor(F.col("o_totalprice") / 90000) / 2).alias("y"))


V6 = r"""ring_points AS (
  SELECT 'S' || (o_orderkey % 5) AS name, (o_orderkey // 5 % 5)::INT AS poly, CASE WHEN o_orderkey // 25 % 7 = 6 THEN 1 ELSE 0 END::INT AS ring, o_orderkey AS seq, (o_custkey // 20 % 60) / 4.0::DOUBLE AS x, floor(o_totalprice / 90000) / 2.0::DOUBLE AS y FROM orders)"""


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: url, v, fetched, from_listing_only, title, date, from the events table."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.concat(F.lit("/reports/"), (e % 4000).cast("string")).alias("url"), F.when(e % 6 != 0, (e % 4).cast("int")).alias("v"), F.when(e % 9 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("fetched"), (F.col("event_type") == "error").alias("from_listing_only"), F.concat(F.lit("Event "), F.col("user_id").cast("string")).alias("title"), F.date_format(F.date_add(F.to_date("ts"), (e % 31).cast("int")), "yyyy-MM-dd").alias("date"), e.alias("event_id"))


V7 = r"""cache_rows AS (
  SELECT '/reports/' || (event_id % 4000) AS url, CASE WHEN event_id % 6 <> 0 THEN (event_id % 4)::INT END AS v, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS fetched, event_type = 'error' AS from_listing_only, 'Event ' || user_id AS title, strftime(ts::DATE + (event_id % 31)::INT, '%Y-%m-%d') AS date, event_id FROM events)"""


def links(orders: DataFrame) -> DataFrame:
    """src, dst of orders."""
    return orders.select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7 + 3) % 1500).alias("dst")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: src, dst."""
    return links(read(spark, sf_dir, "orders"))


V8 = "edges AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7 + 3) % 1500 AS dst FROM orders)"


#: Code points of a page of V9.
PAGE_CHARS = 1500


def _literal(text: bytes) -> bytes:
    return b"(" + text.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def pdf_of(text: str, kind: int) -> bytes:
    """A PDF of pages of PAGE_CHARS code points, a line set for each line. kind 0 and 1: literal strings where they can, plain or
    deflated; 2: coded strings with a ToUnicode map, objects in a stream; 3: the same, strings in pieces with gaps."""
    simple = kind < 2 and all(c in "\n" or 32 <= ord(c) < 127 or 160 <= ord(c) < 256 for c in text)
    codes = {c: k + 1 for k, c in enumerate(sorted(set(text)))}

    def coded(line: str) -> bytes:
        if simple:
            return _literal(line.encode("cp1252")) + b" Tj"
        if kind == 3:
            cut = [line[k : k + 7] for k in range(0, len(line), 7)]
            return b"[" + b" -20 ".join(b"<" + b"".join(b"%04x" % codes[c] for c in x) + b">" for x in cut) + b"] TJ"
        return b"<" + b"".join(b"%04x" % codes[c] for c in line) + b"> Tj"

    packed = lambda data, more=b"": b"<</Length %d/Filter/FlateDecode%s>>stream\n%s\nendstream" % (len(x := zlib.compress(data, 1)), more, x)
    plain = lambda data: b"<</Length %d>>stream\n%s\nendstream" % (len(data), data)
    pages = [text[k : k + PAGE_CHARS] for k in range(0, max(1, len(text)), PAGE_CHARS)]
    objects: dict[int, bytes] = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Resources<</Font<</F1 3 0 R>>>>/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages))))}
    if simple:
        objects[3] = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"
    else:
        objects[3] = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R>>"
        chars = b"\n".join(b"<%04x> <%s>" % (k, c.encode("utf-16-be", "replace").hex().encode()) for c, k in codes.items())
        objects[4] = packed(b"begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange %d beginbfchar\n%s\nendbfchar endcmap" % (len(codes), chars))
    for k, page in enumerate(pages):
        shown = b"BT /F1 11 Tf 14 TL 50 780 Td\n" + b" T*\n".join(coded(x) for x in page.split("\n")) + b"\nET"
        objects[5 + 2 * k] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (6 + 2 * k)
        objects[6 + 2 * k] = packed(shown) if kind else plain(shown)
    if kind >= 2:
        inner = {n: o for n, o in objects.items() if b"stream" not in o}
        objects = {n: o for n, o in objects.items() if n not in inner}
        bodies, at, heads = b"", 0, []
        for n, o in inner.items():
            heads.append(b"%d %d" % (n, at))
            bodies, at = bodies + o + b"\n", at + len(o) + 1
        head = b" ".join(heads) + b"\n"
        last = max([*inner, *objects]) + 1
        objects[last] = packed(head + bodies, b"/Type/ObjStm/N %d/First %d" % (len(inner), len(head)))
        rows = b"".join(b"\x02" + bytes(4) for _ in range(last))
        objects[last + 1] = packed(rows, b"/Type/XRef/Root 1 0 R/Size %d/W[1 3 0]/DecodeParms<</Predictor 12/Columns 4>>" % (last + 2))
    out, places = b"%PDF-1.5\n", {}
    for n, o in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    if kind < 2:
        table = b"".join(b"%010d 00000 n \n" % places.get(n, 0) for n in range(1, max(objects) + 1))
        out += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d/Root 1 0 R>>\n" % (max(objects) + 1, table, max(objects) + 1)
    return out + b"startxref\n%d\n%%%%EOF" % places.get(max(objects), 0)


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: path (the doc_id), content: each document as a PDF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [pdf_of(t or "", (k or 0) % 4) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "path long, content binary")
