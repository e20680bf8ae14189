"""Secret scans: base patterns, and credentials whose parts are linked by an interval join within scopes.

Three base kinds are reported wherever they stand. The linking adds what would be noise alone: a weak secret
(a 40-character base64-like word, or a short assigned value) is reported only where an access identifier or an
endpoint with a credential role stands in the same scope. A scope is the stretch of REACH code points on either
side of a part, cut at blank lines; identifiers, secrets and endpoints of a text are sorted by place, and each
weak secret is joined with the intervals of its complements by binary search, so that no pairs are listed.
A document is the unit of all scopes, so that the scan needs no shuffle.

Defined results: null and empty texts have no spans and the digest of no bytes; repeated rows give repeated
results; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, texts

#: The base kinds, in the order of ties.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Weak parts: a base64-like word of 40 characters; a shorter value that a keyword assigns; an endpoint.
WEAK = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
SHORT = (6, 11)
ENDPOINT = re.compile(r"(?:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|s3)://[^\s\"'<>|]+|(?:host|endpoint|server)\x20*[:=]\x20*[A-Za-z0-9.-]+", re.A)
BLANK = re.compile(r"\n[^\S\n]*\n")
#: Code points on either side of a part that belong to its scope.
REACH = 400
#: A weak base64-like word must hold all of these, so that long plain words aren't taken for keys.
MIXED = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))

Span = tuple[int, int, str]


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, short assigned values): spans are (start, end, kind)."""
    out, short = [], []
    for m in ASSIGN.finditer(text):
        size = m.end(2) - m.start(2)
        if size >= LEAST["assign"]:
            out.append((m.start(), m.end(), "assign"))
        elif SHORT[0] <= size <= SHORT[1]:
            short.append((m.start(), m.end(), "weak_assign"))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out, short


def linked_spans(text: str, base: list[Span], short: list[Span], reach: int = REACH) -> list[Span]:
    """Weak secrets and endpoints whose complement stands in their scope."""
    ids = [x for x in base if x[2] == "access"]
    strong = [x for x in base if x[2] == "assign"]
    weak = short + [(m.start(), m.end(), "weak_key") for m in WEAK.finditer(text) if all(p.search(m[0]) for p in MIXED)]
    ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if ids or weak or strong else []
    if not (weak or ends):
        return []
    cuts = [m.start() for m in BLANK.finditer(text)]

    def scope(a: int, b: int) -> tuple[int, int]:
        k = bisect_left(cuts, a)
        return max(a - reach, cuts[k - 1] if k else 0), min(b + reach, cuts[k] if k < len(cuts) else len(text))

    def near(x: Span, places: list[Span]) -> bool:
        lo, hi = scope(x[0], x[1])
        k = bisect_left(places, (lo,))
        while k < len(places) and places[k][0] < hi:
            if places[k][1] <= hi and (places[k][1] <= x[0] or places[k][0] >= x[1]):
                return True
            k += 1
        return False

    found = []
    for x in weak:
        if near(x, ids) or near(x, ends):
            found.append(x)
    secret = sorted([*strong, *found])
    found += [x for x in ends if near(x, ids) and near(x, secret)]
    return sorted(found)


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    base, short = base_spans(text)
    return base, linked_spans(text, base, short)


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, base and linked (arrays of kind, start, end; code points, end exclusive)."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        row = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [scan_text(t) for t in texts(batch, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([row(x) for x, _ in both], kind), pa.array([row(y) for _, y in both], kind)], [id_col, "base", "linked"])

        return work

    rows = docs.select(id_col, text_col)
    return map_batches(rows, make, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, base array<struct<kind:string,start:int,end:int>>, linked array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame) -> DataFrame:
    """The table with each found span of its texts replaced by [kind]; overlapping spans are replaced as one.
    Rows, columns and their order stay; n_chars, where there is such a column, follows the new text."""
    columns = docs.columns
    at = columns.index("text")
    sizes = columns.index("n_chars") if "n_chars" in columns else -1

    def make():
        def clean(text: str | None) -> str | None:
            if not text:
                return text
            base, linked = scan_text(text)
            out, to = [], 0
            for a, b, kind in sorted([*base, *linked]):
                if a >= to:
                    out += [text[to:a], f"[{kind}]"]
                to = max(to, b)
            return "".join([*out, text[to:]]) if out else text

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = [clean(t) for t in batch.column(at).to_pylist()]
            out = list(batch.columns)
            out[at] = pa.array(new, batch.schema.field(at).type)
            if sizes >= 0:
                old = out[sizes].to_pylist()
                out[sizes] = pa.array([n if t is None or n is None else len(t) for n, t in zip(old, new)], batch.schema.field(sizes).type)
            return pa.RecordBatch.from_arrays(out, schema=batch.schema)

        return work

    return map_batches(docs, make, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    put = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    order = {"assign": 0, "access": 1, "hex": 2}
    rank = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(n)) for k, n in order.items()], F.lit(9))
    every = F.transform(
        F.array_sort(F.transform(F.concat("base", "linked"), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(put("base").cast("binary"), 256).alias("base_sha256"), put(every).alias("spans"))
