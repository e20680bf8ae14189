"""One large JSON file as rows: the entries of a map, or the items of a list inside a document, split over tasks.

A JSON file can't be cut at a line end. Here it is cut anywhere, in ranges of bytes. A first pass finds for each range, once as if it
began outside a string and once inside, whether it ends in a string, by how much brackets nest deeper, and where the wanted list's name stands;
a running sum over these few numbers a range tells where each range begins: in or outside a string, and how deep. In a second pass each
range gives the entries that begin in it, and reads on behind its end until the last of them is whole. Both passes scan with array operations; only
entries are parsed, one at a time.

Defined results: a map's entries are (key, value), a list's have null keys; values are JSON text, as they stand; of a key that stands twice both
entries come; empty maps and lists give no rows; a file that isn't well-formed around its entries raises ValueError or fails its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workbook import opened

#: Bytes of a range, of one read behind its end, and rows of a batch.
RANGE_BYTES = 32 << 20
MORE_BYTES = 1 << 20
BATCH_ROWS = 1000
QUOTE, SLASH = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def escaped(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes stand behind an odd run of backslashes; before: backslashes right before the data."""
    out = np.zeros(len(data), bool)
    slashes = np.flatnonzero(data == SLASH)
    if before % 2 and len(data):
        out[0] = True
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        last = np.append(first[1:], len(slashes)) - 1
        runs = last - first + 1 + np.where(slashes[first] == 0, before, 0)
        ends = slashes[last] + 1
        odd = ends[(runs % 2 == 1) & (ends < len(data))]
        if slashes[first[0]] == 0 and before % 2:
            out[0] = False  # a backslash itself; its run was counted from before
        out[odd] = True
    return out


def scanned(data: np.ndarray, before: int, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is each byte in a string, a closing quote too and an opening one not; how deep it nests behind each byte), from where the data begins."""
    quotes = (data == QUOTE) & ~escaped(data, before)
    passed = np.cumsum(quotes) + inside
    within = (passed - quotes) % 2 == 1
    return within, np.cumsum(np.where(within | quotes, 0, _STEP[data]))


@dataclass
class Part(InputPartition):
    def __init__(self, first: int, last: int, inside: bool = False, depth: int = 0, begin: int = 0, end: int = 0):
        self.first, self.last, self.inside, self.depth, self.begin, self.end = first, last, inside, depth, begin, end


class JsonSource(DataSource):
    """Options: path, range_bytes, and for the second pass parts (JSON of where ranges begin)."""

    @classmethod
    def name(cls) -> str:
        return "big_json"

    def schema(self) -> str:
        return "key string, value string" if "parts" in self.options else "first long, inside boolean, ends_inside boolean, deeper int, lowest array<struct<at:long,depth:int>>"

    def reader(self, schema) -> DataSourceReader:
        return Entries(dict(self.options)) if "parts" in self.options else Summaries(dict(self.options))


class Summaries(DataSourceReader):
    """The first pass. lowest: places of the wanted name (as a quoted string) and how deep they are."""

    def __init__(self, options: dict):
        self.path, self.size, self.name = options["path"], int(options["range_bytes"]), options.get("field", "")

    def partitions(self) -> list[Part]:
        fs, path = opened(self.path)
        total = fs.get_file_info(path).size
        return [Part(a, min(total, a + self.size)) for a in range(0, total, self.size)] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            data, before = piece(f, part.first, part.last)
            mark = json.dumps(self.name).encode()
            # A name that goes over the end of the range is this range's.
            text = data.tobytes() + (f.read_at(len(mark), part.last) if self.name and part.last > part.first else b"")[: max(0, len(mark) - 1)]
        for inside in (False, True):
            within, depth = scanned(data, before, inside)
            found, at = [], text.find(mark) if self.name else -1
            while at >= 0:
                if at < len(data) and not within[at]:
                    found.append((part.first + at, int(depth[at])))
                at = text.find(mark, at + 1)
            quotes = int(((data == QUOTE) & ~escaped(data, before)).sum())
            yield part.first, inside, bool((quotes + inside) % 2), int(depth[-1]) if len(depth) else 0, found


def piece(f, first: int, last: int) -> tuple[np.ndarray, int]:
    """The bytes of a range, and how many backslashes stand right before it."""
    before, at = 0, first
    while at > 0:
        lead = f.read_at(min(at, 64), at - min(at, 64))
        run = len(lead) - len(lead.rstrip(b"\\"))
        before += run
        if run < len(lead):
            break
        at -= len(lead)
    return np.frombuffer(f.read_at(last - first, first), np.uint8), before


class Entries(DataSourceReader):
    """The second pass: entries that begin in a range."""

    def __init__(self, options: dict):
        self.path, self.parts, self.keyed = options["path"], json.loads(options["parts"]), options["keyed"] == "true"

    def partitions(self) -> list[Part]:
        return [Part(*p) for p in self.parts] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.last <= part.first:
            return
        fs, path = opened(self.path)
        rows: list[tuple] = []
        with fs.open_input_file(path) as f:
            for text in self.texts(f, part):
                text = text.strip()
                if not text:
                    continue
                if self.keyed:
                    key, at = json.JSONDecoder().raw_decode(text)
                    value = text[at:].lstrip()
                    if not isinstance(key, str) or value[:1] != ":":
                        raise ValueError(f"{self.path}: no entry of a map: {text[:80]}")
                    rows.append((key, value[1:].strip()))
                else:
                    rows.append((None, text))
                if len(rows) >= BATCH_ROWS:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["key", "value"])

    def texts(self, f, part: Part) -> Iterator[str]:
        """Entries between separators: the container's opening bracket and commas on its level begin one, the next or its closing bracket ends it."""
        at, last, inside, depth, held, begun = part.first, part.last, part.inside, part.depth, b"", False
        while at < part.end:
            data, before = piece(f, at, last)
            if not len(data):
                break
            within, nested = scanned(data, before, inside)
            nested = nested + depth
            places = np.arange(at, at + len(data))
            opening = places == part.begin
            comma = (data == ord(",")) & ~within & (nested == 1)
            closing = places == part.end - 1
            cuts = np.flatnonzero((opening | comma | closing) & (places >= part.begin) & (places < part.end))
            raw, start = data.tobytes(), 0
            for cut in cuts.tolist():
                if begun:
                    yield (held + raw[start:cut]).decode()
                held, start = b"", cut + 1
                # What begins behind the range's end is the next range's.
                begun = at + cut < part.last and not closing[cut]
                if not begun:
                    return
            if begun:
                held += raw[start:]
            elif at >= part.last:
                return
            quotes = int(((data == QUOTE) & ~escaped(data, before)).sum())
            inside, depth, at, last = bool((quotes + inside) % 2), int(nested[-1]), last, last + MORE_BYTES
            if at >= part.last and not begun:
                return


def entries(spark: SparkSession, path: str, field: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """key, value of the file's map, or of the map or list that stands under a name of it. Driver: a few numbers a range."""
    spark.dataSource.register(JsonSource)
    read = spark.read.format("big_json").option("path", path).option("range_bytes", str(range_bytes))
    told = {(r.first, r.inside): r for r in (read.option("field", field) if field else read).load().collect()}
    starts, state, depth, names = sorted({a for a, _ in told}), False, 0, []
    begins = []
    for a in starts:
        r = told[a, state]
        begins.append((a, state, depth))
        names += [(x.at, depth + x.depth) for x in r.lowest]
        state, depth = r.ends_inside, depth + r.deeper
    if state or depth:
        raise ValueError(f"{path}: brackets or quotes that don't close")
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        total = f.size()
        begin = _value_at(f, 0, total)
        if field:
            behind = [_value_at(f, a + len(json.dumps(field).encode()), total) for a, d in names if d == 1]
            named = [k for k in behind if f.read_at(1, k) == b":"]  # the rest are values of that text
            begin = _value_at(f, named[0] + 1, total) if named else total
        kind = f.read_at(1, begin) if begin < total else b""
    if kind not in (b"{", b"["):
        return spark.createDataFrame([], "key string, value string")
    base = 1 if field else 0
    ends = [*starts[1:], total]
    # The container ends where the whole file does, but for what follows it; each range looks for the end by depth.
    parts = [(a, b, inside, deep - base, begin) for (a, inside, deep), b in zip(begins, ends)]
    end = _end(spark, path, begin, parts, base, total)
    kept = [(*p, end) for p in parts if p[1] > begin and p[0] < end]
    return spark.read.format("big_json").options(path=path, parts=json.dumps(kept), keyed=str(kind == b"{").lower()).load()


def _value_at(f, at: int, total: int) -> int:
    """The next place that is no white space."""
    while at < total:
        data = f.read_at(4096, at)
        for k, c in enumerate(data):
            if c not in b" \t\r\n\xef\xbb\xbf":
                return at + k
        at += len(data)
    return total


def _end(spark: SparkSession, path: str, begin: int, parts: list[tuple], base: int, total: int) -> int:
    """The place behind the container's closing bracket: the first range in which the depth comes back to 0 tells it."""
    rows = [(a, b, inside, deep) for a, b, inside, deep, _ in parts if b > begin]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(path)
        for batch in batches:
            out = []
            with fs.open_input_file(at) as f:
                for a, b, inside, deep in zip(*(c.to_pylist() for c in batch.columns)):
                    data, before = piece(f, a, b)
                    within, nested = scanned(data, before, inside)
                    places = np.flatnonzero((nested + deep == 0) & (_STEP[data] < 0) & ~within) + a
                    places = places[places > begin]
                    out += places[:1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["at"])

    ranges = spark.createDataFrame(rows, "a long, b long, inside boolean, deep int").repartition(max(1, len(rows)))
    return (ranges.mapInArrow(run, "at long").agg(F.min("at").alias("at")).first()["at"] or total - 1) + 1
