"""Workbooks (.xlsx): a Spark data source that plans a partition for each sheet and range of rows, and a sink of one workbook a task.

`spark.read.format("workbook")` gives the rows of all sheets, or of one (option sheet), of a file or of a folder's .xlsx files: file, sheet,
row (from 1) and cells, an array of strings with nulls for cells that aren't there. Shared, inline and formula strings are read,
true and false are TRUE and FALSE, numbers keep their digits, and numbers in a date format are ISO dates. A task inflates its sheet as a
stream, passes over the rows before its range without parsing them, and stops behind it; what it holds is one batch of rows and the file's
shared strings. `sheet` makes a table with names and types of one sheet by its header row: with options names (a list as JSON) and header_row
the source gives the cells below those names, one string column each, and reads plain rows many at a time in numpy.

Defined results: sheets without rows give none; rows and cells without a place of their own follow the one before; an error value is
null; a damaged file fails its task; an empty folder gives an empty table.
"""

from __future__ import annotations

import datetime
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, row int, cells array<string>"
#: Rows of a partition, of a batch, and the most of a sheet.
PART_ROWS = 100_000
BATCH_ROWS = 2000
#: Bytes of a sheet whose plain rows are read at a time.
BLOCK = 1 << 20
SHEET_ROWS = 1_048_576
#: Fixed values of the format: built-in number formats that are dates, and where days begin (the 1900 system counts a 29 February 1900).
DATE_FORMATS = frozenset([*range(14, 23), 27, 30, 36, 45, 46, 47, 50, 57])
DAY_ONE = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}

_ROW = re.compile(rb"<(?:\w+:)?row[\s>/]")
_PLACE = re.compile(rb'<(?:\w+:)?row\s[^>]*?\br="(\d+)"')
#: A row of plain cells in order: a place, an optional kind that is no date's, and a value without markup.
_PLAIN_ROW = re.compile(rb'<row r="(\d+)">((?:<c r="[A-Z]{1,3}\d+"(?: t="s")?><v>[^<&]*</v></c>)*)</row>')
_PLAIN_CELL = re.compile(r'<c r="([A-Z]+)\d+"( t="s")?><v>([^<]*)</v></c>')
_CODES = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _tag(x: ET.Element) -> str:
    return x.tag.rpartition("}")[2]


class Book:
    """The parts of one open workbook."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        names = set(self.zip.namelist())
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        at = {x.get("Id"): x.get("Target") for x in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {}
        for x in book.iter():
            if _tag(x) == "sheet":
                target = at[next(v for k, v in x.attrib.items() if k.endswith("}id"))]
                self.sheets[x.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.base = DAY_ONE[any(_tag(x) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book.iter())]
        self.dates = self._dates() if "xl/styles.xml" in names else set()
        self.has_strings = "xl/sharedStrings.xml" in names
        self._strings: list[str] | None = None
        self._told: pa.Array | None = None  # the same in Arrow

    def _dates(self) -> set[int]:
        """The cell styles that show dates."""
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): _CODES.sub("", x.get("formatCode", "")).lower() for x in root.iter() if _tag(x) == "numFmt"}
        known = lambda n: any(c in own[n] for c in "ymdhs") if n in own else n in DATE_FORMATS
        styles = next((x for x in root if _tag(x) == "cellXfs"), ())
        return {k for k, x in enumerate(styles) if known(int(x.get("numFmtId", 0)))}

    @property
    def strings(self) -> list[str]:
        """The shared strings, read once; phonetic hints are no part of them."""
        if self._strings is None:
            self._strings = []
            if self.has_strings:
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, x in ET.iterparse(f):
                        if _tag(x) == "rPh":
                            x.clear()
                        elif _tag(x) == "si":
                            self._strings.append("".join(t.text or "" for t in x.iter() if _tag(t) == "t"))
                            x.clear()
        return self._strings

    def row_count(self, sheet: str) -> int:
        """The last row as our writer notes it beside the sheet, by the sheet's own dimension, or by counting its row elements."""
        if m := re.fullmatch(rb"rows (\d+)", self.zip.getinfo(self.sheets[sheet]).comment):
            return int(m[1])
        with self.zip.open(self.sheets[sheet]) as f:
            head = f.read(4096)
            if m := re.search(rb'<(?:\w+:)?dimension\s[^>]*ref="(?:[A-Z]+\d+:)?[A-Z]+(\d+)"', head):
                return int(m[1])
            count, rest = 0, b""
            while head:
                count += len(_ROW.findall(rest + head))
                rest, head = b"".join((rest + head)[-8:].rpartition(b"<")[1:]), f.read(1 << 20)
                if _ROW.match(rest):  # it is counted
                    rest = b""
            return count

    def value(self, cell: ET.Element) -> str | None:
        kind, v = cell.get("t", "n"), next((x.text for x in cell if _tag(x) == "v"), None)
        if kind == "inlineStr":
            return "".join(x.text or "" for x in cell.iter() if _tag(x) == "t")
        if v is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v)]
        if kind == "b":
            return "TRUE" if v.strip() == "1" else "FALSE"
        if kind == "n" and int(cell.get("s", 0)) in self.dates:
            return self.moment(v)
        return v

    def moment(self, v: str) -> str:
        moment = self.base + datetime.timedelta(seconds=round(float(v) * 86400))
        return moment.isoformat(sep=" ") if moment.time() != datetime.time() else moment.date().isoformat()

    def rows(self, sheet: str, first: int, last: int) -> Iterator[tuple[int, list[str | None]]]:
        """(row, cells) from one row to another."""
        with self.zip.open(self.sheets[sheet]) as f:
            number, rest, begun, fed = 0, b"", False, False
            parser: ET.XMLPullParser | None = None
            while data := f.read(1 << 18):
                data = rest + data
                if parser is None:  # rows are parsed without the sheet around them, but for the prefixes that it declares
                    parser = ET.XMLPullParser(["end"])
                    root = re.search(rb"<(?:\w+:)?worksheet\b[^>]*>", data)
                    parser.feed(b"<rows " + b" ".join(re.findall(rb"""xmlns(?::\w+)?\s*=\s*(?:"[^"]*"|'[^']*')""", root[0])) + b">")
                if not begun:
                    # Until the range begins, rows are only told apart; the last row of what was read may go on in the next.
                    starts = [m.start() for m in _ROW.finditer(data)]
                    for k, at in enumerate(starts[:-1]):
                        m = _PLACE.match(data, at, starts[k + 1])
                        number = int(m[1]) if m else number + 1
                        if number >= first:
                            begun, data, number = True, data[at:], number - 1
                            break
                    else:
                        rest = data[starts[-1] :] if starts else data[-64:]
                        continue
                rest = b""
                data, over = self._until_end(data)
                if not fed:
                    # Rows of plain cells are told by a pattern; at the first that is more, the parser goes on to the end.
                    at = 0
                    while m := _PLAIN_ROW.match(data, at):
                        at, number = m.end(), int(m[1])
                        if number > last:
                            return
                        if number >= first:
                            yield number, self._plain_cells(m[2].decode())
                    if over and at == len(data):
                        return
                    data = data[at:]
                    if not over and (b"<row ".startswith(data[:5]) or data.startswith(b"</")) and b"</row>" not in data and len(data) < 1 << 18:
                        rest = data  # a row, or the sheet's end, that goes on in what is read next
                        continue
                    fed = True
                parser.feed(data)
                for row in self._parsed(parser, number, first, last):
                    number = row[0]
                    if number > last:
                        return
                    yield row
                if over:
                    return
            if rest and parser is not None:
                at = _ROW.search(rest)
                if at:
                    parser.feed(self._until_end(rest[at.start() :])[0])
                    yield from (r for r in self._parsed(parser, number, first, last) if first <= r[0] <= last)

    def columns(self, sheet: str, first: int, last: int, names: list[str], header: int) -> Iterator[list[pa.Array]]:
        """The cells below these names of the header row, as strings, of rows with any value from one row to another; plain rows many at a time,
        and from the first block that is more row by row."""
        heads = next((cells for _, cells in self.rows(sheet, header, header)), None)
        if heads is None:
            return
        heads = [x and x.strip(" ") for x in heads]
        places = [heads.index(x) if x in heads else -1 for x in names]
        first, seen = max(first, header + 1), 0
        for block in self._plain_blocks(sheet):
            found = block and self._plain_table(block, first, last, places)
            if not found:
                break
            count, over, arrays = found
            seen += count
            if len(arrays[0]):
                yield arrays
            if over:
                return
        else:
            return
        held: list[list[str | None]] = []
        for _, cells in islice(self.rows(sheet, first, last), seen, None):
            if any(x is not None for x in cells):
                held.append([cells[k] if 0 <= k < len(cells) else None for k in places])
            if len(held) >= BATCH_ROWS:
                yield [pa.array(c, pa.string()) for c in zip(*held)]
                held = []
        if held:
            yield [pa.array(c, pa.string()) for c in zip(*held)]

    def _plain_blocks(self, sheet: str) -> Iterator[bytes | None]:
        """The sheet's rows in blocks of whole ones; None, and no more, where what is read isn't told as rows."""
        with self.zip.open(self.sheets[sheet]) as f:
            data = f.read(BLOCK)
            at = data.find(b"<sheetData>")
            rest = data[at + 11 :] if at >= 0 else b""
            while at >= 0:
                cut = rest.rfind(b"</row>") + 6
                if cut > 5:
                    yield rest[:cut]
                    rest = rest[cut:]
                if rest.startswith(b"</sheetData>"):
                    return
                data = f.read(BLOCK)
                if not data:
                    break
                rest += data
            yield None

    def _plain_table(self, block: bytes, first: int, last: int, places: list[int]) -> tuple[int, bool, list[pa.Array]] | None:
        """Of a block of plain rows in order: how many lie in the range, whether it ends here, and the columns at these places of those with any value;
        None where anything is more than a plain cell (a place, an optional kind that is no date's, a value without markup)."""
        b = np.frombuffer(block, np.uint8)
        tags = np.flatnonzero(b == 60)
        kind = b[tags + 1]
        ends = kind == 47
        kind = np.where(ends, b[tags + 2], kind)
        of_row = kind == 114
        starts, stops = tags[of_row & ~ends], tags[of_row & ends]
        inner = tags[~of_row]
        if len(starts) != len(stops) or len(inner) % 4 or 0 in self.dates or (b == 38).any() or starts[0] != 0:
            return None
        cells, values, closes, outs = inner.reshape(-1, 4).T
        shape, shut = kind[~of_row].reshape(-1, 4), ends[~of_row].reshape(-1, 4)
        after = np.append(tags[1:], len(b))  # where a tag must be followed by the next at once
        row_ends = after[of_row & ~ends]
        told = (
            (shape == (99, 118, 118, 99)).all() and (shut == (False, False, True, True)).all()
            and (starts[1:] == stops[:-1] + 6).all() and stops[-1] + 6 == len(b) and (starts < stops).all()
            and (after[~of_row].reshape(-1, 4)[:, 3] == outs + 4).all() and (outs == closes + 4).all() and (closes > values + 3).all()
            and _are(b, starts + 2, b'ow r="') and _are(b, row_ends - 2, b'">') and _are(b, stops + 3, b"ow>")
            and _are(b, cells + 2, b' r="') and _are(b, values - 1, b">") and _are(b, values + 2, b">") and _are(b, closes + 3, b">") and _are(b, closes + 7, b">")
        )
        if not told:
            return None
        digits = row_ends - 10 - starts
        if (digits < 1).any() or (digits > 7).any():
            return None
        try:
            numbers = pc.cast(_slices(block, starts + 8, row_ends - 2), pa.int64()).to_numpy()
        except pa.ArrowInvalid:
            return None
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(np.flatnonzero(of_row & ~ends), len(tags))) // 4)
        column_of = b[cells + 6].astype(np.int64) - 64
        letters = ((column_of > 0) & (column_of < 27)).astype(np.int64)
        for k in (1, 2):
            x = b[cells + 6 + k].astype(np.int64)
            here = (letters == k) & (x >= 65) & (x <= 90)
            if not here.any():
                break
            column_of[here] = column_of[here] * 26 + x[here] - 64
            letters[here] += 1
        column_of -= 1
        quote = cells + 6 + letters + digits[row]
        shared = values == quote + 8
        if (letters == 0).any() or (b[cells + 6 + letters] - 48 > 9).any() or (quote >= values).any() or (b[quote] != 34).any() or not (shared | (values == quote + 2)).all() or not _are(b, quote[shared], b'" t="s">'):
            return None
        if (np.diff(numbers) <= 0).any() or numbers[0] < 1 or (np.diff(row * 16384 + column_of) <= 0).any() or (column_of > 16383).any():
            return None
        inside = (numbers >= first) & (numbers <= last)
        keep = inside & (np.bincount(row, minlength=len(starts)) > 0)
        at_row = np.cumsum(keep) - 1
        if not keep.all():
            column_of[~keep[row]] = -2
        out = []
        for place in places:
            mine = np.flatnonzero(column_of == place)
            strings = shared[mine]
            parts = [_slices(block, values[mine[~strings]] + 3, closes[mine[~strings]])]
            if strings.any():
                if self._told is None:
                    self._told = pa.array(self.strings, pa.string())
                parts.append(self._told.take(pc.cast(_slices(block, values[mine[strings]] + 3, closes[mine[strings]]), pa.int64())))
            source = np.full(int(keep.sum()), -1, np.int64)
            source[at_row[row[mine]]] = np.where(strings, len(parts[0]) + np.cumsum(strings) - 1, np.cumsum(~strings) - 1)
            whole = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
            out.append(whole if len(whole) == len(source) and not strings.any() else whole.take(pa.array(source, mask=source < 0)))
        return int(inside.sum()), bool(numbers[-1] > last), out

    def _plain_cells(self, row: str) -> list[str | None]:
        cells: list[str | None] = []
        dated = 0 in self.dates
        for letters, shared, v in _PLAIN_CELL.findall(row):
            place = _COLUMNS.get(letters)
            if place is None:
                place = _COLUMNS[letters] = column(letters)
            if place != len(cells):
                cells += [None] * (place - len(cells))
            cells.append(self.strings[int(v)] if shared else self.moment(v) if dated else v)
        return cells

    @staticmethod
    def _until_end(data: bytes) -> tuple[bytes, bool]:
        m = re.search(rb"</(?:\w+:)?sheetData>", data)
        return (data[: m.start()], True) if m else (data, False)

    def _parsed(self, parser: ET.XMLPullParser, number: int, first: int, last: int) -> Iterator[tuple[int, list[str | None]]]:
        for _, x in parser.read_events():
            if _tag(x) != "row":
                continue
            number = int(x.get("r", number + 1))
            cells: list[str | None] = []
            for c in x:
                if _tag(c) == "c":
                    place = column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (place - len(cells))
                    cells.append(self.value(c) if first <= number <= last else None)
            x.clear()
            yield number, cells


def _are(b: np.ndarray, at: np.ndarray, text: bytes) -> bool:
    """Whether these bytes stand at each place."""
    return all((b[at + k] == x).all() for k, x in enumerate(text))


def _slices(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of data from places to places, which are in order."""
    offsets = np.empty(2 * len(starts) + 1, np.int32)
    offsets[0:-1:2], offsets[1:-1:2], offsets[-1] = starts, ends, ends[-1] if len(ends) else 0
    # Every second one is asked for, those between lie between them.
    both = pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pc.cast(both.take(pa.array(np.arange(0, 2 * len(starts), 2))), pa.string())


def column(place: str) -> int:
    """The place of a cell's column ("A1": 0)."""
    n = 0
    for c in place:
        if c.isdigit():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


#: Places of columns by their letters, of which there are at most 16,384 in the format.
_COLUMNS: dict[str, int] = {}


@dataclass
class Rows(InputPartition):
    file: str
    sheet: str
    first: int
    last: int

    def __init__(self, file: str, sheet: str, first: int, last: int):
        self.file, self.sheet, self.first, self.last = file, sheet, first, last


class WorkbookSource(DataSource):
    """Options: path (a file, or a folder whose .xlsx files are read), sheet (a name; by default all), part_rows; names and header_row."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        names = self.options.get("names")
        return ", ".join(f"c{k} string" for k in range(len(json.loads(names)))) if names else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(dict(self.options))


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet")
        self.part_rows = int(options.get("part_rows", PART_ROWS))
        self.names, self.header_row = json.loads(options.get("names", "null")), int(options.get("header_row", 1))

    def files(self) -> list[str]:
        fs, path = opened(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [self.path]
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(f"{self.path.rstrip('/')}/{x.base_name}" for x in found if x.base_name.endswith(".xlsx") and not x.base_name.startswith(("~", ".", "_")))

    def partitions(self) -> list[Rows]:
        out = []
        for file in self.files():
            fs, path = opened(file)
            with fs.open_input_file(path) as f:
                book = Book(f)
                for sheet in book.sheets:
                    if self.sheet in (None, sheet):
                        # What a sheet says of its dimension may be too little: its last range is open.
                        starts = list(range(1, max(1, book.row_count(sheet)) + 1, self.part_rows))
                        out += [Rows(file, sheet, a, b - 1) for a, b in zip(starts, [*starts[1:], SHEET_ROWS + 1])]
        return out or [Rows("", "", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        kinds = {"file": pa.string(), "sheet": pa.string(), "row": pa.int32(), "cells": pa.list_(pa.string())}
        fs, path = opened(part.file)
        if self.names:
            with fs.open_input_file(path) as f:
                for arrays in Book(f).columns(part.sheet, part.first, part.last, self.names, self.header_row):
                    yield pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])
            return
        held: list[tuple] = []
        with fs.open_input_file(path) as f:
            for number, cells in Book(f).rows(part.sheet, part.first, part.last):
                held.append((part.file, part.sheet, number, cells))
                if len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], list(kinds))
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], list(kinds))


def read_workbook(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, sheet, row, cells."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").options(path=path, **options).load()


def sheet(spark: SparkSession, path: str, name: str, columns: str, header_row: int = 1) -> DataFrame:
    """One sheet as a table of these columns (a schema by DDL): each is found by its name in the header row of its file; a column that isn't there is
    null, and so is a value that isn't of its type. Rows up to the header and rows without any value are left out."""
    kinds = T.StructType.fromDDL(columns)
    body = read_workbook(spark, path, sheet=name, names=json.dumps(kinds.names), header_row=str(header_row))

    def typed(f: T.StructField, at: F.Column) -> F.Column:
        # 3.0 in a sheet is as whole as 3.
        return (F.coalesce(at.try_cast(f.dataType), at.try_cast("double").try_cast(f.dataType)) if isinstance(f.dataType, T.IntegralType) else at.try_cast(f.dataType)).alias(f.name)

    return body.select(*[typed(f, F.col(f"c{k}")) for k, f in enumerate(kinds)])


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


_ROOT = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_FIXED = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId3" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet {_ROOT}><fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>',
}


class BookWriter:
    """One workbook of one sheet, row by row: strings are shared, dates are days in a date style, nulls are no cells."""

    def __init__(self, file, name: str, header: list[str]):
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        for part, text in _FIXED.items():
            self.zip.writestr(part, text)
        self.zip.writestr("xl/workbook.xml", f'<workbook {_ROOT} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        self.shared: dict[str, int] = {}
        self.number = 0
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f"<worksheet {_ROOT}><sheetData>".encode())
        self.put(header)

    def put(self, row: list) -> None:
        self.number += 1
        cells = []
        for k, x in enumerate(row):
            at = f'r="{_letters(k)}{self.number}"'
            if isinstance(x, bool):
                cells.append(f'<c {at} t="b"><v>{int(x)}</v></c>')
            elif isinstance(x, datetime.datetime):
                cells.append(f'<c {at} s="2"><v>{(x.replace(tzinfo=None) - DAY_ONE[False]) / datetime.timedelta(days=1)!r}</v></c>')
            elif isinstance(x, datetime.date):
                cells.append(f'<c {at} s="1"><v>{x.toordinal() - DAY_ONE[False].toordinal()}</v></c>')
            elif isinstance(x, str):
                cells.append(f'<c {at} t="s"><v>{self.shared.setdefault(x, len(self.shared))}</v></c>')
            elif x is not None:
                cells.append(f"<c {at}><v>{x}</v></c>")
        self.sheet.write(f'<row r="{self.number}">{"".join(cells)}</row>'.encode())

    def put_all(self, columns: list[pa.Array]) -> None:
        """Rows of a batch, made column by column: only strings and moments are looked at one by one, a string that a batch repeats once."""
        n = len(columns[0])
        numbers = pc.cast(pa.array(np.arange(self.number + 1, self.number + 1 + n)), pa.string())
        parts: list = ['<row r="', numbers, '">']

        def more(*some: pa.Array | str) -> None:
            for x in some:
                if isinstance(x, str) and isinstance(parts[-1], str):
                    parts[-1] += x
                else:
                    parts.append(x)

        for k, column in enumerate(columns):
            kind, sign = column.type, ""
            if pa.types.is_string(kind) or pa.types.is_large_string(kind):
                told = column.dictionary_encode()
                values, sign = pa.array([None if x is None else str(self.shared.setdefault(x, len(self.shared))) for x in told.dictionary.to_pylist()], pa.string()).take(told.indices), ' t="s"'
            elif pa.types.is_integer(kind):
                values = pc.cast(column, pa.string())
            elif pa.types.is_boolean(kind):
                values, sign = pc.cast(pc.cast(column, pa.int8()), pa.string()), ' t="b"'
            elif pa.types.is_timestamp(kind):
                values, sign = pa.array([None if x is None else repr((x.replace(tzinfo=None) - DAY_ONE[False]) / datetime.timedelta(days=1)) for x in column.to_pylist()], pa.string()), ' s="2"'
            elif pa.types.is_date(kind):
                values, sign = pa.array([None if x is None else str(x.toordinal() - DAY_ONE[False].toordinal()) for x in column.to_pylist()], pa.string()), ' s="1"'
            else:
                values = pa.array([None if x is None else str(x) for x in column.to_pylist()], pa.string())
            cell = f'<c r="{_letters(k)}', numbers, f'"{sign}><v>', values, "</v></c>"
            if values.null_count:
                more(pc.fill_null(pc.binary_join_element_wise(*cell, ""), ""))
            else:
                more(*cell)
        more("</row>")
        rows = pc.binary_join_element_wise(*parts, "")
        self.number += n
        ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + n + 1]
        self.sheet.write(memoryview(rows.buffers()[2])[ends[0] : ends[-1]])  # a batch's rows lie one behind the other

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        # How many rows there are is known only now, and what a sheet says of it stands before them: it is noted beside it, where a reader
        # finds it without inflating the sheet.
        self.zip.getinfo("xl/worksheets/sheet1.xml").comment = b"rows %d" % self.number
        with self.zip.open("xl/sharedStrings.xml", "w", force_zip64=True) as f:
            f.write(f"<sst {_ROOT}>".encode())
            for x in self.shared:
                f.write(f'<si><t xml:space="preserve">{escape(x)}</t></si>'.encode())
            f.write(b"</sst>")
        self.zip.close()


def write_workbooks(df: DataFrame, folder: str, name: str = "Sheet1", most: int = PART_ROWS - 1) -> int:
    """Write the rows as workbooks of one sheet each into a new folder, one for each task or more where it has over `most` rows; returns how
    many. A file gets its name once it is whole, so that a task that is run again replaces what it wrote. By default a sheet is one partition
    of a reader, which would pass over the rows of those before it again for each further one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, book, file, at = TaskContext.get(), 0, None, None, None
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)

        def over() -> None:
            book.close()
            file.close()
            fs.move(at, f"{base}/part-{task.partitionId():05d}-{made:03d}.xlsx")

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                if book is None or book.number > most:
                    if book:
                        over()
                        made += 1
                    at = f"{base}/_{task.partitionId()}-{made}-{task.taskAttemptId()}"
                    file = fs.open_output_stream(at)
                    book = BookWriter(file, name, batch.schema.names)
                some = batch.slice(start, min(BATCH_ROWS, most + 1 - book.number))
                book.put_all(some.columns)
                start += some.num_rows
        if book:
            over()
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["made"])

    return df.mapInArrow(run, "made long").agg(F.coalesce(F.sum("made"), F.lit(0)).alias("n")).first()["n"]
