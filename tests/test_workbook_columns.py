"""Sheets as tables: read once, planned without inflating them, in numpy where they are plain, with the rows that cell by cell reading gives."""

import datetime
import io
import random
import zipfile

import pyarrow as pa
import pytest
from reportloom.plans import registry
from reportloom.sources import workbook

NAMES = ["n", "s", "none", "wide"]


def test_a_sheet_that_was_written_is_planned_and_read_once(spark, tmp_path, monkeypatch):
    df = spark.range(0, 300, 1, 1).selectExpr("id AS n", "IF(id % 3 = 0, NULL, concat('s<', id % 7)) AS s")
    folder = f"file://{tmp_path}/books"
    assert workbook.write_workbooks(df, folder, "S", most=99) == 4
    back = workbook.sheet(spark, folder, "S", "n long, s string")
    assert back._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1 and back.exceptAll(df).count() == 0 and back.count() == 300
    read = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda z, name, *a, **k: pytest.fail("a sheet is inflated") if "sheet1" in str(name) else read(z, name, *a, **k))
    assert len(workbook.WorkbookReader({"path": folder, "part_rows": "50"}).partitions()) == 7


def test_places_of_workbooks_take_one_reading(spark):
    plan = registry.queries()["workbook_places"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1


def made(rng):
    """A sheet's rows: mostly plain ones, some with another kind of cell, row or order."""
    head = [f'<row r="{h}"><c r="A{h}" t="s"><v>0</v></c><c r="B{h}" t="s"><v>1</v></c><c r="AB{h}" t="s"><v>2</v></c></row>' for h in [2]]
    rows, number = [], 2
    odd = rng.random() < 0.6
    for _ in range(rng.randint(0, 60)):
        number += rng.choice([1, 1, 1, 3])
        cells = [f'<c r="{c}{number}"{k}><v>{x}</v></c>' for c in ("A", "B", "Z", "AB", "AAC") if rng.random() < 0.7 for k, x in [rng.choice([("", rng.randint(-5, 5)), (' t="s"', rng.randint(0, 4)), ("", "1.50"), ("", "x>y")])]]
        if odd and rng.random() < 0.08:
            cells.append(rng.choice(['<c r="AAD9" t="b"><v>1</v></c>', '<c r="A9"><v>7</v></c>', '<c r="AAD9" s="1"><v>3</v></c>', "<c><v>4</v></c>", '<c r="AAD9"/>', '<c r="AAD9"><v></v></c>', '<c r="AAD9"><v>a&amp;b</v></c>', '<c r="AAD9" t="e"><v>#N/A</v></c>', "<!-- c -->", '<c r="AAD9"><f>1</f><v>2</v></c>']))
        rows.append(f'<row r="{number}"{rng.choice([" x=" + chr(34) + "1" + chr(34), "", "", "", ""]) if odd else ""}>{"".join(cells)}</row>' + (" " if odd and rng.random() < 0.02 else ""))
    first = ['<row r="1"><c r="A1"><v>title</v></c></row>'] if rng.random() < 0.5 else []
    return f'<worksheet xmlns="m"><sheetData>{"".join(first + head + rows)}</sheetData>{rng.choice(["", "<pageMargins/>"])}</worksheet>'


@pytest.mark.parametrize("block", [60, 700, 1 << 20])
def test_columns_equal_rows(block, monkeypatch):
    monkeypatch.setattr(workbook, "BLOCK", block)
    rng, fast = random.Random(block), 0
    strings = "".join(f"<si><t>{x}</t></si>" for x in ("n", " s ", "wide", "é &lt;", ""))
    for _ in range(150):
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S" r:id="r0"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r0" Target="worksheets/s.xml"/></R>')
            z.writestr("xl/worksheets/s.xml", made(rng))
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="m">{strings}</sst>')
        book = workbook.Book(file)
        first = rng.choice([1, 1, 3, 10, 40])
        last = rng.choice([2, 30, 1000])
        heads = {x and x.strip(" "): k for k, x in enumerate(next(book.rows("S", 2, 2))[1])}
        want = [[c[heads[x]] if x in heads and heads[x] < len(c) else None for x in NAMES] for n, c in book.rows("S", max(3, first), last) if any(x is not None for x in c)]
        got = [list(x) for arrays in book.columns("S", first, last, NAMES, 2) for x in zip(*(a.to_pylist() for a in arrays))]
        assert got == want
        fast += all(x is not None and book._plain_table(x, 1, 1000, [0]) for x in book._plain_blocks("S"))
    assert fast > 40


def test_rows_are_written_alike_by_batch_and_one_by_one():
    day, moment = datetime.date(2024, 2, 29), datetime.datetime(2001, 2, 3, 4, 5, 6)
    rows = [(1, "a <b>", 1.5, day, moment, True), (None, None, None, None, None, None), (-3, "", -2.25, None, None, False), (10**12, "a <b>", 0.0, day, moment, None)]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.date32(), pa.timestamp("us"), pa.bool_()]
    for some in (rows, rows[:1], rows[2:]):
        told = []
        for whole in (True, False):
            file = io.BytesIO()
            book = workbook.BookWriter(file, "S", list("abcdef"))
            if whole:
                book.put_all([pa.array(c, k) for c, k in zip(zip(*some), kinds)])
            else:
                for x in some:
                    book.put(list(x))
            book.close()
            told.append(zipfile.ZipFile(file).read("xl/worksheets/sheet1.xml"))
        assert told[0] == told[1]
