"""PDF texts and workbooks: round trips, hand-made and damaged files, ranges of any size, and the queries against SQL."""

import datetime
import random
import re
import zipfile
import zlib

import duckdb
import pytest
from reportloom.plans import registry, views
from reportloom.sources import files, pdf, workbook

SF = "/root/testdata/sf0.001"


def squeezed(t):
    return re.sub(r"\s+", " ", t).strip()


@pytest.mark.parametrize("kind", range(4))
def test_pdf_round_trip(kind):
    texts = ["", "Plain (text) with \\ and )( signs.\nSecond line", "Größe — ŝ 漢字 “q” 5 0 obj endobj\n\n" * 80, "stream 7 0 obj <</Type/Catalog>>\n" * 90, "a\rb\tc"]
    for t in texts:
        n, got = pdf.first_pages(views.pdf_of(t, kind), 10**6)
        cut = [t[k : k + views.PAGE_CHARS] for k in range(0, len(t), views.PAGE_CHARS)]
        assert n == max(1, len(cut)) and squeezed(got) == squeezed(" ".join(cut))


def by_hand(*objects, trailer=b"<</Root 1 0 R>>"):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (k + 1, o) for k, o in enumerate(objects)) + b"trailer " + trailer


def stream(data, more=b""):
    return b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(data), more, data)


def test_pdf_operators_forms_and_inherited_resources():
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <41> <43> <0061> <50> <51> [<0058> <00590059>] endbfrange"
    shown = rb"BT /F1 9 Tf [(One) -300 (two) -20 (three)] TJ 0 -12 Td (\101\(x\)\053) Tj T* <4A> Tj ET /X0 Do BI /W 1 ID (no) EI BT /F2 9 Tf (ABCPQ) Tj 1 0 0 1 5 700 Tm (A) Tj 1 0 0 1 5 680 Tm (B) Tj ET"
    form = stream(b"BT /F1 9 Tf (inner) ' ET", b"/Subtype/Form")
    data = by_hand(
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Kids[3 0 R]/Resources<</Font<</F1 6 0 R/F2 7 0 R>>/XObject<</X0 5 0 R>>>>>>",
        b"<</Kids[4 0 R 9 0 R]>>", b"<</Type/Page/Contents[8 0 R]>>", form, b"<</Type/Font/Encoding/WinAnsiEncoding>>", b"<</Type/Font/ToUnicode 10 0 R>>",
        stream(zlib.compress(shown), b"/Filter[/FlateDecode]"), b"<</Type/Page>>", stream(cmap),
    )
    assert pdf.first_pages(data, 5) == (2, "One twothree\nA(x)+\nJ\n\ninner\n\nabcXYY\na\nb ".replace("abcXYY\na\nb ", "abcXYYa\nb "))


def test_pdf_pages_damage_and_edge_rows(spark):
    text = "".join(f"word{k} " for k in range(2000))
    whole = views.pdf_of(text, 2)
    some = bytearray(views.pdf_of(text, 1))
    at = some.index(b"stream\n", some.index(b"6 0 obj")) + 20
    some[at : at + 40] = bytes(40)
    rows = [("a", whole), ("cut", whole[: len(whole) // 2]), ("none", None), ("text", b"no file of that kind"), ("empty", b""), ("bad", bytes(some)), ("locked", by_hand(b"<</Type/Catalog>>", trailer=b"<</Root 1 0 R/Encrypt 2 0 R>>")), ("a", whole)]
    got = [(r.path, r.n_pages, r.text) for r in pdf.texts(spark.createDataFrame(rows, "path string, content binary"), pages=2).collect()]
    good = [x for x in got if x[0] == "a"]
    assert len(good) == 2 and good[0] == good[1] and good[0][1] == -(-len(text) // views.PAGE_CHARS)
    cut = [text[k * views.PAGE_CHARS : (k + 1) * views.PAGE_CHARS] for k in range(2)]
    assert squeezed(good[0][2]) == squeezed(" ".join(cut))
    assert all(x[1:] == (None, None) for x in got if x[0] != "a") and len(got) == 8
    assert pdf.texts(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_pdf_files_of_a_folder(spark, tmp_path):
    for k, t in enumerate(["First file", "Second file\nof two lines", "x" * 5000]):
        (tmp_path / f"{k}.pdf").write_bytes(views.pdf_of(t, k))
    read = pdf.texts(files.binary_files(spark, f"file://{tmp_path}", most=4000), pages=4)
    got = {r.path.rpartition("/")[2]: squeezed(r.text) for r in read.collect()}
    assert got["0.pdf"] == "First file" and got["1.pdf"] == "Second file of two lines"


@pytest.mark.parametrize("name", ["pdf_text", "workbook_round_state", "workbook_location", "workbook_places"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "orders", "lineitem", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = [tuple(r) for r in registry.queries()[name](spark, SF).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)


def sheet_xml(rows, head='<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:x="urn:x">', dimension=""):
    return f"{head}{dimension}<sheetData>{''.join(rows)}</sheetData><pageMargins/></worksheet>"


def book(path, sheets, strings=(), styles=None):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="r"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</R>")
        for k, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", xml)
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="m">{"".join(strings)}</sst>')
        if styles:
            z.writestr("xl/styles.xml", styles)


def test_workbook_cells(spark, tmp_path):
    styles = '<styleSheet xmlns="m"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    rows = [
        '<row r="1" x:height="2"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>',
        '<row r="3"><c r="B3" s="1"><v>43831</v></c><c r="C3" s="2"><v>43831.5</v></c><c r="AB3" s="3"><v>7</v></c></row>',
        '<row><c t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t><r><t>line</t></r></is></c><c t="e"><v>#N/A</v></c><c><f>1+1</f><v>2</v></c></row>',
    ]
    strings = ["<si><t>name</t></si>", "<si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si>"]
    book(tmp_path / "a.xlsx", {"One": sheet_xml(rows), "Empty": sheet_xml([])}, strings, styles)
    got = {(r.sheet, r.row): r.cells for r in workbook.read_workbook(spark, str(tmp_path / "a.xlsx")).collect()}
    assert got == {
        ("One", 1): ["name", None, "two runs"],
        ("One", 3): [None, "2020-01-01", "2020-01-01 12:00:00", *[None] * 24, "7"],
        ("One", 4): ["TRUE", "inline", None, "2"],
    }


@pytest.mark.parametrize("dimension", ["", '<dimension ref="A1:B900"/>', '<dimension ref="A1"/>'])
@pytest.mark.parametrize("part", [1, 7, 1000])
def test_workbook_ranges(spark, tmp_path, dimension, part):
    rng = random.Random(part)
    places = sorted(rng.sample(range(1, 900), 300))
    wide = "w" * 3000  # rows of over a read's length come in pieces
    rows = [f'<row r="{k}"><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="inlineStr"><is><t>{wide if k % 5 == 0 else "row &lt;row r= "}</t></is></c></row>' for k in places]
    book(tmp_path / "b.xlsx", {"S": sheet_xml(rows, dimension=dimension)})
    parts = workbook.WorkbookReader({"path": str(tmp_path), "part_rows": str(part)}).partitions() if part > 1 else [workbook.Rows(str(tmp_path / "b.xlsx"), "S", a, a) for a in range(1, 901)]
    reader = workbook.WorkbookReader({"path": str(tmp_path)})
    got = [(n, c) for p in parts for b in reader.read(p) for n, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
    assert got == [(k, [str(k), wide if k % 5 == 0 else "row <row r= "]) for k in places]


def test_workbook_round_trip_types_and_edges(spark, tmp_path):
    day, moment = datetime.date(2024, 2, 29), datetime.datetime(2001, 2, 3, 4, 5, 6)
    rows = [(1, "a <b> & \"c\"", 1.5, day, moment, True), (None, None, None, None, None, None), (-3, "", -2.25, None, None, False), (10**12, " spaced ", None, day, None, None)]
    df = spark.createDataFrame(rows, "n long, s string, x double, d date, t timestamp, b boolean").coalesce(1)
    folder = f"file://{tmp_path}/out"
    assert workbook.write_workbooks(df, folder, "Data & more", most=2) == 2
    back = workbook.sheet(spark, folder, "Data & more", "n long, s string, x double, d date, t timestamp, b boolean, missing int")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((*r, None) for r in rows if any(x is not None for x in r)), key=str)
    assert workbook.read_workbook(spark, f"{tmp_path}/none").collect() == []
    assert workbook.write_workbooks(spark.createDataFrame([], "a int"), f"file://{tmp_path}/empty") == 0
    assert workbook.sheet(spark, f"file://{tmp_path}/empty", "x", "a int").collect() == []


def test_damaged_workbook_fails(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"PK no workbook")
    with pytest.raises(Exception, match="(?i)zip"):
        workbook.read_workbook(spark, str(tmp_path)).collect()
