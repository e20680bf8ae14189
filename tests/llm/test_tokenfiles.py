"""Token files: ids, starts and sums against the library on whole texts, what the files hold, and pruned reads."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from reportloom.llm import tokenfiles
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenfiles.vocabulary_path())


def expected(library, rows):
    out, start = [], 0
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, library):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = sorted(map(tuple, tokenfiles.op12_orc_tokens(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected(library, rows)


def test_words_equal_library_on_odd_texts(library):
    tok = tokenfiles.Words(tokenfiles.vocabulary_path())
    marks = [chr(c) for c in [*range(0, 0x250), 0x300, 0x301, 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600, 0x410, 0x3A3, 0x130]]
    odd = [t for c in marks for t in (f"ab{c}Cd 1", f"{c} x", f"it{c}'s  é{c}", f"A{c}<|endoftext|> b")]
    odd += ["a|b | c || '|", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "", " ", "ΑΣ ΣΑΣ", "é ́e", "a" * 5000, "12345 don't WE'LL"]
    for _ in range(2):  # unknown words, then remembered ones
        ids, sizes = tok.encode_all(pa.array([*odd, None])[1:])
        ends = np.cumsum(sizes)
        assert len(sizes) == len(odd) and sizes[-1] == 0
        for t, a, b in zip(odd[1:], ends - sizes, ends):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_edge_rows(spark, edge, nothing, library, tmp_path):
    kind = tokenfiles.schema_of(edge)
    for k, df in enumerate((edge, nothing)):
        folder = f"file://{tmp_path}/{k}"
        tokenfiles.write_tokens(df, folder)
        got = sorted((tuple(r) for r in tokenfiles.measured(tokenfiles.read_tokens(spark, folder, kind)).collect()), key=lambda r: r[1])
        rows = df.collect()
        assert [r[0] for r in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
        assert [r[1] for r in got] == [sum(x[2] for x in got[:j]) for j in range(len(got))]
        want = {}
        for r in rows:
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
            want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        for r in got:
            want[r[0]].remove(r[2:])
        assert not any(want.values())


def test_files_hold_runs_indexes_and_filters(spark, tmp_path):
    docs = spark.range(0, 30000, 1, 1).selectExpr("id * 3 AS doc_id", "concat('word ', id % 7, ' again') AS text")
    folder = f"file://{tmp_path}/tokens"
    tokenfiles.write_tokens(docs, folder)
    jvm = spark.sparkContext._jvm
    names = sorted(glob.glob(f"{tmp_path}/tokens/*.orc"))
    total = 0
    for name in names:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == tokenfiles.INDEX_ROWS
        recs = reader.rows()
        for stripe in reader.getStripes():
            total += stripe.getNumberOfRows()
            footer = recs.readStripeFooter(stripe)
            kinds = {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
            assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8")} <= kinds
            assert footer.getColumns(6).getKind().toString() == "DIRECT_V2"  # the ids: run-length encoding of the second version
        recs.close()
    assert total == 30000
    some = tokenfiles.find(spark, folder, tokenfiles.schema_of(docs), [300, 301, 89997])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in some.collect()) == [300, 89997]
    assert isinstance(some.schema["ids"].dataType, T.ArrayType)
