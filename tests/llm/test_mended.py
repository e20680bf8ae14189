"""Pages whose articles were lost, hostile pages, damaged members, rows without ids, labels of one language."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from reportloom.llm import fingerprints, html, language, media

LONG = "<p>%s</p><p>%s</p>" % ("alpha beta gamma delta. " * 15, "epsilon zeta eta theta. " * 15)
TEXT = "\n\n".join([("alpha beta gamma delta. " * 15).strip(), ("epsilon zeta eta theta. " * 15).strip()])


@pytest.mark.parametrize(("page", "want"), [
    (f"<title>x</title><h1>T</h1>{LONG}<div>By the author</div>", f"T\n\n{TEXT}\n\nBy the author"),
    ("<body><article><p>The <span class='share-price'>share</span> rose, the <em class='alert'>alert</em> word <a class='related-term'>term</a> end.</p></article></body>", "The share rose, the alert word term end."),
    (f"<body><main><section class='editorial-comment'><h1>T</h1>{LONG}</section></main></body>", f"T\n\n{TEXT}"),
    (f"<body><h1>T</h1><div class='discussion-content'>{LONG}</div></body>", TEXT),
    (f"<body><article><h1>T</h1><section id='methods'>{LONG}</section><section id='discussion'><h2>D</h2>{LONG}</section></article></body>", f"T\n\n{TEXT}\n\nD\n\n{TEXT}"),
    (f"<body><article><h1>T</h1>{LONG}<section class='recommended-dosage'><p>Take two of these every morning with a full glass of water.</p></section></article></body>", f"T\n\n{TEXT}\n\nTake two of these every morning with a full glass of water."),
    (f"<body><main><header><h1>Title</h1><nav>x</nav></header>{LONG}</main></body>", f"Title\n\n{TEXT}"),
    (f"<body>{LONG}<!-- never > closed", TEXT),
    (f"<body><article>{LONG}</article><section class='comments'>{LONG}</section></body>", TEXT),
])
def test_articles_stay(page, want):
    assert html.extracted(page) == want


def test_pages_without_body_of_a_host(spark):
    rows = [(k, f"https://h.org/{k}", f"<title>x</title><h1>T{k}</h1>{LONG}<div>By author {k}</div>") for k in range(20)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"T{k}\n\n{TEXT}\n\nBy author {k}" for k in range(20)}


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\">", "<!--", "<div></p>", "<b></i>", "<div>", "</div>", "<", "<p title='"])
def test_hostile_pages_take_linear_time(piece):
    began = time.process_time()
    html.extracted(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 6


def test_flipped_byte_is_one_null_row(spark, edge, tmp_path):
    folder = f"file://{tmp_path}/bad"
    manifest = media.write_manifest(media.write_archives(edge.coalesce(1), folder), folder)
    path = next(tmp_path.joinpath("bad").glob("*.zip"))
    data = bytearray(path.read_bytes())
    at = data.index(b"IDAT") + 12
    data[at] ^= 0xFF
    path.write_bytes(data)
    read = media.read_archives(spark, folder, manifest_file=manifest, on_error="null", retries="1")
    rows = media.measured(read).collect()
    assert len(rows) == edge.count() and sum(r.payload_sha256 is None for r in rows) == 1
    assert [r.error for r in read.collect() if r.error] and "damaged" in next(r.error for r in read.collect() if r.error)
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, folder, manifest_file=manifest, retries="1").collect()


def test_feature_of_samples_is_that_of_the_text(spark, edge, tmp_path):
    """The feature and both digests again, from the text alone."""
    import hashlib

    folder = f"file://{tmp_path}/whole"
    manifest = media.write_manifest(media.write_archives(edge, folder), folder)
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in media.measured(media.read_archives(spark, folder, manifest_file=manifest)).collect())
    want = []
    for r in edge.collect():
        said = (r.text or "").encode()
        padded = said + bytes(-len(said) % 64 or (64 if not said else 0))
        samples = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        want.append((str(r.doc_id), len(said), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), media.feature(samples)))
    assert got == sorted(want)


def test_rows_without_ids_follow_each_other(spark):
    """20,000 rows without an id: each is edited with the next of them, in the order of hashes; minutes would be an all-pairs join."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id", F.lit(" of all")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(5, "five"), (9, "nine words")], "doc_id long, text string"))
    prints = fingerprints.fingerprints(rows)
    began = time.time()
    chain = [(r.doc_id, r.h, r.next_ord, r.next_h) for r in fingerprints.with_next(prints, 8).select("doc_id", "h", "next_ord", "next_h").collect()]
    assert time.time() - began < 60 and len(chain) == 20_002
    nulls = sorted(h for i, h, *_ in chain if i is None)
    after = {h: (o, n) for i, h, o, n in chain if i is None}
    assert all(after[a] == (fingerprints.LOWEST, b) for a, b in zip(nulls, nulls[1:])) and after[nulls[-1]][0] == 9
    by = {i: (o, n) for i, _, o, n in chain if i is not None}
    assert by[9][0] == 5 and by[5] == (fingerprints.LOWEST, nulls[0])


def test_labels_of_one_language_lose_nothing(spark):
    words = "the house and the river are old but people like to walk there when it rains".split()
    rows = [(k, " ".join(words[(k + j * 3) % len(words)] for j in range(40)), ["en", "en-us", "en-gb", f"x{k}"][k % 4], f"s{k % 3}") for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language.keep(docs).count() == 160
    assert len(language.train(docs).languages) <= language.LABELS + 1
