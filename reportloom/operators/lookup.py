"""An index for figure lookups: which reports may hold a text, by the three-letter pieces of titles and sentences.

Reports are numbered by rank, newest first, so that the postings of a piece are bitmaps of ranks by bucket, as in facetindex, and the
order in which reports are wanted is the order of buckets. A search ANDs the bitmaps of all pieces that it asks for, in the first bucket,
then in twice as many, and so on, verifies what is left on the stored texts of those buckets alone, and stops once it has found enough.
Words of under three letters ask for no piece and are left to the verification, so results are those of a full scan for texts of any
length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import cut
from .facetindex import BITS, HELD, has
from .query import stated

SIZE = 3
#: Files of a bucket's texts.
FILES = 8
#: Reports whose pieces a task makes at a time, and what stands between texts: a noncharacter, which no text should hold.
ROWS = 2000
CUT = "\uffff"


def _asked(text: str) -> set[str]:
    low = text.lower()
    return {p for k in range(len(low) - SIZE + 1) if CUT not in (p := low[k : k + SIZE])}


def build(reports: DataFrame, index: DataFrame, folder: str) -> None:
    """Write postings (kind, piece, bucket, bits) and texts (by bucket) of ranked reports (id, title, date, url) that have sentences;
    index as of facts.index(): url, s, f."""
    both = reports.select("id", "title", "date", "url").join(index.withColumnRenamed("url", "_url"), F.substring_index("url", "#", 1) == F.col("_url")).drop("_url")
    both = both.withColumn("bucket", F.bitmap_bucket_number("id"))
    # A bucket's texts in a few files, so that its pieces are found by several tasks.
    both.repartition("bucket", F.col("id") % FILES).write.partitionBy("bucket").parquet(f"{folder}/texts")
    texts = both.sparkSession.read.parquet(f"{folder}/texts")
    lower = F.transform("s", lambda x: F.lower(x))
    # Sentences of a report with a sign between them that no piece may hold.
    told = texts.select("id", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.array_join(lower, CUT).alias("text"))
    rows = told.mapInArrow(_postings, "kind string, piece string, bucket long, bits binary")
    made = rows.groupBy("kind", "piece", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    # Sorted by piece, so that a search's few pieces are found by the statistics of row groups.
    made.repartitionByRange("kind", "piece").sortWithinPartitions("kind", "piece").write.parquet(f"{folder}/postings")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of the postings: pieces of ROWS reports at a time are code points side by side in numpy, so that no row is made for each
    piece of each report. At most HELD bitmaps are in memory; what is put out early is joined by OR."""
    held: dict[tuple, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        kinds, codes, buckets = zip(*held) if held else ((), (), ())
        names = ["".join(chr(c >> 21 * k & 0x1FFFFF) for k in (2, 1, 0)) for c in codes]
        bits = pa.array([x.tobytes() for x in held.values()], pa.binary())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(buckets, pa.int64()), bits], ["kind", "piece", "bucket", "bits"])

    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            ids = batch.column(0).to_numpy(zero_copy_only=False) - 1
            for kind, column in (("title", batch.column(1)), ("text", batch.column(2))):
                texts = column.to_pylist()
                points = np.frombuffer((CUT.join(texts) + CUT).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                if len(points) < SIZE:
                    continue
                # CUT stands between sentences and reports alike; a report is told by where its text begins.
                ends = np.cumsum([len(x) + 1 for x in texts])
                codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
                whose = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: len(codes)]
                cut = points == ord(CUT)
                kept = ~(cut[:-2] | cut[1:-1] | cut[2:])
                codes, at = codes[kept], ids[whose[kept]]
                names, inverse = np.unique(codes, return_inverse=True)
                # One number for piece and bucket, so that runs are sorted once.
                order = np.argsort(inverse.astype(np.int32), kind="stable")
                inverse, at = inverse[order], at[order]
                buckets = at // BITS
                starts = np.flatnonzero(np.r_[True, (inverse[1:] != inverse[:-1]) | (buckets[1:] != buckets[:-1])]) if len(at) else []
                for a, b in zip(starts, [*starts[1:], len(at)]):
                    bits = held.setdefault((kind, int(names[inverse[a]]), int(buckets[a]) + 1), np.zeros(BITS // 8, np.uint8))
                    place = at[a:b] - int(buckets[a]) * BITS
                    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
                    if len(held) >= HELD:
                        yield out()
    yield out()


def candidates(postings: DataFrame, title_words: str, keyword: str) -> DataFrame | None:
    """bucket, bits of reports that have all pieces asked for; None if none is."""
    wanted = {("title", p) for w in title_words.split() for p in _asked(w)} | {("text", p) for p in _asked(keyword)}
    if not wanted:
        return None
    test = F.lit(False)
    for kind in ("title", "text"):
        own = [p for k, p in wanted if k == kind]
        if own:
            test |= (F.col("kind") == kind) & F.col("piece").isin(own)
    both = postings.where(test).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.where(F.col("n") == len(wanted)).select("bucket", "bits")


def search(spark: SparkSession, folder: str, title_words: str = "", keyword: str = "", limit: int | None = None) -> DataFrame:
    """What query.figure_lookup() gives, from the index."""
    texts = spark.read.parquet(f"{folder}/texts")
    postings, most = spark.read.parquet(f"{folder}/postings"), min(limit or 5, 20)
    last = texts.agg(F.max("bucket").alias("b")).first()["b"]
    first, width, found, n = texts.agg(F.min("bucket").alias("b")).first()["b"], 1, None, 0
    while last is not None and first <= last and n < most:
        inside = F.col("bucket").between(first, first + width - 1)
        rows, some = texts.where(inside), candidates(postings.where(inside), title_words, keyword)
        if some is not None:
            kept = some.withColumnRenamed("bucket", "_b")
            rows = rows.join(kept, F.col("bucket") == F.col("_b")).where(has(F.col("bits"), F.bitmap_bit_position("id")))
        part = cut(stated(rows, title_words, keyword, most - n))  # at most a page of rows
        n += part.count()
        found = part if found is None else found.unionByName(part)
        first, width = first + width, 2 * width
    return stated(texts.limit(0), title_words, keyword, most) if found is None else found
