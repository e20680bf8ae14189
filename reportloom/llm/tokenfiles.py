"""Token ids as ORC files: documents in ascending order of ids, integer run-length encoding, row indexes and Bloom filters.

Texts are dealt by ranges of (doc_id, hash of the text) and sorted inside a range, so that a hot id is dealt over tasks as well; the
ids of a range are written in that order as ORC, whose writer packs them by runs, keeps least and greatest doc_id of each stripe and
of every INDEX_ROWS rows, and a Bloom filter of them. A reader takes any stripe by itself; one that asks for few documents skips
stripes by their statistics and rows by index and filter (`find`). Each row also holds its range and the ids before it inside the
range: with the sums of the ranges, one small row each, that gives every document's start without ordering anything again.

Words between white space are encoded once and remembered, up to SEEN of them; new ones go through the tokenizers library many at a
time. ASCII white space ends a word for normaliser and splitter of the file alike, so this gives the ids of the whole text.

Defined results: a null text is the empty text and has the end id alone; null ids come first; rows that share an id are ordered by hash
and text, equal rows stand beside each other and differ in start alone; an empty table gives an empty table; further columns aren't read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table, temporary, written

#: The id after each document, by the contract.
END = 1
#: Words that a worker remembers, and an eighth of their ids, before it starts anew.
SEEN = 1_000_000
#: Words that go through the library in one text.
TOGETHER = 200
#: Rows of a stride of the row index and of its Bloom filters; bytes of a stripe in the writer's memory.
INDEX_ROWS = 1000
STRIPE_BYTES = 32 << 20

#: A word of its own with one id; words that have it are encoded alone.
BAR = "|"


class Words:
    """The ids of texts by a tokenizer file that drops white space between words. The ids of known words lie in one array; a batch's
    texts are cut, and its distinct words found, by Arrow, and the ids of its words are gathered from the array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.bar = self.alone(BAR)
        self.bare = self._bare(path)
        self.forget()

    def _bare(self, path: str):
        """The same tokenizer without the steps that do nothing to lower-case ASCII words: normaliser, letters for bytes and search for
        special tokens; None for a file whose steps are others."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers") or [{}]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        spec["normalizer"], spec["pre_tokenizer"], spec["added_tokens"] = None, cuts[0], []
        if not {x.get("type") for x in steps} <= {"NFC", "Replace", "Lowercase"} or [x.get("type") for x in cuts] != ["Split", "ByteLevel"] or cuts[1].get("add_prefix_space") or cuts[1].get("use_regex"):
            return None
        bare, probe = Tokenizer.from_str(json.dumps(spec)), " ".join(f"{chr(c)} a{chr(c)}b{chr(c)}{chr(c)}" for c in range(33, 127) if not chr(c).isupper())
        return bare if bare.encode(probe, add_special_tokens=False).ids == self.library.encode(probe, add_special_tokens=False).ids else None

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def learn(self, new: list[str]) -> None:
        """Put the ids of words behind those of the known ones."""
        kinds: tuple[list[str], ...] = ([], [], [])  # encoded alone, by the whole tokenizer, by the bare one
        for w in new:
            kinds[0 if BAR in w or len(self.bar) != 1 else 2 if self.bare and w.isascii() and w.isprintable() and w == w.lower() and "<|" not in w else 1].append(w)
        found = [self.alone(w) for w in kinds[0]]
        sizes = [np.array([len(x) for x in found], np.int64)]
        for tok, own in ((self.library, kinds[1]), (self.bare, kinds[2])):
            cut = [f" {BAR} ".join(own[k : k + TOGETHER]) for k in range(0, len(own), TOGETHER)]
            for got in tok.encode_batch_fast(cut, add_special_tokens=False) if cut else ():
                ids = np.array(got.ids, np.int32)
                bars = ids == self.bar[0]
                found.append(ids[~bars])
                sizes.append(np.diff(np.flatnonzero(bars), prepend=-1, append=len(ids)) - 1)
        size = np.concatenate(sizes)
        self.seen.update(zip([*kinds[0], *kinds[1], *kinds[2]], range(len(self.seen), len(self.seen) + len(new))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *found])

    def encode_all(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, their number in each text); a null text has none."""
        if len(self.seen) > SEEN or len(self.ids) > 8 * SEEN:
            self.forget()
        cut = pc.ascii_split_whitespace(pc.fill_null(batch, ""))
        flat, bounds = cut.flatten(), cut.offsets.to_numpy()
        # Only words of ASCII letters are lowered here: that changes nothing, but for the strings of special tokens.
        small = pc.and_(pc.string_is_ascii(flat), pc.invert(pc.match_substring(flat, "<|")))
        coded = pc.if_else(small, pc.ascii_lower(flat), flat).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        slots = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            self.learn(words[new].tolist())
            slots[new] = np.fromiter(map(self.seen.get, words[new]), np.int64, len(new))
        at = slots[coded.indices.to_numpy()]
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.first[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[bounds - bounds[0]])


_LOADED: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def schema_of(docs: DataFrame) -> T.StructType:
    """Columns of the files: doc_id, range and the ids of the range before it, its own count, its ids."""
    kinds = [("range", T.IntegerType()), ("before", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, k) for n, k in kinds)])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Write the ids of each row's text, and the end id, in ascending order of doc_id into ORC files of a new folder.

    path: a tokenizer file that every executor has; by default the installed public one.
    """
    spark, kind = docs.sparkSession, schema_of(docs)
    bounded_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Ranges are bounded by hashes, so that sampling them brings no texts to the driver.
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, own, before = words(path or vocabulary_path()), TaskContext.get().partitionId(), 0
        for batch in batches:
            found, sizes = tok.encode_all(batch.column(1))
            found, sizes = np.insert(found, np.cumsum(sizes), end), sizes + 1
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(found))
            columns = [batch.column(0), pa.array(np.full(len(sizes), own, np.int32)), pa.array(before + ends - sizes), pa.array(sizes), ids]
            before += int(ends[-1]) if len(ends) else 0
            yield pa.RecordBatch.from_arrays(columns, kind.names)

    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd"}
    dealt.mapInArrow(run, kind).write.options(**options).orc(folder)


def read_tokens(spark: SparkSession, folder: str, kind: T.StructType) -> DataFrame:
    """The rows of write_tokens(); Spark deals stripes over tasks."""
    return spark.read.schema(kind).orc(folder)


def find(spark: SparkSession, folder: str, kind: T.StructType, doc_ids: list) -> DataFrame:
    """doc_id and ids of some documents: the condition reaches the ORC reader, which passes over stripes and strides without them."""
    return read_tokens(spark, folder, kind).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def starts(files: DataFrame) -> DataFrame:
    """range, start: the ids of all ranges before; one row a range."""
    sums = written(files.groupBy("range").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total")), "ranges")
    # A window over all rows: they are as many as ranges, and hold two numbers each.
    return sums.select("range", F.coalesce(F.sum("total").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def measured(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, from the files alone."""
    bounded_batches(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            bounds = (ids.offsets.to_numpy() * 4).tolist()
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([(b - a) // 4 for a, b in zip(bounds, bounds[1:])], pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "range", "before", "n_tokens", "ids_crc32"])

    read = files.select("doc_id", "range", "before", "ids").mapInArrow(run, f"doc_id {kind}, range int, before long, n_tokens long, ids_crc32 long")
    return read.join(starts(files), "range").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op12_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = temporary(spark, "tokens")
    write_tokens(docs, folder)
    return measured(read_tokens(spark, folder, schema_of(docs)))
