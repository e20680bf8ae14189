"""Vector codes: each vector is cut into parts, each part is named by the nearest entry of its codebook, found by Elkan's bounds.

Everything is integers: components are floor(256 * x), distances are compared as squared integers, ties go to the lower index. Every
round writes the vectors with their codes and bounds to the shared folder: for each part an upper bound of the distance to its own
entry, and for each entry of that part's codebook one lower bound. Codebooks are small (PARTS * ENTRIES entries) and travel with the
tasks; new ones are floors of means, from sums that every task forms of its rows before they are shuffled. When entries move, bounds
are shifted by how far. An entry is passed over only where a bound says that it is strictly farther than the own one, be it its lower
bound or its distance to the own entry less the upper bound; all others are measured, in integers, so that ties are seen.

Bounds are kept in units of 1 / FINE: upper bounds as integers rounded up, lower ones as bytes of a step, rounded down, which costs
some pruning but never a wrong code. Step: the greatest distance between two entries of the first codebooks over 255.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are left out, and so are those of another
length than the first kept one's (by vec_id) or, where that isn't a multiple of PARTS, all of them; null vec_ids come after all
others; rows that share a vec_id are ordered by their components, repeated rows count each; with fewer than ENTRIES rows codebooks have as many
entries as there are rows; components beyond +-65,536, whose squared distances would leave 64 bits, count as that; a sum of
errors beyond 64 bits is null; an empty table gives an empty table; further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, removed, restored_batches, split_join, table, written

#: Fixed values of the query.
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Units of bounds in a unit of distance.
FINE = 16
#: Greatest component, in integers.
MOST = 1 << 24
#: Rows of a batch: with all distances of each, 8 bytes for PARTS * ENTRIES.
ROWS = 512

FLOOR, CEIL = 1 - 1e-12, 1 + 1e-12


def low(squared: np.ndarray) -> np.ndarray:
    """At most the distance, in units of 1 / FINE."""
    return np.floor(FINE * np.sqrt(squared) * FLOOR).astype(np.int64)


def high(squared: np.ndarray) -> np.ndarray:
    """At least the distance, in units of 1 / FINE."""
    return np.ceil(FINE * np.sqrt(squared) * CEIL).astype(np.int64)


def integers(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the rows that stay, and their components as integers, whatever their lengths."""
    places, out = [], []
    for k, v in enumerate(vectors):
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                places.append(k)
                out.append(np.clip(np.floor(SCALE * x), -MOST, MOST).astype(np.int32))
    return np.array(places, np.int64), out


def block(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """integers() of one width as a matrix; without nulls and other widths it is read at once."""
    flat = vectors.flatten()
    if width and not vectors.null_count and not flat.null_count and len(flat) == width * len(vectors) and (np.diff(vectors.offsets.to_numpy()) == width).all():
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        places = np.flatnonzero(np.isfinite(x).all(axis=1))
        return places, np.clip(np.floor(SCALE * x[places]), -MOST, MOST).astype(np.int32)
    places, found = integers(vectors)
    fits = [k for k, x in enumerate(found) if len(x) == width]
    return places[fits], np.array([found[k] for k in fits], np.int32).reshape(len(fits), width)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, parts, entries) of x (rows, parts, width) to book (parts, entries, width)."""
    out = np.zeros((*x.shape[:2], book.shape[1]), np.int64)
    for j in range(x.shape[2]):
        apart = x[:, :, None, j].astype(np.int64) - book[None, :, :, j]
        out += apart * apart
    return out


class Bounds:
    """Codebooks of a round, and what moving from those of the round before does to bounds."""

    def __init__(self, book: np.ndarray, step: int, before: np.ndarray | None = None):
        self.book, self.step = book, step
        self.moved = high(((book - before) ** 2).sum(axis=2)) if before is not None else None
        self.between = low(((book[:, :, None] - book[:, None]) ** 2).sum(axis=3))
        alone = self.between + np.eye(book.shape[1], dtype=np.int64) * (1 << 60)
        self.nearest = alone.min(axis=2)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, upper and lower bounds of rows (rows, parts, width), all distances measured."""
        far = distances(x, self.book)
        codes = far.argmin(axis=2)
        own = np.take_along_axis(far, codes[:, :, None], 2)[:, :, 0]
        return codes, high(own), np.minimum(low(far) // self.step, 255)

    def again(self, x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the round before's; last: how many distances were measured."""
        parts = np.arange(x.shape[1])[None, :]
        upper = upper + self.moved[parts, codes]
        lower = np.maximum(lower.astype(np.int64) * self.step - self.moved[None], 0)
        codes = codes.copy()
        # Strictly nearer than half the way to any other entry: nothing to do.
        row, part = np.nonzero(self.nearest[parts, codes] <= 2 * upper)
        own = codes[row, part]
        apart = x[row, part].astype(np.int64) - self.book[part, own]
        exact = (apart * apart).sum(axis=1)
        upper[row, part] = up = high(exact)
        may = (lower[row, part] <= up[:, None]) & (self.between[part, own] <= 2 * up[:, None])
        may[np.arange(len(row)), own] = False
        at, entry = np.nonzero(may)
        apart = x[row[at], part[at]].astype(np.int64) - self.book[part[at], entry]
        measured = (apart * apart).sum(axis=1)
        lower[row[at], part[at], entry] = low(measured)
        lower[row, part, own] = low(exact)
        best = np.full(may.shape, np.iinfo(np.int64).max)
        best[at, entry] = measured
        best[np.arange(len(row)), own] = exact
        codes[row, part] = won = best.argmin(axis=1)
        upper[row, part] = high(best[np.arange(len(row)), won])
        return codes, upper, np.minimum(lower // self.step, 255), len(row) + len(at)


def _packed(rows: np.ndarray, kind: str) -> pa.Array:
    """One binary value for each row of a matrix."""
    data = np.ascontiguousarray(rows, kind)
    size = data.itemsize * int(np.prod(data.shape[1:]))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _list(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def starters(vectors: DataFrame) -> list[list[int]]:
    """Components of the first ENTRIES kept rows by vec_id: at most ENTRIES rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            width = max(1, len(vectors.flatten()) // max(1, len(vectors)))
            places, x = block(vectors, width)
            found = _list(x)
            if len(places) < len(vectors):
                places, rows = integers(vectors)
                found = pa.array([x.tolist() for x in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), found], ["vec_id", "x"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, x array<int>")
    order = (F.col("vec_id").asc_nulls_last(), F.col("x"))
    first = [r.x for r in kept.orderBy(*order).limit(ENTRIES).collect()]
    if any(len(x) != len(first[0]) for x in first):
        first = [r.x for r in kept.where(F.size("x") == len(first[0])).orderBy(*order).limit(ENTRIES).collect()]
    return first


def moved_entries(coded: DataFrame, book: np.ndarray) -> np.ndarray:
    """Floors of the means of what each entry was assigned; unused entries stay."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width)
            slots = (_unpacked(batch.column(1), "u1", parts).astype(np.int64) + np.arange(parts)[None, :] * entries).ravel()
            counts += np.bincount(slots, minlength=len(counts))
            for j in range(width):  # a batch's sums are exact in floating point: ROWS * MOST is far below 2 ** 53
                sums[:, j] += np.bincount(slots, x[:, :, j].ravel(), len(counts)).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), _list(sums[used])], ["slot", "n", "sums"])

    own = coded.select("x", "codes").mapInArrow(run, "slot int, n long, sums array<long>")
    total = own.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)))
    out = book.copy().reshape(parts * entries, width)
    for r in total.collect():  # at most PARTS * ENTRIES rows
        out[r.slot] = [r[2 + j] // r.n for j in range(width)]
    return out.reshape(book.shape)


def coded_vectors(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each kept row; the final codebooks as parts, entries, components)."""
    spark = vectors.sparkSession
    kinds = {c: vectors.schema[c].dataType for c in ("vec_id", "label")}
    schema = T.StructType([*(T.StructField(c, k) for c, k in kinds.items()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    bounded_batches(spark, ROWS)
    first = starters(vectors)
    if not first or len(first[0]) % PARTS:
        return spark.createDataFrame([], schema), np.zeros((PARTS, 0, 0), np.int64)
    size = len(first[0])
    width = size // PARTS
    book = np.array(first, np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    entries = book.shape[1]
    step = max(1, -(-int(Bounds(book, 1).between.max()) // 255))
    held = T.StructType([*schema.fields[:2], T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("upper", T.ArrayType(T.LongType())), T.StructField("lower", T.BinaryType())])
    kept, before = None, None
    for k in range(rounds + 1):
        now = Bounds(book, step, before)
        rows = vectors.select("vec_id", "label", "embedding") if kept is None else kept
        # The last assignment wants no bounds; there are no two rounds' of them beside each other for longer than it takes to write.
        last = k == rounds

        def run(batches: Iterator[pa.RecordBatch], now: Bounds = now, fresh: bool = kept is None, last: bool = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if fresh:
                    places, x = block(batch.column(2), size)
                    names = [batch.column(j).take(pa.array(places)) for j in range(2)]
                    cut = x.reshape(len(x), PARTS, width)
                    codes, upper, lower = now.first(cut)
                else:
                    names = [batch.column(j) for j in range(2)]
                    cut = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS, width)
                    upper = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS)
                    codes, upper, lower, _ = now.again(cut, _unpacked(batch.column(3), "u1", PARTS).astype(np.int64), upper, _unpacked(batch.column(5), "u1", PARTS, entries))
                if last:
                    apart = cut.astype(np.int64) - now.book[np.arange(PARTS)[None, :], codes]
                    code = [c.astype(np.uint8).tobytes().hex() for c in codes]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(code, pa.string()), pa.array((apart * apart).sum(axis=(1, 2)), pa.int64())], schema.names)
                else:
                    yield pa.RecordBatch.from_arrays([*names, _list(cut.reshape(-1, size).astype(np.int32)), _packed(codes, "u1"), _list(upper), _packed(lower, "u1")], held.names)

        out = written(rows.mapInArrow(run, schema if last else held), f"codes-{k}")
        if kept is not None:
            removed(kept)
        kept, before = out, book
        if not last:
            book = moved_entries(kept, book)
    restored_batches(spark)
    return kept, book


def digest(book: np.ndarray) -> str:
    """All components of all entries, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with label_error, the sum of error over rows of an equal label; nulls are one label."""
    keyed = coded.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    sums = written(keyed.groupBy("_key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n")).withColumnRenamed("_key", "_label"), "label-errors")
    return split_join(keyed, "_key", sums, "_label", "_n", "vec_id").drop("_key", "_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = coded_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


#: The same by all distances, over whole tables.
OP11_SQL = """
WITH RECURSIVE kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS n, len(v) // 16 AS w FROM kept),
parts AS (
  SELECT n, p, v[p * w + 1 : (p + 1) * w] AS x FROM numbered, (SELECT unnest(range(16)) AS p)),
start AS (SELECT p, n - 1 AS entry, x AS c FROM parts WHERE n <= 64),
near0 AS (SELECT n, p, arg_min(entry, (d, entry)) AS entry FROM (
  SELECT n, p, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN start USING (p)) GROUP BY n, p),
mean1 AS (SELECT p, entry, list(m ORDER BY j) AS c FROM (
  SELECT p, entry, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM parts JOIN near0 USING (n, p), (SELECT unnest(range(1, 1 + (SELECT max(w) FROM numbered))) AS j) GROUP BY p, entry, j) GROUP BY p, entry),
book1 AS (SELECT p, entry, coalesce(m.c, s.c) AS c FROM start s LEFT JOIN mean1 m USING (p, entry)),
near1 AS (SELECT n, p, arg_min(entry, (d, entry)) AS entry FROM (
  SELECT n, p, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN book1 USING (p)) GROUP BY n, p),
mean2 AS (SELECT p, entry, list(m ORDER BY j) AS c FROM (
  SELECT p, entry, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS m FROM parts JOIN near1 USING (n, p), (SELECT unnest(range(1, 1 + (SELECT max(w) FROM numbered))) AS j) GROUP BY p, entry, j) GROUP BY p, entry),
book2 AS (SELECT p, entry, coalesce(m.c, s.c) AS c FROM book1 s LEFT JOIN mean2 m USING (p, entry)),
near2 AS (SELECT n, p, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT n, p, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN book2 USING (p)) GROUP BY n, p),
codes AS (SELECT n, string_agg(lower(printf('%02x', entry)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY n),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM numbered JOIN codes USING (n), sha
"""
