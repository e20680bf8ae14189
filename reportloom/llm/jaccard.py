"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence.

A row of the matrix is a distinct set of n-grams (documents with equal sets are one row, of the least id), a column
is an n-gram. Two rows can reach the similarity only if they share one of each row's first n - ceil(0.8 n) + 1
columns in a common order of columns (a bound from the row's size), so the product runs over those columns alone.
The order puts frequent columns last: a table of counters, filled from all documents, tells them; any order is
right, this one makes columns short.

Columns that aren't frequent are blocks of a partition, sorted by column; each is multiplied with itself in numpy, all pairs of its
rows, and overlap counts are accumulated by pair. A pair is discarded where its count, with what its frequent columns and
the rest of its sets could add, stays below the overlap that its sizes ask for. What is left is verified on whole sets.

Frequent columns are where large groups of copies lie. Each of their rows is first paired with the pivot of its size
class in the column: the row with the fewest rarer n-grams before it, that is the likest to the group's origin. Once
these pairs are verified, the group is one component, whose inner pairs can change nothing. So only rows outside a
column's largest component are then multiplied with the whole column, where places in the order allow the overlap. No link between
components is lost, and work follows the rows, not their squares, unless a frequent column holds many rows that are
nearly but not quite alike. Rows that share a passage but little else aren't such: the passage comes last in their order, where
too little is left to reach the overlap. Columns, star centres and components with a great share of all rows are dealt over tasks by
the hash of the other side.

The counters are at most MOST_SKETCH, whatever the input, so they blur as it grows: from about 10^9 documents on, columns of some
thousand rows aren't told from rare ones any more. That costs work, not links: such columns turn out long and take the frequent ones' way.

N-grams are 64-bit hashes; sets are compared by their lower 48 bits (two sets of 10,000 n-grams agree wrongly in one
n-gram with probability below one in a million).

Defined results: a text without words (null, empty, white space) has an empty set and is linked with nothing; fewer
than WORDS words are one n-gram; links are between texts, so rows that share an id but not their text may lie in different
components, each named by its own least id; a null id is in no component; equal rows give equal results; an empty table gives
an empty table; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bounded_batches, map_batches, removed, restored_batches, split_join, table, texts, unused, written

#: Words of an n-gram; link where 100 x intersection >= SHARE x union.
WORDS = 5
SHARE = 80
#: Counters for each document, least and most counters (powers of two), and slices they are summed in.
COUNTERS = 32
LEAST_SKETCH, MOST_SKETCH = 1 << 20, 1 << 26
SLICES = 16
#: Rows of a column that is multiplied whole; a longer one is treated like a frequent one.
LONG = 400
#: Ids that are broadcast at most (32 bytes each); beyond, texts are joined by shuffle.
BROADCAST_IDS = 200_000
#: Power of two of a frequent column's rows that go to one task of its join with its pivots.
TASK_LEVEL = 17
#: Words whose hashes a worker remembers.
MEMO = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Shingler:
    """Sorted distinct 64-bit hashes of a text's n-grams."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        new = [w for w in set(words) if w not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set(words)
        for w in new:
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            s = np.full(n, k, np.uint64)
            for j in range(k):
                s = (s ^ h[j : j + n]) * _ODD[j % 5]
                s ^= s >> np.uint64(29)
            s *= np.uint64(0xBF58476D1CE4E5B9)
            s ^= s >> np.uint64(32)
        return np.unique(s)


def signature(h: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two 64-bit sums that tell sets of hashes apart."""
    if not len(h):
        return np.int64(0), np.int64(0)
    with np.errstate(over="ignore"):
        return h.sum(dtype=np.uint64).astype(np.int64), ((h ^ (h >> np.uint64(31))) * _ODD[3]).sum(dtype=np.uint64).astype(np.int64)


def least_overlap(n: int) -> int:
    """Of a set of n with any partner: ceil(SHARE / 100 n)."""
    return (SHARE * n + 99) // 100


# ---- counters ----


def sketch(docs: DataFrame) -> np.ndarray:
    """Counters of n-grams over all documents, each document's set once. Their number follows the documents, up to
    MOST_SKETCH, which bounds what is gathered and broadcast."""
    size = min(MOST_SKETCH, max(LEAST_SKETCH, 1 << (COUNTERS * docs.count()).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, total = Shingler(), np.zeros(size, np.uint32)
        held: list[np.ndarray] = []
        some = 0

        def put() -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            total[at] += n.astype(np.uint32)
            held.clear()

        for batch in batches:
            for t in texts(batch, 0):
                held.append((make.hashes(t) & np.uint64(size - 1)).astype(np.int32))
                some += len(held[-1])
                if some > 2_000_000:
                    put()
                    some = 0
        if held:
            put()
        if total.any():
            for k, part in enumerate(np.split(total, SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "counters"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            packed = zlib.compress(np.minimum(part, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["slice", "counters"])

    bounded_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, "slice int, counters binary")
    sums = parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, counters binary").collect()  # at most MOST_SKETCH counters
    out = np.zeros(size, np.uint32)
    for r in sums:
        out.reshape(SLICES, -1)[r["slice"]] = np.frombuffer(zlib.decompress(r["counters"]), np.uint32)
    return out


def levels_of(counters: np.ndarray) -> np.ndarray:
    """0 for columns that are not known to be frequent; else the power of two of their counter."""
    noise = float(counters.sum()) / len(counters)
    level = np.floor(np.log2(np.maximum(counters, 1))).astype(np.uint8)
    level[counters <= 16 + 3 * noise] = 0
    return level


# ---- rows and columns ----


def rows_of(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, h (hash of the text), n, s1, s2 (signature of the set), columns (the first ones of the common order), often (how
    many of them are frequent; these are the last), levels (of the frequent ones)."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def make():
        shingler, level_of = Shingler(), sent.value
        mask = np.uint64(len(level_of) - 1)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, first, second, often, flat, ends = [], [], [], [], [], [0]
            tall, tops = [], [0]
            for text in texts(batch, 2):
                h = shingler.hashes(text)
                n = len(h)
                a, b = signature(h)
                sizes.append(n)
                first.append(a)
                second.append(b)
                take = n - least_overlap(n) + 1 if n > 3 else 0  # smaller sets are linked with equal ones alone
                many = 0
                if take:
                    level = level_of[(h & mask).astype(np.int64)]
                    if level.any():
                        order = np.argsort(level, kind="stable")[:take]
                        many = int((level[order] > 0).sum())
                        if many:
                            tall.append(level[order[take - many :]].astype(np.int8))
                        h = h[order]
                    flat.append(h[:take])
                often.append(many)
                tops.append(tops[-1] + many)
                ends.append(ends[-1] + take)
            columns = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(columns))
            heights = pa.ListArray.from_arrays(pa.array(tops, pa.int32()), pa.array(np.concatenate(tall) if tall else np.zeros(0, np.int8)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists, pa.array(often, pa.int32()), heights], ["doc_id", "h", "n", "s1", "s2", "columns", "often", "levels"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return map_batches(rows, make, "doc_id long, h long, n int, s1 long, s2 long, columns array<long>, often int, levels array<tinyint>")


def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (column, rep, n, often, place) sorted by column: kind 0: pair a, b, how many columns it shares here, and how many it
    has to share; kind 1: a row b of a column a that is too long, its n and place, and the power of two of its rows as level."""
    rest: list[np.ndarray] | None = None

    def product(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        col, rep, n, often, at = part
        if not len(col):
            return
        starts = np.flatnonzero(np.concatenate(([True], col[1:] != col[:-1])))
        size = np.diff(np.append(starts, len(col)))
        run = np.repeat(np.arange(len(starts)), size)
        here = size[run]
        found = []
        rows = np.flatnonzero((here > 1) & (here <= LONG))
        for d in range(1, LONG):
            rows = rows[here[rows] > d]
            if not len(rows):
                break
            x, y = rows[:-d], rows[d:]
            good = (run[x] == run[y]) & (rep[x] != rep[y])
            x, y = x[good], y[good]
            n1, n2 = n[x], n[y]
            good = (100 + SHARE) * np.minimum(n1, n2) >= SHARE * (n1 + n2)
            x, y, n1, n2 = x[good], y[good], n1[good], n2[good]
            ask = (SHARE * (n1 + n2) + 99 + SHARE) // (100 + SHARE)
            ask -= (SHARE * np.maximum(n1, n2) + 99) // 100 - 1 + np.minimum(often[x], often[y])
            found.append((np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y]), ask))
        long = np.flatnonzero(here > LONG)
        if len(long):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(long), np.int8)), pa.array(col[long]), pa.array(rep[long]), pa.array(n[long].astype(np.int32)), pa.array(at[long].astype(np.int32)), pa.array(np.log2(here[long]).astype(np.int8))], ["kind", "a", "b", "n", "place", "level"])
        if found:
            a, b, ask = (np.concatenate(x) for x in zip(*found))
            if len(a):
                order = np.lexsort((b, a))
                a, b, ask = a[order], b[order], ask[order]
                new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                count = np.diff(np.append(new, len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(new), np.int8)), pa.array(a[new]), pa.array(b[new]), pa.array(count.astype(np.int32)), pa.array(ask[new].astype(np.int32)), pa.array(np.zeros(len(new), np.int8))], ["kind", "a", "b", "n", "place", "level"])

    for batch in batches:
        part = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
        if rest is not None:
            part = [np.concatenate((a, b)) for a, b in zip(rest, part)]
        if not len(part[0]):
            continue
        last = np.flatnonzero(part[0] != part[0][-1])
        cut = last[-1] + 1 if len(last) else 0
        yield from product([a[:cut] for a in part])
        rest = [a[cut:] for a in part]
    if rest is not None:
        yield from product(rest)


def overlap_allowed(n: str, at: str, m: str, to: str):
    """Can sets of n and m reach the overlap if their first common column is at these places?"""
    return F.lit(100 + SHARE) * F.least(F.col(n) - F.col(at), F.col(m) - F.col(to)) >= F.lit(SHARE) * (F.col(n) + F.col(m))


def pivoted(dense: DataFrame) -> DataFrame:
    """Pairs (a, b) of the rows of frequent columns (column, rep, n, place, level) with the pivots of their size class, and of the
    neighbouring ones. A column's level, which all its rows know, tells over how many tasks they are dealt."""
    cls = F.floor(F.log("n") / F.log(F.lit(10 / 9)))
    tasks = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("level").cast("int") - TASK_LEVEL)).cast("int")
    rows = dense.withColumn("cls", cls).withColumn("tasks", tasks)
    pivots = rows.groupBy("column", "cls", "tasks").agg(F.min(F.struct("place", "n", "rep")).alias("p"))
    near = pivots.select(F.col("column").alias("c"), F.col("tasks").alias("t"), F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("k"), F.col("p.rep").alias("y"), F.col("p.n").alias("yn"), F.col("p.place").alias("yp"))
    near = near.select("*", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("s"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("tasks")).cast("int"))
    both = dealt.join(near, (F.col("column") == F.col("c")) & (F.col("cls") == F.col("k")) & (F.col("salt") == F.col("s")) & (F.col("rep") != F.col("y")) & overlap_allowed("n", "place", "yn", "yp"))
    return both.select(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b")).distinct()


# ---- verification and components ----


def _few(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast if they are counted to be few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else keys


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are linked; nodes: node, rep, s1, s2."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = written(asked.join(nodes, F.col("id") == F.col("node")).select("id", "rep", "s1", "s2"), "jaccard-ids")

    def make_sets():
        shingler = Shingler()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            held, data = [], []
            for k, (t, a, b) in enumerate(zip(texts(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                h = shingler.hashes(t)
                if signature(h) == (a, b):  # rows of this id may have other texts
                    low = np.unique(h & np.uint64((1 << 48) - 1))
                    held.append(k)
                    data.append(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held, pa.int32())), pa.array(data, pa.binary())], ["id", "grams"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_few(ids), F.col("doc_id") == F.col("rep"))
    sets = written(map_batches(rows.select("id", "text", "s1", "s2"), make_sets, "id long, grams binary").distinct(), "jaccard-sets")
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    sized = pairs.select("a", "b").join(left, "a").join(right, "b")

    def make():
        def grams(data: bytes) -> np.ndarray:
            raw = np.zeros((len(data) // 6, 8), np.uint8)
            raw[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
            return raw.view("<u8").ravel()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = grams(x), grams(y)
                both = np.concatenate((x, y))
                both.sort()
                good.append((100 + SHARE) * int((both[1:] == both[:-1]).sum()) >= SHARE * len(both))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

        return work

    links = written(map_batches(sized.select("a", "b", "x", "y"), make, "a long, b long").distinct(), "jaccard-links")
    removed(ids, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """id, label (least id of its component) for each end of the edges (a, b): large star and small star in
    turn until nothing changes, which takes about the logarithm of the longest path; each round is written, so that lineage stays short."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")).withColumnRenamed("u", "k"), "star-least")
        large = written(split_join(both.where("v > u"), "u", least, "k", "c", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "star")
        removed(now, least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumnRenamed("u", "k"), "star-least")
        small = split_join(large, "u", least, "k", "c", "v")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = written(small, "star")
        removed(large, least)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if last == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
        last = mark


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, s1, s2 of each document; s1, s2, size, component (a number of its own), least (its least id) of each distinct set)."""
    spark = docs.sparkSession
    rows = written(rows_of(docs, levels_of(sketch(docs))), "jaccard-rows")
    sets = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "often", "columns", "levels")).alias("r"))
    sets = written(sets.select("s1", "s2", "n", F.col("r.doc_id").alias("rep"), "r.often", "r.columns", "r.levels"), "jaccard-distinct")
    # A node of the graph is a set's least id; where sets of several texts share theirs, a hash of id and set.
    shared = written(sets.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("id")), "jaccard-shared")
    plain = shared.isEmpty()
    named = sets.withColumn("node", F.col("rep"))
    if not plain:
        several = F.col("id").isNotNull()
        named = sets.join(shared, F.col("rep") == F.col("id"), "left").withColumn("node", F.when(several, F.xxhash64("rep", "s1", "s2", "n")).otherwise(F.col("rep"))).drop("id")
    nodes = named.select("node", "rep", "s1", "s2")
    cells = named.where("n > 3").select("node", "n", "often", "levels", F.size("columns").alias("size"), F.posexplode("columns").alias("place", "column"))
    first = F.col("size") - F.col("often")
    often = cells.where(F.col("place") >= first).select("column", F.col("node").alias("rep"), "n", "place", F.element_at("levels", (F.col("place") - first + 1).cast("int")).alias("level"))
    often = written(often, "jaccard-dense")
    dealt = cells.where(F.col("place") < first).select("column", F.col("node").alias("rep"), "n", "often", "place").repartition("column").sortWithinPartitions("column")
    bounded_batches(spark, 50_000)
    found = written(dealt.mapInArrow(multiplied, "kind byte, a long, b long, n int, place int, level tinyint"), "jaccard-product")
    bounded_batches(spark, BATCH_ROWS)
    counted = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("shared"), F.max("place").alias("ask"))
    longer = found.where("kind = 1").select(F.col("a").alias("column"), F.col("b").alias("rep"), "n", "place", "level")
    dense = often
    if not longer.isEmpty():
        # Columns that turned out long weren't multiplied: what they could add is credited to their rows.
        credit = longer.groupBy("rep").agg(F.count("*").alias("c"))
        counted = counted.join(credit.toDF("a", "ca"), "a", "left").join(credit.toDF("b", "cb"), "b", "left")
        counted = counted.withColumn("ask", F.col("ask") - F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0))))
        dense = often.unionByName(longer)
    pairs = written(counted.where("shared >= ask").select("a", "b").unionByName(pivoted(dense)).distinct(), "jaccard-pairs")
    links = verified(docs, pairs, nodes)
    labels = components(links)
    more = crossing(dense, labels, pairs)
    if more is not None:
        extra = verified(docs, more, nodes)
        if not extra.isEmpty():
            labels = components(extra.unionByName(labels.select(F.col("label").alias("a"), F.col("id").alias("b"))))
    result = named.join(labels, F.col("node") == F.col("id"), "left").select("s1", "s2", F.col("n").alias("size"), "rep", F.coalesce("label", "node").alias("component"))
    if plain:
        result = result.withColumn("least", F.col("component"))
    else:
        least = result.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("sets"))
        result = split_join(result, "component", least.withColumnRenamed("component", "of"), "of", "sets", "s1")
    result = written(result.select("s1", "s2", "size", "component", "least"), "jaccard-classes")
    removed(sets, shared, often, found, pairs)
    restored_batches(spark)
    return rows.select("doc_id", "h", "n", "s1", "s2"), result


def crossing(dense: DataFrame, labels: DataFrame, done: DataFrame) -> DataFrame | None:
    """New pairs of rows of a long column that lie in different components: rows outside the column's largest component against the whole column."""
    held = dense.join(labels, F.col("rep") == F.col("id"), "left").select("column", "rep", "n", "place", F.coalesce("label", "rep").alias("label"))
    held = written(held, "jaccard-held")
    sizes = held.groupBy("column", "label").agg(F.count("*").alias("rows"))
    most = sizes.groupBy("column").agg(F.max(F.struct("rows", "label")).alias("most"), F.sum("rows").alias("rows"), F.count("*").alias("parts")).where("parts > 1")
    most = written(most.select(F.col("column").alias("c"), F.col("most.label").alias("largest"), "rows"), "jaccard-largest")
    other = F.col("label") != F.col("largest")
    few = split_join(held, "column", most.withColumn("held", F.col("rows")), "c", "held", "rep").where(other)
    few = written(few.select("column", F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xp"), F.col("label").alias("xl"), "rows"), "jaccard-few")
    removed(most)
    if few.isEmpty():
        removed(held, few)
        return None
    all_rows = held.select("column", F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("place").alias("yp"), F.col("label").alias("yl"))
    both = split_join(all_rows, "column", few.withColumnRenamed("column", "c"), "c", "rows", "y").where((F.col("xl") != F.col("yl")) & overlap_allowed("xn", "xp", "yn", "yp"))
    pairs = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    fresh = written(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-crossing")
    removed(held, few)
    return None if fresh.isEmpty() else fresh


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_shingles, component (a number of its own), component_id for each row of docs."""
    rows, named = classes(docs)
    named = named.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "size", "component", "least")
    out = rows.join(named, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n") == F.col("size")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), "component", F.coalesce("least", "doc_id").alias("component_id"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    return placed(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the least id, and of rows that share it that of the least hash of its text;
    columns as before. Texts without words and rows without an id stay; of rows that share both id and text, one stays: the first by
    its columns' JSON."""
    marked = written(placed(docs), "jaccard-marked")
    gone = marked.where(F.col("component_id") != F.col("doc_id")).select("doc_id", "h")
    own = marked.where("component IS NOT NULL AND component_id = doc_id")
    versions = own.groupBy("component").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first <> last").select(F.col("component").alias("of"), "first")
    later = own.join(versions, (F.col("component") == F.col("of")) & (F.col("h") != F.col("first"))).select("doc_id", "h")
    i, j = unused(docs, "_id"), unused(docs, "_h")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(j))
    kept = docs.join(_few(written(gone.unionByName(later).distinct().toDF(i, j), "jaccard-gone")), same, "left_anti")
    twice = written(marked.where("doc_id IS NOT NULL").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h").toDF(i, j), "jaccard-twice")
    removed(marked)
    if twice.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(_few(twice), same).groupBy(i, j).agg(F.min_by(row, F.to_json(row)).alias(i + "r")).select(f"`{i}r`.*")
    return kept.join(_few(twice), same, "left_anti").unionByName(once)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
