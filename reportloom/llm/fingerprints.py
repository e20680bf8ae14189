"""Document fingerprints: a homomorphic multiset hash of the paragraphs of a text, by DataFrame functions only.

Each paragraph (line) is hashed into a wide vector: EXACT sums of 32 bits, from hashes of the whole paragraph, and
SUMS sums of two 31-bit lanes each, that count the set hash bits of its word pairs: a lane doesn't wrap below 2^30 pairs, more
than a string can hold. The fingerprint of a text is the sum of the vectors of its paragraphs, modulo 2^32 and 2^62. So it does not depend on their order, a paragraph is
put in or taken out by adding or subtracting its vector (added, removed), and equal multisets of paragraphs have equal
fingerprints. A bit of a hash is a random sign; the lanes are a tug-of-war sketch of the multiset of word pairs, whose
squared distances they estimate: likeness is 1 - |A - B|^2 / (|A|^2 + |B|^2), at least 0.

A text's features are exploded and summed in its own task before anything is shuffled. The next document in descending
order of ids is found by windows over ranges of ids (bounds: approximate percentiles), on rows of fixed size; only
the part of a text that its predecessor takes over is sent to it.

Defined results: a null text is the empty text, whose one paragraph is empty; two texts without words are alike (1.0);
a null id comes last; rows of one id follow each other by the hash of their texts; a single row is its own next;
an empty table gives an empty table; further columns are not read. Rows without an id are dealt over tasks by the hash of their text;
equal rows (id and text) are numbered in one task, without their texts' being held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Sums of two lanes for word pairs, and of 32 bits for whole paragraphs.
SUMS = 48
EXACT = 8
LANE = 31
LANES = 1 | 1 << LANE
WHOLE = (1 << 2 * LANE) - 1
#: A word with the next one of its line; the last word of a line alone.
PAIR = r"(?=(\S++(?:\s++\S++)?))\S++"
LOWEST = -(1 << 63)


def features(text: Column) -> Column:
    """Array of a text's features: each paragraph, marked by U+0000, and its word pairs."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda p: F.array_append(F.regexp_extract_all(p, F.lit(PAIR), F.lit(1)), F.concat(F.lit("\0"), p))))


def _mask(k: int) -> int:
    return 0xFFFFFFFF if k <= EXACT else WHOLE


def vector(feature: Column) -> Column:
    """Aggregate: the array of sums of all features of a group; count of word pairs first."""
    whole = F.startswith(feature, F.lit("\0"))
    hashes = [F.xxhash64(feature), F.xxhash64(feature, F.lit(1))]
    exact = []
    for seed in range(EXACT // 2):
        h = F.when(whole, F.xxhash64(feature, F.lit(2 + seed))).otherwise(F.lit(0).cast("long"))
        exact += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    pairs = []
    for h in hashes:
        h = F.when(whole, F.lit(0).cast("long")).otherwise(h)
        pairs += [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES))) for j in range(SUMS // 2)]
    sums = [F.sum(F.when(whole, 0).otherwise(1).cast("long")), *exact, *pairs]
    return F.array(*[x.bitwiseAND(F.lit(_mask(k))) for k, x in enumerate(sums)])


def added(a: Column, b: Column) -> Column:
    """Vector of a text with the paragraphs of another put in."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), lambda x, k: x.bitwiseAND(F.when(k <= EXACT, F.lit(0xFFFFFFFF)).otherwise(F.lit(WHOLE))))


def removed(a: Column, b: Column) -> Column:
    """Vector of a text with the paragraphs of another taken out."""
    return F.transform(F.zip_with(a, b, lambda x, y: x - y), lambda x, k: x.bitwiseAND(F.when(k <= EXACT, F.lit(0xFFFFFFFF)).otherwise(F.lit(WHOLE))))


def as_text(v: Column) -> Column:
    """A vector's fingerprint as a hex string: 8 digits for the count and each exact sum, 16 for two lanes."""
    return F.concat(*[F.lpad(F.lower(F.hex(v[k].bitwiseAND(F.lit(_mask(k))))), 8 if k <= EXACT else 16, "0") for k in range(1 + EXACT + SUMS)])


def _square(sums: Column, count: Column) -> Column:
    """Sum of the squared signed sums, from an array of lanes' counts and the count of features."""
    half = 1 << LANE - 1
    signed = lambda c: F.pmod(2 * c - count + half, F.lit(2 * half)) - half
    return F.aggregate(sums, F.lit(0.0), lambda s, c: s + F.pow(signed(c).cast("double"), F.lit(2.0)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: how much of the word pairs of two texts is common, from their vectors."""
    low = lambda x: x.bitwiseAND(F.lit((1 << LANE) - 1))
    packed = lambda v: F.slice(v, 2 + EXACT, SUMS)
    lanes = lambda v: F.concat(F.transform(packed(v), low), F.transform(packed(v), lambda x: low(F.shiftright(x, LANE))))
    apart = _square(F.zip_with(lanes(a), lanes(b), lambda x, y: x - y), a[0] - b[0])
    both = _square(lanes(a), a[0]) + _square(lanes(b), b[0])
    return F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / both))).otherwise(F.when(apart > 0, 0.0).otherwise(1.0))


def vectors(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and v, the vector of each row's text; keys tell the rows apart."""
    return rows.select(*keys, F.explode(features(F.col(text))).alias("_f")).groupBy(*keys).agg(vector(F.col("_f")).alias("v"))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n_chars, v for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("_row"), text.alias("text"))
    return vectors(rows, ["_row", "doc_id", "h", "n_chars"]).drop("_row")


def with_next(prints: DataFrame, parts: int) -> DataFrame:
    """The rows of fingerprints() with ord (id, null lowest), h, k (place among rows of one id and hash), next_ord, next_h, next_k and
    next_v of the row that follows in descending order of ids, rows of one id by h and k; the first follows the last. Rows
    without an id are dealt by ranges of h."""
    rows = prints.withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("ord", "h").orderBy(F.lit(0))))
    bounds = prints.agg(F.percentile_approx("doc_id", [j / parts for j in range(1, parts)], 10_000).alias("bounds"))
    # One row of at most `parts` bounds: it is joined to all rows by broadcast.
    ids = F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("ord"))), F.lit(0))
    # Ranges of rows without an id are negative: a range's number falls along the order, as with ids.
    ranged = rows.join(F.broadcast(bounds)).withColumn("range", F.when(F.col("doc_id").isNull(), -513 - F.shiftright("h", 54)).otherwise(ids).cast("int")).drop("bounds")
    here = F.struct("ord", "h", "k", "v")
    inside = W.partitionBy("range").orderBy(F.col("ord").desc(), "h", "k")
    ranged = ranged.withColumn("nxt", F.lead(here).over(inside))
    # The first row of each range: at most `parts` + 1024 rows, so that a window over all of them is small.
    heads = ranged.groupBy("range").agg(F.min_by(here, F.struct(-(F.col("ord") + 1), F.col("h"), F.col("k"))).alias("head"))
    every = W.orderBy(F.col("range").desc())
    follow = heads.select("range", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    out = ranged.join(F.broadcast(follow), "range").withColumn("nxt", F.coalesce("nxt", "after"))
    return out.select("doc_id", "ord", "h", "k", "n_chars", "v", F.col("nxt.ord").alias("next_ord"), F.col("nxt.h").alias("next_h"), F.col("nxt.k").alias("next_k"), F.col("nxt.v").alias("next_v"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = max(2, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    prints = written(fingerprints(docs), "prints")
    chain = written(with_next(prints, parts), "chain")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("ord"), F.xxhash64(text).alias("h"), text.alias("text"))
    whole = whole.withColumn("k", F.row_number().over(W.partitionBy("ord", "h").orderBy(F.lit(0))))
    want = chain.select(F.col("ord").alias("to_ord"), F.col("h").alias("to_h"), F.col("k").alias("to_k"), "next_ord", "next_h", "next_k", F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    same = lambda kind: (F.col("ord") == F.col(f"{kind}_ord")) & (F.col("h") == F.col(f"{kind}_h")) & (F.col("k") - F.col(f"{kind}_k") == 0)
    # Places among equal rows are compared as a difference: both sides stay dealt by id and hash alone.
    sent = whole.join(want, same("next")).select("to_ord", "to_h", "to_k", "need", F.substring("text", F.lit(1), F.col("need")).alias("lent"))
    own = whole.join(sent, same("to"))
    own = own.select("ord", "h", "k", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("need")), "lent").alias("edited"))
    edited = own.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    edited = vectors(edited, ["ord", "h", "k", "edited_sha256"], "edited").select("ord", "h", F.col("k").alias("e_k"), "edited_sha256", F.col("v").alias("e"))
    both = chain.join(edited, ["ord", "h"]).where(F.col("k") - F.col("e_k") == 0)
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"))
