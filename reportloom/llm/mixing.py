"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Each source gets a share of all words by its weight, at most MOST times its own size; what is above is shared
anew by weight among the rest. A source first takes all its documents as often as the target holds its whole size
(complete epochs); the rest of the target is filled in the order of exponential keys -ln(u) / quality, where u
comes from a digest of id and text, so that reruns agree. The prefix sum of sizes in that order is made in two
levels: sums of BUCKETS ranges of the key's value for each source, then a window inside the one range of each source
in which its budget ends. So a source with a third of all rows is dealt over all tasks; the windows of the first
level run over sources times BUCKETS sums, those over all sources over one row a source.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, the
last; a source of size 0 has target 0; equal rows stand at one place of the
order and are taken alike; an empty table gives an empty table; columns named as those made here don't disturb.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, unused, written

#: Fixed values of the query: weights by the place of the source, repeating; the cap on a target.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Ranges of key values for the two-level prefix sum.
BUCKETS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight of a document, 0.5 to 2: nearer 2 the more of its first-level tokens are plain words, measured by the
    share of letters, digits and spaces among its code points."""
    n = F.length(text)
    plain = F.length(F.translate(text, "#$%&*|<>{}[]\\^~=_@/+", ""))
    return F.when(n > 0, 0.5 + 1.5 * plain / n).otherwise(F.lit(1.0))


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from 52 bits of a digest of id and text."""
    d = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(d, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size).

    With r = most x size / weight, the capped sources are those of least r: sorted by r, the level a source of unit
    weight gets, once all before it are capped, is (total - their caps) / (weights left); the first level that no
    further source's r is below holds for all that are left.
    """
    n = len(weights)
    place = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    every = W.partitionBy()
    order = W.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("r", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / F.col("left"))
    )
    found = levels.withColumn("held", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("held.level"), F.col("cap")))
    return found.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, row_hash, source, size, source_size, target, taken for each row; row_hash tells rows of one id apart."""
    size = words(F.col("text"))
    key = -F.log(uniform(F.col("doc_id"), F.col("text"))) / quality(F.col("text"), size)
    rows = written(
        docs.select("doc_id", "source", F.xxhash64("text").alias("row_hash"), size.alias("size"), key.alias("key")).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")),
        "mix",
    )
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.withColumn("before", before).join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranges = ranges.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "bucket_size", "source_size", "target", "epochs", "rest")
    placed = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    # Whole ranges below the budget are taken, those above aren't; order matters only in the range where it ends.
    ends = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest"))
    extra = F.when(F.col("before") + F.col("bucket_size") <= F.col("rest"), F.col("size")).otherwise(0)
    columns = ["doc_id", "row_hash", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")]
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "row_hash")
    sum_here = F.col("before") + F.sum("size").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    # The document that crosses the budget is taken if its middle is below it: the nearest whole choice.
    last = placed.where(ends).withColumn("upto", sum_here).withColumn("extra", F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(0))
    return placed.where(~ends).withColumn("extra", extra).select(*columns).unionByName(last.select(*columns))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken; columns as before."""
    names = docs.columns
    i, h, s, times = (unused(docs, x) for x in ("_id", "_hash", "_source", "_times"))
    taken = mix(docs, weights, most).where("taken > 0").select(F.col("doc_id").alias(i), F.col("row_hash").alias(h), F.col("source").alias(s), F.expr("taken div size").cast("int").alias(times))
    both = docs.join(taken.distinct(), F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.xxhash64("text") == F.col(h)))
    return both.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH base AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substring(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    CASE WHEN length(text) > 0 THEN 0.5 + 1.5 * length(regexp_replace(text, '[#$%&*|<>{}\[\]\\^~=_@/+]', '', 'g')) / length(text) ELSE 1.0 END AS q
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, (source_size * 3)::DOUBLE AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM src),
levels AS (SELECT *, cap / weight AS r,
    ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER w, 0)) / ((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT level FROM levels WHERE level <= r ORDER BY r, level LIMIT 1),
goal AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM held), cap)) AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goal),
keyed AS (SELECT b.doc_id, b.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY -ln(b.u) / b.q, b.doc_id) AS upto
  FROM base b JOIN epochs e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN upto - size / 2.0 <= rest THEN size ELSE 0 END)::BIGINT AS taken FROM keyed
"""
