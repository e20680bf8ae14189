"""Map outlines from points: name, poly, ring, seq, x, y."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def projected(points: DataFrame, width: float = 720.0, pad: float = 6.0) -> DataFrame:
    """px, py: equirectangular, the bounding box of all points scaled to the width; one row of bounds is broadcast."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    k = F.cos((F.col("y0") + F.col("y1")) / 2 * (math.pi / 180))
    scale = F.when(F.col("x1") > F.col("x0"), (width - 2 * pad) / ((F.col("x1") - F.col("x0")) * k)).otherwise(F.lit(1.0))
    box = box.withColumn("k", k).withColumn("scale", scale)
    both = points.crossJoin(F.broadcast(box))
    return both.select(*points.columns, (pad + (F.col("x") - F.col("x0")) * F.col("k") * F.col("scale")).alias("px"), (pad + (F.col("y1") - F.col("y")) * F.col("scale")).alias("py"))


def simplified(points: DataFrame, digits: int = 1) -> DataFrame:
    """Rounded points, consecutive equal ones once, rings of fewer than 3 points left out."""
    p = points.withColumn("px", F.round("px", digits)).withColumn("py", F.round("py", digits))
    ring = W.partitionBy("name", "poly", "ring")
    order = ring.orderBy("seq")
    same = (F.col("px") == F.lag("px").over(order)) & (F.col("py") == F.lag("py").over(order))
    kept = p.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).drop("_same")
    return kept.withColumn("_n", F.count("*").over(ring)).where("_n >= 3").drop("_n")


def paths(points: DataFrame) -> DataFrame:
    """name, d: path text of all rings in order."""
    xy = lambda p: F.concat(p["px"].cast("string"), F.lit(","), p["py"].cast("string"))
    rings = points.groupBy("name", "poly", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "px", "py"))).alias("pts"))
    text = F.concat(F.lit("M"), F.array_join(F.transform("pts", xy), "L"), F.lit("Z"))
    return rings.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("poly", "ring", text.alias("t")))), lambda x: x["t"]), "").alias("d"))


def centroids(points: DataFrame) -> DataFrame:
    """name, area, cx, cy: vertex mean of the outer ring (ring 0) of largest area."""
    ring = W.partitionBy("name", "poly").orderBy("seq")
    outer = points.where("ring = 0")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx = F.coalesce(F.lead("px").over(ring), F.first("px").over(whole))
    ny = F.coalesce(F.lead("py").over(ring), F.first("py").over(whole))
    areas = outer.withColumn("t", F.col("px") * ny - nx * F.col("py")).groupBy("name", "poly").agg(F.abs(F.sum("t") / 2).alias("area"), F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    return areas.groupBy("name").agg(F.max(F.struct("area", (-F.col("poly")).alias("p"), "cx", "cy")).alias("b")).select("name", "b.area", "b.cx", "b.cy")
