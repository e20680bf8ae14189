"""Dealing small inputs over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Estimated bytes for each core up to which an input may lie in few splits and is dealt anew.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small input in as many partitions as the session has cores. A small file is one split, so that costly work on each
    row would be one task; a large one has splits enough and is left alone. Decided by Catalyst's estimate of the size, nothing runs."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate <= SMALL * cores else df
