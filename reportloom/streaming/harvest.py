"""Incremental harvest: new page records are merged into a table by key, the last one read wins.

The table is partitioned by buckets of keys, as many as its rows ask for when it is made (ROWS each; `rebucket` deals a table that has
grown anew). A batch is staged first, then its buckets replace those of the table, so that a batch that runs twice gives the same table.
Buckets that a batch does not touch are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a bucket is made for, and the most buckets.
ROWS = 20_000
MOST = 20_000
#: Buckets of tables that don't tell how many they have.
UNTOLD = 64


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the greatest by order. An aggregate, so that rows of a hot key meet in every task first."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


class _Folder:
    """A folder in the cluster's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(self.path + name)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), True)
        out.writeUTF(text)
        out.close()

    def read(self, name: str) -> str:
        found = self.fs.open(self.at(name))
        text = found.readUTF()
        found.close()
        return text


def bucket_count(spark: SparkSession, path: str, rows: int) -> int:
    """The buckets of a table, or those that a new one of so many rows is to have."""
    folder = _Folder(spark, path)
    if folder.exists("/_buckets"):
        return int(folder.read("/_buckets"))
    return UNTOLD if folder.exists() else max(1, min(MOST, -(-rows // ROWS)))


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def upsert(spark: SparkSession, batch: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Merge a batch into the table at path."""
    folder = _Folder(spark, path)
    if not folder.exists() and folder.exists(".old"):  # a rebucket() that was stopped between its renames
        folder.fs.rename(folder.at(".old"), folder.at())
    new = latest(batch, key, order)
    buckets = bucket_count(spark, path, 0 if folder.exists() else new.count())
    new = _bucketed(new, key, buckets)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most MOST
    if not touched:
        return
    if folder.exists():
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        new = latest(new.unionByName(old.select(*new.columns)), key, order)
    staged = f"{folder.path}.staged"
    new.write.mode("overwrite").partitionBy("bucket").parquet(staged)
    spark.read.parquet(staged).select(*new.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    folder.write("/_buckets", str(buckets))


def rebucket(spark: SparkSession, path: str, key: str) -> int:
    """Deal a table anew over as many buckets as its rows ask for, if those are over four times what it has or under a quarter; returns how
    many it has then. The new table is whole before it takes the place of the old one."""
    rows, folder = spark.read.parquet(path), _Folder(spark, path)
    have, want = bucket_count(spark, path, 0), max(1, min(MOST, -(-rows.count() // ROWS)))
    if have / 4 <= want <= have * 4:
        return have
    made = _Folder(spark, f"{folder.path}.new")
    _bucketed(rows.drop("bucket"), key, want).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(made.path)
    made.write("/_buckets", str(want))
    folder.fs.delete(folder.at(".old"), True)
    folder.fs.rename(folder.at(), folder.at(".old"))
    folder.fs.rename(made.at(), folder.at())
    folder.fs.delete(folder.at(".old"), True)
    return want


def start(spark: SparkSession, landing: str, schema: str, path: str, checkpoint: str, key: str, order: list[str], after=None, once: bool = True):
    """Read JSON records that land in a folder and merge them; after(spark) runs once a batch is merged (classify and
    publish anew, for example). once: all that has landed, then stop; else a batch a minute. The query that is returned tells how it
    stands (status, lastProgress) and is stopped by stop()."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(landing)

    def merge(batch: DataFrame, _: int) -> None:
        upsert(spark, batch, path, key, order)
        if after is not None:
            after(spark)

    out = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 minute")).start()
