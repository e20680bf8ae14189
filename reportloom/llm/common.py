"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that a Python worker holds at a time.
BATCH_ROWS = 400
BATCH_BYTES = 8 << 20


#: What sessions had set before bounded_batches().
_BEFORE: dict[str, dict[str, str]] = {}
#: Folders of local sessions without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}
#: Rows of one key from which a join deals them over SPLITS tasks.
HOT_ROWS = 200_000
SPLITS = 64


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small, so that long texts don't fill a Python worker. The settings are the session's and are read
    when a plan runs: what returns a plan with Python stages leaves them set, what returns tables calls restored_batches()."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    _BEFORE.setdefault(spark.sparkContext.applicationId, {n: spark.conf.get(n) for n in names})
    spark.conf.set(names[0], str(rows))
    spark.conf.set(names[1], str(BATCH_BYTES))


def restored_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches as it was before bounded_batches()."""
    for name, value in _BEFORE.pop(spark.sparkContext.applicationId, {}).items():
        spark.conf.set(name, value)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Where the setting is missing, a local master's driver and executors are one machine and a temporary folder of it does
    (checkpoint() is told of it as well); on any other master ValueError is raised, since a machine's own folder would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="reportloom-shared-")
            context.setCheckpointDir(_LOCAL[context.applicationId])
        base = _LOCAL[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """(file system, path) of a folder, in the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def temporary(spark: SparkSession, name: str) -> str:
    """A path as of shared_dir() that is deleted when the driver ends, if it isn't before."""
    path = shared_dir(spark, name)
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them again: this cuts lineage, survives the loss
    of executors and tells Catalyst the true size, so that it broadcasts only what is small. removed() deletes the
    files once nothing reads them any more; the rest goes when the driver ends."""
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete the files behind tables that written() made and that no plan reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, at = _at(df.sparkSession, folder)
            fs.delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to be none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_join(big: DataFrame, key: str, small: DataFrame, small_key: str, count: str, spread: str) -> DataFrame:
    """big joined with small, which tells in column count how many rows of big each of its keys has. Keys with more than
    HOT_ROWS are dealt over SPLITS tasks by the hash of big's column spread, and small's rows of them are repeated as often.
    Hot keys are at most big's rows / HOT_ROWS; they are written, so that Catalyst broadcasts them only while they are few."""
    hot = small.where(F.col(count) > HOT_ROWS).select(F.col(small_key).alias("_hot")).distinct()
    if hot.isEmpty():
        return big.join(small.drop(count), F.col(key) == F.col(small_key))
    hot = written(hot, "hot-keys")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SPLITS))).otherwise(F.lit(0)).cast("int")
    dealt = big.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col(count) > HOT_ROWS, F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    spread_out = small.select("*", F.explode(salts).alias("_other")).drop(count)
    return dealt.join(spread_out, (F.col(key) == F.col(small_key)) & (F.col("_salt") == F.col("_other"))).drop("_salt", "_other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with a function that make() builds once for each task."""
    bounded_batches(df.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, k: int) -> list[str]:
    """Column k as strings, null as the empty text."""
    return [x or "" for x in batch.column(k).to_pylist()]


def with_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """The table with a column of this name, null where it is missing."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
