"""Files in and out: JSON maps, taxonomies, geometry, header-and-rows tables, binary files, published forms."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import Region, Rule, Taxonomy
from . import bigjson

#: Largest file that is read whole.
FILE_BYTES = 60_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, deleted when the driver ends. Without that setting a local master,
    whose driver and executors are one machine, uses a temporary folder; on any other master ValueError is raised."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reportloom-scratch-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and the record's columns of a JSON file that maps keys to records of this schema; read in ranges, so the file may be of any size."""
    return bigjson.entries(spark, path).select("key", F.from_json("value", value).alias("r")).select("key", "r.*")


def read_taxonomy(spark: SparkSession, path: str) -> Taxonomy:
    """Rules, regions and policies from a JSON file (one small document)."""
    spec = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    named = lambda d: {k: x for k, x in (d or {}).items() if not k.startswith("_")}
    return Taxonomy(
        rules=[Rule(c["key"], c["label"], c["include"], c.get("exclude", []), bool(c.get("require_state"))) for c in spec["components"]],
        regions=[Region(n, r["aliases"], r["states"]) for n, r in spec["regions"].items()],
        state_patterns=named(spec.get("state_patterns")),
        default_region={k: [(r["before"], r["region"]) for r in rules if isinstance(r, dict)] for k, rules in named(spec.get("component_default_region")).items()},
        component_states=named(spec.get("component_states")),
        subject_state_from_summary=[x for x in spec.get("subject_state_from_summary") or []],
        rounds={k: int(n) for k, n in named(spec.get("mobility_tracking_rounds")).items()},
        round_ranges={k: (r[0], r[1]) for k, r in named(spec.get("needs_monitoring_rounds")).items()},
        scope=spec.get("scope_title_regex") or "",
        other=(spec.get("unclassified_key", "other"), spec["unclassified_label"]),
        states_from_summary=bool(spec.get("states_from_summary")),
    )


def read_config(spark: SparkSession, path: str, **given: object) -> dict:
    """A run's settings from a JSON file (one small document): seeds, templates, keywords, limits; what is given replaces them."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"]) | {k: x for k, x in given.items() if x is not None}


def header_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of a table kept as cols (names) and rows (arrays): the wanted columns by their place in cols, null where it has none."""
    rows = df.select("cols", F.explode("rows").alias("r"))
    return rows.select(*[F.get("r", (F.array_position("cols", n) - 1).cast("int")).alias(n) for n in names])


def geometry_points(spark: SparkSession, path: str) -> DataFrame:
    """name, poly, ring, seq, x, y of a GeoJSON file's polygons and multipolygons; features are read in ranges of the file."""
    features = bigjson.entries(spark, path, "features").select(F.col("value").alias("f"))
    geo = features.select(F.get_json_object("f", "$.properties.name").alias("name"), F.get_json_object("f", "$.geometry.type").alias("kind"), F.get_json_object("f", "$.geometry.coordinates").alias("c"))
    many = F.from_json("c", "array<array<array<array<double>>>>")
    polys = F.when(F.col("kind") == "MultiPolygon", many).otherwise(F.array(F.from_json("c", "array<array<array<double>>>")))
    out = geo.where(F.col("kind").isin("Polygon", "MultiPolygon")).select("name", F.posexplode(polys).alias("poly", "rings"))
    out = out.select("name", "poly", F.posexplode("rings").alias("ring", "points")).select("name", "poly", "ring", F.posexplode("points").alias("seq", "p"))
    return out.select("name", "poly", "ring", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def binary_files(spark: SparkSession, path: str, most: int = FILE_BYTES) -> DataFrame:
    """path, length, content of files up to a size; larger ones are never read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("path", "length", "content")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(rows: DataFrame, path: str, head: str, tail: str, order: list[Column] | None, item: Column, script: bool = False) -> None:
    """One text file: the head, an item of text for each row in this order (None: as they come), with commas between them, the tail; script: "</" is escaped, for
    files that a page loads. The rows are sorted by all tasks and stream through the one that writes; none holds them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead = head, ""  # the last line, which the tail may follow
        for batch in batches:
            values = batch.column(0).to_pylist()
            if script:
                values = [x.replace("</", "<\\/") for x in values]
            out = []
            for x in values:
                if lead:
                    out.append(held)
                    held = lead + x
                else:
                    held, lead = held + x, ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([held + tail], pa.string())], ["value"])

    items = (rows.orderBy(*order) if order else rows).select(item.alias("value")).where("value IS NOT NULL").coalesce(1)
    items.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_script(df: DataFrame, path: str, variable: str, order: list[Column] | None = None) -> None:
    """One text file "variable = [...];" for a page to load; "</" is escaped."""
    write_document(df, path, f"{variable} = [", "];", order, F.to_json(F.struct(*df.columns)), script=True)


def write_csv(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """One CSV file with a header whose first name begins with a byte order mark, as spreadsheet programs want it; its rows in this order,
    sorted by all tasks and streamed through the one that writes."""
    first, *rest = df.columns
    rows = (df.orderBy(*order) if order else df).withColumnRenamed(first, "\ufeff" + first)
    rows.select("\ufeff" + first, *rest).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def point(spark: SparkSession, root: str, folder: str) -> None:
    """Make this folder the published one of a root, at once: readers of current() see the one before or this one, never a part."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    new, kept = at(f".current-{uuid.uuid4().hex}"), at("current")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(folder.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, kept, over)


def current(spark: SparkSession, root: str) -> str | None:
    """The published folder of a root; None before the first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/current")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(f"{root.rstrip('/')}/current", wholetext=True).first()["value"].strip()
