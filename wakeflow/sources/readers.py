"""Sources: position files, zipped files, boundary events, event envelopes, labels, polygons."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Sequence
from glob import glob
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeflow.operators.geofence import BOUNDARY_SCHEMA
from wakeflow.sources.polygons import read_polygons

FISHING_SCHEMA = "segment_id string"


def resolve(patterns: Sequence[str]) -> list[str]:
    """Sorted distinct local paths; a pattern without a match stays as it is (a store's path is for Spark to expand)."""
    return sorted({p for pattern in patterns for p in (glob(pattern) or [pattern])})


def read_csv_files(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """All files as text columns, united by name; ``_order`` keeps file and row order.

    Files of one header are one scan, so the plan has as many as there are headers.
    Headers are read by one job of a line a file.
    """
    paths = resolve(patterns)
    if not paths:
        raise ValueError("no files given")
    name = F.input_file_name()
    if len(paths) == 1:
        groups = {"": paths}
    else:
        first = spark.read.text(paths).select(name.alias("file"), "value", F.monotonically_increasing_id().alias("i")).groupBy("file").agg(F.min_by("value", "i").alias("header"))
        groups = {}
        for r in first.orderBy("file").collect():  # a row a file
            groups.setdefault(r["header"], []).append(r["file"])
        if len(groups) <= 1:
            groups = {"": paths}
    out = None
    for own in groups.values():
        part = spark.read.csv(own, header=True, inferSchema=False)
        part = part.withColumn("_order", F.struct(name.alias("file"), F.monotonically_increasing_id().alias("row")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_points(spark: SparkSession, path: str, columns: Sequence[str] | None = None, vessels: Sequence[int] | None = None, date: str | None = None) -> DataFrame:
    """Cleaned points from Parquet or CSV; columns, vessels and date reach the Parquet scan."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
    elif path.endswith((".csv", ".csv.gz")):
        rows = spark.read.csv(path, header=True)
    else:
        raise ValueError(f"{path}: only .parquet and .csv are read")
    if vessels is not None:
        rows = rows.filter(F.col("MMSI").isin(*vessels))
    if date is not None:
        rows = rows.filter(F.col("trajectory_date") == date)
    return rows.select(*columns) if columns else rows


def vessel_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_points(spark, path, ["MMSI"]).distinct()


def trajectory_dates(spark: SparkSession, path: str) -> DataFrame:
    """Distinct dates in order, from the time where the column is missing."""
    rows = read_points(spark, path)
    date = F.col("trajectory_date") if "trajectory_date" in rows.columns else F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd")
    return rows.select(date.alias("trajectory_date")).distinct().orderBy("trajectory_date")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_boundary_events(spark: SparkSession, path: str | None) -> DataFrame:
    """Zone entries and exits; a missing file is an empty table."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], BOUNDARY_SCHEMA)
    rows = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return rows.select("event_type", F.col("event_timestamp").cast("timestamp").alias("event_timestamp"), F.col("mmsi").cast("long").alias("mmsi"))


def read_envelope(spark: SparkSession, path: str, field: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """The records of one array field of a JSON document, or of a directory of JSON lines."""
    if not exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        return spark.read.schema(f"{field} array<struct<{_as_struct(schema)}>>").json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")
    return spark.read.schema(schema).json(path)


def _as_struct(schema: str) -> str:
    """'a long, b struct<...>' as 'a:long,b:struct<...>'."""
    return ",".join(":".join(f.strip().split(" ", 1)) for f in schema.split(", "))


def read_fishing_labels(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], FISHING_SCHEMA)
    return read_points(spark, path)


def read_effort(spark: SparkSession, path: str) -> DataFrame:
    return read_points(spark, path)


def stage(source: str, raw_dir: str, max_rows: int | None = None, replace: bool = False) -> list[str]:
    """Copies CSV files of a file, ZIP or folder into raw_dir (a member as {zip}_{member}), at most max_rows records each. Of equal names the later ones are told by their folders."""
    src, out = Path(source), Path(raw_dir)
    if not src.exists():
        raise FileNotFoundError(source)
    out.mkdir(parents=True, exist_ok=True)
    staged: list[str] = []

    def put(lines, name: str, place: Path) -> None:
        target = out / name
        if str(target) in staged:
            target = out / "_".join([*place.relative_to(src).parent.parts, name])
        if target.exists() and not replace:
            staged.append(str(target))
            return
        with target.open("wb") as f:
            records, quoted = 0, False  # a record goes on while a quote is open
            for line in lines:
                if max_rows is not None and records > max_rows:  # the header and max_rows records
                    break
                f.write(line)
                quoted ^= line.count(b'"') % 2 == 1
                records += not quoted
        staged.append(str(target))

    for path in sorted(p for p in (src.rglob("*") if src.is_dir() else [src]) if p.suffix.lower() in (".csv", ".zip")):
        if path.suffix.lower() == ".csv":
            with path.open("rb") as f:
                put(f, path.name, path)
        else:
            with zipfile.ZipFile(path) as z:
                for member in sorted(z.namelist()):
                    if member.lower().endswith(".csv"):
                        with z.open(member) as f:
                            put(f, f"{path.stem}_{Path(member).name}", path)
    return staged


def evaluation_inputs(spark: SparkSession, folder: str, event_schema: str, situation_schema: str) -> dict[str, DataFrame]:
    """The tables of an evaluation by name: points, segments, events, features, labels, situations.

    A file is sought under its plain name, else under one that ends in it, the first by
    name. FileNotFoundError names a missing one; situations are never made up.
    """
    # File names of the stages' outputs.
    names = {"points": "cleaned_ais.parquet", "segments": "segments.parquet", "events": "event_sequence.json", "features": "features.parquet", "labels": "situation_labels.parquet", "situations": "reasoned_situations.json"}
    out = {}
    for table, name in names.items():
        path = f"{folder}/{name}"
        if not exists(spark, path):
            path = next(iter(sorted(glob(f"{folder}/*_{name}"))), None)
        if path is None:
            raise FileNotFoundError(f"{folder}/{name}, or *_{name}")
        schema = {"events": event_schema, "situations": situation_schema}.get(table)
        out[table] = read_envelope(spark, path, table, schema, missing_ok=False) if schema else spark.read.parquet(path)
    return out


def read_metrics(path: str) -> dict:
    """A metrics file, as :func:`wakeflow.sources.sinks.write_metrics` writes it."""
    return json.loads(Path(path).read_text())


def near(edges: DataFrame, box: tuple[float, float, float, float], pad: float = 0.5) -> DataFrame:
    """The edges of polygons whose extent meets the padded box (x1, y1, x2, y2)."""
    extent = edges.groupBy("polygon_id").agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    hit = extent.filter((F.col("a") <= box[2] + pad) & (F.col("c") >= box[0] - pad) & (F.col("b") <= box[3] + pad) & (F.col("d") >= box[1] - pad))
    return edges.join(hit, "polygon_id", "left_semi")
