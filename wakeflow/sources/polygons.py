"""Polygon files as edge tables, read by tasks: shapefiles by record, GeoJSON and WKT by Spark's readers.

A shapefile is a Python data source. Its partitions are runs of records, cut by the offsets
of the .shx index, or of the record headers where there is none; a task seeks to its run
and reads nothing else. A box, and with :data:`PUSHDOWN` any comparison of a record's extent
(west, south, east, north) with a constant, is pushed to it: a record outside is passed over
by the 32 bytes of its header, and its points are never decoded.
A record's rings are parts by their orientation: a clockwise ring is the outside of a part,
any other a hole in the smallest outside around it.

GeoJSON coordinates and WKT lines are parsed where Spark reads them. No file passes
through the driver; of a projection only its name does.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from wakeflow.functions import geometry

#: the setting by which Spark hands filters to Python data sources
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
EXTENT = ("west", "south", "east", "north")
SCHEMA = f"{geometry.EDGE_SCHEMA}, west double, south double, east double, north double"
#: bytes of a file that one task reads
RUN_BYTES = 16 << 20
Ring = list[tuple[float, float]]


def signed_area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _around(ring: Ring, p: tuple[float, float]) -> bool:
    on = False
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) / (y2 - y1) * (p[1] - y1) + x1:
            on = not on
    return on


def nested(rings: list[Ring]) -> list[list[Ring]]:
    """Rings as parts: each clockwise ring with the holes in it; a hole goes to the smallest ring around it, and is a part of its own if there is none."""
    outer = sorted((abs(signed_area(r)), i) for i, r in enumerate(rings) if signed_area(r) < 0)
    parts = {i: [rings[i]] for _, i in sorted(outer, key=lambda x: x[1])}
    for i, ring in enumerate(rings):
        if i not in parts:
            home = next((o for _, o in outer if _around(rings[o], ring[0])), None)
            parts.setdefault(i if home is None else home, []).append(ring)
    return list(parts.values())


class Records(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.run = int(options.get("runBytes", RUN_BYTES))
        self.projected, self.tolerance = options.get("projected") == "true", float(options.get("tolerance", 0))
        self.low, self.high = {}, {}  # bounds of columns of the extent
        if "box" in options:
            x1, y1, x2, y2 = map(float, options["box"].split(","))
            self.low, self.high = {"east": x1, "north": y1}, {"west": x2, "south": y2}

    def partitions(self) -> list[Records]:
        size = os.path.getsize(self.path)
        index = self.path[:-4] + ".shx"
        if os.path.exists(index):
            at = np.fromfile(index, ">i4", offset=100)[::2].astype(np.int64) * 2
        else:
            at, place = [], 100
            with open(self.path, "rb") as f:
                while place + 8 <= size:
                    at.append(place)
                    f.seek(place + 4)
                    place += 8 + struct.unpack(">i", f.read(4))[0] * 2
            at = np.array(at, np.int64)
        if not len(at):
            return []
        first = np.flatnonzero(np.append(True, np.diff((at - at[0]) // self.run) > 0))
        return [Records(int(a), int(b)) for a, b in zip(at[first], [*at[first[1:]], size], strict=True)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        with open(self.path, "rb") as f:
            place = partition.start
            while place + 8 <= partition.end:
                f.seek(place)
                number, words = struct.unpack(">2i", f.read(8))
                place += 8 + 2 * words
                head = f.read(44)
                if len(head) < 44 or struct.unpack("<i", head[:4])[0] not in (5, 15, 25):  # polygons, also with z or m
                    continue
                box = dict(zip(EXTENT, struct.unpack("<4d", head[4:36]), strict=True))
                if self.projected:
                    box = dict(zip(EXTENT, geometry.degrees(box["west"], box["south"]) + geometry.degrees(box["east"], box["north"]), strict=True))
                if any(box[c] < v for c, v in self.low.items()) or any(box[c] > v for c, v in self.high.items()):
                    continue
                n_parts, n_points = struct.unpack("<2i", head[36:44])
                body = f.read(4 * n_parts + 16 * n_points)
                first = [*np.frombuffer(body, "<i4", n_parts).tolist(), n_points]
                xy = list(map(tuple, np.frombuffer(body, "<f8", 2 * n_points, 4 * n_parts).reshape(-1, 2).tolist()))
                rings = [xy[a:b] for a, b in zip(first, first[1:], strict=False)]
                rows = [(number - 1, j, *e) for j, part in enumerate(nested([r for r in rings if r])) for ring in part for e in _sides(prepared(ring, self.projected, self.tolerance))]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], *[pa.array([v] * len(rows), pa.float64()) for v in box.values()]], names)


class FilteringReader(ShapeReader):
    """With filters that Spark hands over."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in EXTENT:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(f.value, self.low.get(name, f.value))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high[name] = min(f.value, self.high.get(name, f.value))
            yield f  # Spark still has the last word, on < and on <=


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wakeflow_shapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapeReader:
        return (FilteringReader if self.options.get("push") == "true" else ShapeReader)(self.options)


def prepared(ring: Ring, projected: bool, tolerance: float) -> Ring:
    """The ring in degrees, closed, and simplified if ``tolerance`` is not 0."""
    ring = [geometry.degrees(*p) if projected else (p[0], p[1]) for p in ring]
    ring = ring if not ring or ring[0] == ring[-1] else [*ring, ring[0]]
    return geometry.simplified_ring(ring, tolerance) if tolerance else ring


def _sides(ring: Ring) -> Iterator[tuple[float, float, float, float]]:
    return ((*a, *b) for a, b in zip(ring, ring[1:], strict=False))


def _edges(parts: DataFrame) -> DataFrame:
    """Edge table of polygon_id and ``parts`` (arrays of rings of points)."""
    rings = parts.select("polygon_id", F.posexplode("parts").alias("part_id", "rings")).select("polygon_id", "part_id", F.explode("rings").alias("r"))
    at = lambda i, k: F.get(F.get(F.col("r"), i), F.lit(k))
    sides = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(at(i - 1, 0).alias("x1"), at(i - 1, 1).alias("y1"), at(i, 0).alias("x2"), at(i, 1).alias("y2")))
    return rings.filter(F.size("r") > 1).select(F.col("polygon_id").cast("int").alias("polygon_id"), F.col("part_id").cast("int").alias("part_id"), F.explode(sides).alias("s")).select("polygon_id", "part_id", "s.*")


def _closed(projected: bool, tolerance: float):
    kind = "array<array<array<array<double>>>>"
    return F.udf(lambda parts: None if parts is None else [[[list(p) for p in prepared(ring, projected, tolerance)] for ring in part] for part in parts], kind)


def read_shapes(spark: SparkSession, path: str, tolerance: float = 0.0, box: tuple[float, float, float, float] | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Edges of a shapefile's polygons, with the extent of their record; of a ``box`` (x1, y1, x2, y2 in degrees), those whose extent meets it."""
    spark.dataSource.register(ShapeSource)
    folder = path[:-4] + ".prj"
    name = spark.read.text(folder).limit(1).collect() if _there(spark, folder) else []
    projected = mercator(name[0][0], path, degrees=not name[0][0].strip().upper().startswith(("PROJCS", "PROJCRS"))) if name else False
    rows = spark.read.format("wakeflow_shapes").option("path", path).option("tolerance", tolerance).option("projected", str(projected).lower()).option("runBytes", run_bytes)
    rows = rows.option("push", spark.conf.get(PUSHDOWN, "false"))
    return (rows.option("box", ",".join(map(repr, map(float, box)))) if box else rows).load()


def read_geojson(spark: SparkSession, path: str, tolerance: float = 0.0) -> DataFrame:
    """Edges of the Polygons and MultiPolygons of a FeatureCollection, a Feature or a geometry."""
    shape = "struct<type:string,coordinates:string>"
    schema = f"type string, coordinates string, geometry {shape}, features array<struct<geometry:{shape}>>, crs struct<properties:struct<name:string>>"
    data = spark.read.schema(schema).json(path, multiLine=True)
    name = data.select("crs.properties.name").first()
    projected = mercator(name[0], path, degrees=False) if name and name[0] else False
    one = F.when(F.col("geometry").isNotNull(), F.col("geometry")).otherwise(F.struct("type", "coordinates"))
    shapes = data.select(F.posexplode(F.coalesce(F.transform("features", lambda f: f["geometry"]), F.array(one))).alias("polygon_id", "g"))
    single = F.array(F.from_json("g.coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("g.type") == "Polygon", single).when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", "array<array<array<array<double>>>>"))
    return _edges(shapes.select("polygon_id", _closed(projected, tolerance)(parts).alias("parts")).filter("parts is not null"))


def read_wkt(spark: SparkSession, path: str, tolerance: float = 0.0) -> DataFrame:
    """Edges of the POLYGON and MULTIPOLYGON lines of text files."""
    kind = "array<array<array<array<double>>>>"
    parse = F.udf(lambda s: [[[list(p) for p in prepared(ring, False, tolerance)] for ring in part] for part in geometry.parse_wkt(s)], kind)
    lines = spark.read.text(path).filter(F.upper(F.trim("value")).rlike("^(MULTI)?POLYGON"))
    return _edges(lines.select((F.monotonically_increasing_id() % (1 << 31)).alias("polygon_id"), parse("value").alias("parts")))


def mercator(name: str, path: str, degrees: bool) -> bool:
    """Whether coordinates of a projection of this name are Web Mercator metres and not degrees; ValueError if they are neither."""
    if degrees or "CRS84" in name or ("4326" in name and not name.strip().upper().startswith("PROJ")):
        return False
    if "3857" in name or "Mercator_Auxiliary_Sphere" in name or "Pseudo-Mercator" in name:
        return True
    raise ValueError(f"{path}: coordinates in {name[:60]} are not read, only degrees and Web Mercator")


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_polygons(spark: SparkSession, path: str, tolerance: float = 0.0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Edge table of the polygons of a GeoJSON, WKT (one a line) or shapefile, in degrees, rings simplified to ``tolerance`` degrees; of a shapefile and a ``box``, of the records that meet it.

    ValueError if there are none, or if the file names a projection other than Web Mercator,
    which is turned into degrees.
    """
    if path.endswith((".json", ".geojson")):
        edges = read_geojson(spark, path, tolerance)
    elif path.endswith(".shp"):
        edges = read_shapes(spark, path, tolerance, box).drop(*EXTENT)
    else:
        edges = read_wkt(spark, path, tolerance)
    if box is None and edges.isEmpty():
        raise ValueError(f"{path} holds no polygons")
    return edges
