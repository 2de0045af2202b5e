"""Polygons as edge tables, point-in-polygon by ray casting; the nearest edge is in :mod:`wakeflow.functions.nearest`.

An edge table has polygon_id, part_id, x1, y1, x2, y2 (longitude, latitude). Rings of one
part share its id, so that holes cancel by parity; overlapping parts do not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeflow.functions import exprs as X

EDGE_SCHEMA = "polygon_id int, part_id int, x1 double, y1 double, x2 double, y2 double"


def edges_of(spark: SparkSession, polygons: Iterable[list[list[list[tuple[float, float]]]]]) -> DataFrame:
    """Polygons as lists of parts, parts as lists of rings, rings as lists of (x, y)."""
    rows = []
    for i, parts in enumerate(polygons):
        for j, rings in enumerate(parts):
            for ring in rings:
                ring = [*ring, ring[0]] if ring and ring[0] != ring[-1] else ring
                rows += [(i, j, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(ring, ring[1:], strict=False)]
    kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
    names = [f.split(" ")[0] for f in EDGE_SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    # an Arrow table is a local relation: its size is known to the planner
    return spark.createDataFrame(pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names))


def parse_wkt(text: str) -> list[list[list[tuple[float, float]]]]:
    """The parts of a POLYGON or MULTIPOLYGON; ValueError for other geometries."""
    kind = text.strip().split("(")[0].strip().upper()
    if kind not in ("POLYGON", "MULTIPOLYGON"):
        raise ValueError(f"{kind or 'empty'} is not a polygon")
    rings = lambda s: [[tuple(map(float, p.split()[:2])) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", s)]
    body = text[text.index("(") :]
    return [rings(body)] if kind == "POLYGON" else [rings(p) for p in re.findall(r"\((\([^()]+\)(?:\s*,\s*\([^()]+\))*)\)", body)]


def parse_geojson(geometry: dict) -> list[list[list[tuple[float, float]]]]:
    kind = geometry.get("type")
    ring = lambda r: [tuple(p[:2]) for p in r]
    if kind == "Polygon":
        return [[ring(r) for r in geometry["coordinates"]]]
    if kind == "MultiPolygon":
        return [[ring(r) for r in part] for part in geometry["coordinates"]]
    raise ValueError(f"{kind} is not a polygon")


def rectangle(x1: float, y1: float, x2: float, y2: float) -> list[list[list[tuple[float, float]]]]:
    return [[[(x1, y1), (x2, y1), (x2, y2), (x1, y2)]]]


def degrees(x: float, y: float) -> tuple[float, float]:
    """Web Mercator metres as longitude and latitude."""
    return math.degrees(x / X.MERCATOR_M), math.degrees(2 * math.atan(math.exp(y / X.MERCATOR_M)) - math.pi / 2)


def simplified_ring(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The ring without the points that lie within ``tolerance`` of what is left; a ring keeps four points at least."""
    keep, stack = {0, len(ring) - 1, len(ring) // 2}, [(0, len(ring) // 2), (len(ring) // 2, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        (x1, y1), (x2, y2) = ring[a], ring[b]
        dx, dy = x2 - x1, y2 - y1
        best, at = -1.0, None
        for i in range(a + 1, b):
            px, py = ring[i][0] - x1, ring[i][1] - y1
            t = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            off = math.hypot(px - t * dx, py - t * dy)
            if off > best:
                best, at = off, i
        if at is not None and best > tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [ring[i] for i in sorted(keep)] if len(keep) >= 4 else ring


def mark_inside(points: DataFrame, edges: DataFrame, key: list[str] | None = None, cell: float = 0.25, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """``points`` with inside_eez and outside_eez: strictly inside any part (its boundary is outside).

    A point meets the parts whose edges cross its row of the plane, ``cell`` degrees high:
    one row of the edge table's side holds them all as arrays, so no point is shuffled
    where that side is small enough for Spark to broadcast it, nor repeated where not.
    Parts beside the point are passed over by their extent in the row.
    """
    low, high = F.floor(F.least("y1", "y2") / cell).cast("long"), F.floor(F.greatest("y1", "y2") / cell).cast("long")
    parts = edges.withColumn("_row", F.explode(F.sequence(low, high))).groupBy("_row", "polygon_id", "part_id")
    parts = parts.agg(F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    rows = parts.groupBy("_row").agg(F.collect_list(F.struct("west", "east", "edges")).alias("_parts"))
    px, py = F.col(x), F.col(y)

    def crosses(e: Column) -> Column:
        slope = (e["x2"] - e["x1"]) / F.when(e["y1"] != e["y2"], e["y2"] - e["y1"])
        return ((e["y1"] > py) != (e["y2"] > py)) & (px < slope * (py - e["y1"]) + e["x1"])

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        return (cross == 0) & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    def holds(p: Column) -> Column:
        return px.between(p["west"], p["east"]) & (F.size(F.filter(p["edges"], crosses)) % 2 == 1) & ~F.exists(p["edges"], touches)

    out = points.withColumn("_row", F.floor(py / cell).cast("long")).join(rows, "_row", "left")
    out = out.withColumn("inside_eez", F.coalesce(F.exists("_parts", holds), F.lit(False))).drop("_row", "_parts")
    return out.withColumn("outside_eez", ~F.col("inside_eez"))
