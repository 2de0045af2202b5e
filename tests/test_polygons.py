"""Polygon files of holes, islands and many records against a plain reading of the same shapes."""

import json
import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeflow.functions import geometry, nearest
from wakeflow.operators import geofence
from wakeflow.plans import shapes
from wakeflow.sources import polygons, readers


def clockwise(ring, yes=True):
    return ring if (polygons.signed_area(ring) < 0) == yes else ring[::-1]


def shapefile(path, records, index=True):
    """Records of parts of rings, as .shp and .shx: outsides clockwise, holes not; all rings of a record in one list."""
    body, entries = b"", b""
    for number, parts in enumerate(records):
        rings = [[*r, r[0]] for part in parts for r in [clockwise(part[0]), *[clockwise(h, False) for h in part[1:]]]]
        random.Random(number).shuffle(rings)
        points = [p for r in rings for p in r]
        first = [sum(map(len, rings[:i])) for i in range(len(rings))]
        x, y = zip(*points, strict=True)
        data = struct.pack("<i4d2i", 5, min(x), min(y), max(x), max(y), len(rings), len(points)) + struct.pack(f"<{len(first)}i", *first) + struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
        entries += struct.pack(">2i", (100 + len(body)) // 2, len(data) // 2)
        body += struct.pack(">2i", number + 1, len(data) // 2) + data
    path.write_bytes(bytes(100) + body)
    if index:
        path.with_suffix(".shx").write_bytes(bytes(100) + entries)


def sides(edges):
    """Edges without direction, by polygon and the set of its parts."""
    out = {}
    for r in edges.collect():
        out.setdefault(r["polygon_id"], {}).setdefault(r["part_id"], set()).add(frozenset([(r["x1"], r["y1"]), (r["x2"], r["y2"])]))
    return {k: sorted(map(lambda s: sorted(map(sorted, s)), v.values())) for k, v in out.items()}


@pytest.fixture(scope="module")
def many():
    rng = random.Random(6)
    out = list(shapes.ZONES)
    for _ in range(150):
        x, y = rng.uniform(-170, 170), rng.uniform(-70, 70)
        hole = [shapes.star(x, y, rng.randint(3, 6), 0.3, 0.2, rng.random())] if rng.random() < 0.5 else []
        island = [[shapes.star(x, y, 3, 0.1, 0.05, 0.5)], [shapes.star(x + 3, y, 5, 0.4, 0.2, 0.1)]] if hole else []
        out.append([[shapes.star(x, y, rng.randint(5, 40), 1.0, 0.8, rng.random()), *hole], *island])
    return out


@pytest.mark.parametrize("index", [True, False])
def test_shapefile_in_runs(spark, tmp_path, many, index):
    shapefile(tmp_path / "z.shp", many, index)
    rows = polygons.read_shapes(spark, str(tmp_path / "z.shp"), run_bytes=5000)
    assert rows.rdd.getNumPartitions() > 10
    want = sides(geometry.edges_of(spark, many))
    assert sides(rows) == want and len(want) == len(many)


def test_a_box_is_pushed_to_the_records(spark, tmp_path, many):
    shapefile(tmp_path / "z.shp", many)
    box = (8.0, 53.0, 12.0, 56.0)
    got = {r["polygon_id"] for r in polygons.read_shapes(spark, str(tmp_path / "z.shp"), box=box).select("polygon_id").distinct().collect()}
    extents = {i: [f(p[k] for part in parts for ring in part for p in ring) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1))] for i, parts in enumerate(many)}
    want = {i for i, (a, b, c, d) in extents.items() if a <= box[2] and c >= box[0] and b <= box[3] and d >= box[1]}
    assert got == want and {0, 1, 2} <= got and len(got) < 20
    reader = polygons.FilteringReader({"path": str(tmp_path / "z.shp")})
    list(reader.pushFilters([polygons.LessThanOrEqual(("west",), 12.0), polygons.GreaterThan(("east",), 8.0)]))
    read = sum(1 for p in reader.partitions() for _ in reader.read(p))
    assert read == sum(a <= 12 and c >= 8 for a, _, c, _ in extents.values()) < len(many)
    spark.conf.set(polygons.PUSHDOWN, "true")
    try:
        rows = polygons.read_shapes(spark, str(tmp_path / "z.shp")).filter("west <= 12 and east > 8 and north > 53 and south < 56")
        assert {r["polygon_id"] for r in rows.select("polygon_id").distinct().collect()} == want
    finally:
        spark.conf.unset(polygons.PUSHDOWN)


def test_files_of_three_kinds_agree(spark, tmp_path, many):
    some = many[:20]
    closed = lambda part: [[list(p) for p in [*r, r[0]]] for r in part]
    (tmp_path / "z.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [closed(p) for p in parts]} if len(parts) > 1 else {"type": "Polygon", "coordinates": closed(parts[0])}} for parts in some]}))
    ring = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")"
    (tmp_path / "z.wkt").write_text("\n".join("MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(ring, part)) + ")" for part in parts) + ")" for parts in some))
    shapefile(tmp_path / "z.shp", some)
    tables = [sides(readers.read_polygons(spark, str(tmp_path / f))) for f in ("z.geojson", "z.wkt", "z.shp")]
    assert tables[0] == tables[1] == tables[2] == sides(geometry.edges_of(spark, some))


def test_nested_rings():
    square = lambda x, y, r: [(x - r, y - r), (x - r, y + r), (x + r, y + r), (x + r, y - r)]  # noqa: E731  clockwise
    outer, inner, island, hole, stray = square(0, 0, 10), square(0, 0, 5)[::-1], square(0, 0, 3), square(0, 0, 1)[::-1], square(50, 0, 1)[::-1]
    assert polygons.nested([hole, island, stray, inner, outer]) == [[island, hole], [outer, inner], [stray]]


def test_points_on_irregular_zones(spark):
    """Inside flags and nearest edges of random places by plain loops, with a tree of small leaves."""
    rng = random.Random(3)
    at = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), rng.uniform(53.5, 56), rng.uniform(8, 12)) for i in range(400)] + [(900, datetime(2024, 1, 1), 10.0, -150.0), (901, datetime(2024, 1, 1), -80.0, 179.0)]
    edges = geometry.edges_of(spark, shapes.ZONES)
    points = spark.createDataFrame(at, "MMSI long, timestamp timestamp, latitude double, longitude double")
    got = {r["MMSI"]: r["inside_eez"] for r in geofence.classify(points, edges).collect()}

    def inside(x, y):
        odd = lambda part: sum((b[1] > y) != (a[1] > y) and x < (b[0] - a[0]) / (b[1] - a[1]) * (y - a[1]) + a[0] for r in part for a, b in zip(r, [*r[1:], r[0]], strict=True)) % 2 == 1
        return any(odd(part) for parts in shapes.ZONES for part in parts)

    assert got == {i: inside(x, y) for i, _, y, x in at} and 20 < sum(got.values()) < 380
    one = {c: {r["MMSI"]: r["distance_to_boundary"] for r in nearest.distance_km(points, edges, "MMSI", "longitude", "latitude", c).collect()} for c in (1, 5, 10_000)}
    assert one[1] == one[5] == one[10_000] and len(one[1]) == len(at) and None not in one[1].values()
    tree, leaves = nearest.quad_tree(edges, 5)
    assert leaves.count() == edges.count() and leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 5 and len(tree.key) > 20
    none = nearest.distance_km(points, edges.limit(0), "MMSI", "longitude", "latitude").collect()
    assert len(none) == len(at) and {r["distance_to_boundary"] for r in none} == {None}
