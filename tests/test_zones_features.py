"""Geometry, transitions, features, labels, fishing and situations."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeflow.config import LabelThresholds
from wakeflow.functions import exprs, geometry, nearest
from wakeflow.operators import analytics, evaluation, features, fishing, geofence, labels, situations
from wakeflow.operators.geofence import BOUNDARY_SCHEMA as BOUNDARY

T0 = datetime(2024, 1, 1)
HOLED = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"


def places(spark, xy):
    return spark.createDataFrame([(1, T0 + timedelta(minutes=i), float(y), float(x), 1.0, None) for i, (x, y) in enumerate(xy)], "MMSI long, timestamp timestamp, latitude double, longitude double, speed double, heading double")


def test_inside(spark):
    edges = geometry.edges_of(spark, [geometry.parse_wkt(HOLED), geometry.rectangle(3, 3, 6, 6)])
    xy = [(0.5, 0.5), (1.5, 1.5), (0, 2), (4, 1), (3.5, 3.5), (5, 5), (7, 1), (1, 1.5), (4, 3.5)]
    got = [r["inside_eez"] for r in geofence.classify(places(spark, xy), edges).orderBy("timestamp").collect()]
    assert got == [True, False, False, False, True, True, False, False, True]
    assert geometry.parse_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.2 5.1, 5.4 5.1, 5.4 5.2, 5.2 5.1)))")[1][1][0] == (5.2, 5.1)
    with pytest.raises(ValueError):
        geometry.parse_wkt("POINT (1 1)")


def test_transitions_and_carried_state(spark):
    edges = geometry.edges_of(spark, [geometry.rectangle(0, 0, 1, 1), geometry.rectangle(1, 0, 2, 1)])
    points = geofence.classify(places(spark, [(0.5, 0.5), (1.5, 0.5), (3, 0.5), (3, 0.6), (0.5, 0.5)]), edges)
    whole = [tuple(r) for r in geofence.transitions(points).orderBy("event_timestamp").collect()]
    assert [w[0] for w in whole] == ["EEZ exit", "EEZ entry"]  # zone to zone: nothing; first point: nothing
    states, parts = spark.createDataFrame([], "mmsi long, inside boolean"), []
    for lo, hi in ((0, 2), (2, 4), (4, 5)):
        batch = points.filter((F.col("timestamp") >= T0 + timedelta(minutes=lo)) & (F.col("timestamp") < T0 + timedelta(minutes=hi)))
        found, states = geofence.transitions_with_state(batch, states)
        parts += [tuple(r) for r in found.orderBy("event_timestamp").collect()]
    assert parts == whole


def test_stream_equals_batch(spark, tmp_path):
    from wakeflow.streaming.boundary import boundary_stream

    edges = geometry.edges_of(spark, [geometry.rectangle(0, 0, 1, 1)])
    points = geofence.classify(places(spark, [(0.5, 0.5), (3, 0.5), (3, 0.6), (0.5, 0.5), (0.6, 0.5), (4, 4)]), edges).select("MMSI", "timestamp", "inside_eez")
    source = tmp_path / "in"
    for i in range(3):
        points.filter(F.minute("timestamp").between(2 * i, 2 * i + 1)).coalesce(1).write.mode("append").parquet(str(source))
    stream = boundary_stream(spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("crossed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, geofence.transitions(points).collect()))
    assert sorted(map(tuple, spark.table("crossed").collect())) == want and len(want) == 3


def test_silent_vessels_are_forgotten(spark, tmp_path):
    """Another vessel's batch, after the silence, clears the state; the next point is a first one."""
    import time

    from wakeflow.streaming import files
    from wakeflow.streaming.boundary import boundary_stream

    schema, source = "MMSI long, timestamp timestamp, inside_eez boolean", tmp_path / "in"
    for forget, found in ((0.02, 0), (60.0, 1)):
        query = None
        for i, (mmsi, inside) in enumerate([(1, True), (2, True), (1, False)]):
            spark.createDataFrame([(mmsi, T0 + timedelta(minutes=i), inside)], schema).coalesce(1).write.mode("append").parquet(f"{source}{forget}")
            if query is None:  # with a clock's timeout batches never end: the query is watched
                stream = boundary_stream(spark.readStream.schema(schema).parquet(f"{source}{forget}"), forget_minutes=forget)
                query = files.write_stream(stream, str(tmp_path / f"out{forget}"), str(tmp_path / f"state{forget}"), processingTime="500 milliseconds")
            seen, until = i, time.monotonic() + 60
            while seen <= i and time.monotonic() < until:
                time.sleep(0.3)
                seen = sum(p["numInputRows"] for p in query.recentProgress)
            time.sleep(3)
        query.stop()
        assert seen == 3 and files.read_written(spark, str(tmp_path / f"out{forget}"), BOUNDARY).count() == found


def test_motion_features(spark):
    rows = [("a", 1, T0, 50.0, 5.0, 2.0, 350.0), ("a", 1, T0 + timedelta(minutes=6), 50.0, 5.1, 4.0, 10.0), ("b", 1, T0, 50.0, 5.0, None, 0.0), ("b", 1, T0 + timedelta(minutes=1), 50.0, 5.0, None, 511.0), ("c", 1, T0, 50.0, 5.0, 1.0, None)]
    got = {r["segment_id"]: r for r in features.motion_features(spark.createDataFrame(rows, "segment_id string, MMSI long, timestamp timestamp, latitude double, longitude double, speed double, heading double")).collect()}
    assert got["a"]["mean_heading_change"] == 20 and got["b"]["mean_heading_change"] == -151
    assert got["a"]["avg_speed"] == 3 and got["a"]["speed_variance"] == pytest.approx(1)
    assert got["b"]["avg_speed"] is None and got["a"]["window_minutes"] == 2
    assert (got["c"]["path_length"], got["c"]["trajectory_curvature"], got["c"]["heading_variance"], got["c"]["mean_heading_change"], got["c"]["loop_count"]) == (0, 0, None, None, 0)
    silent = spark.createDataFrame([(s, 1, T0 + timedelta(hours=i), 50.0, 5.0 + i, None, 0.0) for s in "xy" for i in (0, 1)], "segment_id string, MMSI long, timestamp timestamp, latitude double, longitude double, speed double, heading double")
    r = features.motion_features(silent).first()
    assert r["avg_speed"] == pytest.approx(r["path_length"] / 1.852) and r["speed_variance"] == 0


def test_crossings_and_overlaps(spark):
    seg = spark.createDataFrame([("s", 1, T0, T0 + timedelta(hours=50))], "segment_id string, mmsi long, segment_start timestamp, segment_end timestamp")
    b = spark.createDataFrame([("EEZ entry", T0 + timedelta(hours=h), 1) for h in (-1, 0, 25, 50, 51)], "event_type string, event_timestamp timestamp, mmsi long")
    assert features.crossing_counts(seg, b).first()["crossing_count"] == 3
    e = spark.createDataFrame([("ANCHOR", 1, T0 - timedelta(hours=1), T0 + timedelta(hours=30)), ("LOITER", 1, T0 + timedelta(hours=50), T0 + timedelta(hours=60)), ("ENTRY", 1, T0, T0)], "event_type string, mmsi long, start_timestamp timestamp, end_timestamp timestamp")
    r = features.event_overlap_minutes(seg, e).first()
    assert (r["anchor_duration"], r["loiter_duration"]) == (1800, 0)


def _features(spark, **values):
    base = dict(segment_id="s", mmsi=1, segment_start=T0, segment_end=T0 + timedelta(hours=1), avg_speed=0.0, speed_variance=0.0, trajectory_curvature=1.0, crossing_count=0, distance_to_boundary=None, anchor_duration=0.0, loiter_duration=0.0) | values
    return spark.createDataFrame([tuple(base.values())], "segment_id string, mmsi long, segment_start timestamp, segment_end timestamp, avg_speed double, speed_variance double, trajectory_curvature double, crossing_count long, distance_to_boundary double, anchor_duration double, loiter_duration double")


@pytest.mark.parametrize(("values", "label"), [({"crossing_count": 2, "anchor_duration": 20.0}, "Anchorage"), ({"loiter_duration": 20.0}, "Prolonged Boundary Presence"), ({"loiter_duration": 20.0, "distance_to_boundary": 6.0}, "Unknown"), ({"avg_speed": 5.0}, "Transit"), ({"crossing_count": 2}, "Boundary Crossing"), ({}, "Unknown")])
def test_labels(spark, values, label):
    assert labels.situation_labels(_features(spark, **values)).first()["situation_label"] == label


def test_label_ties_take_the_earlier_rule(spark):
    t = LabelThresholds(anchorage_confidence=0.8, boundary_crossing_confidence=0.8, unknown_confidence=0.99)
    assert labels.situation_labels(_features(spark, crossing_count=2, anchor_duration=20.0), None, t).first()["situation_label"] == "Boundary Crossing"


def test_fishing(spark):
    effort = spark.createDataFrame([("1", "2023-12-31", "0.1"), ("1", "2023-12-30", "12"), ("2", "2023-12-31", "0.09"), ("3", "2023-12-31", "6")], "ssvid string, date string, hours string")
    got = {r["fishing_hours"]: r["label_confidence"] for r in fishing.effort_to_labels(effort).collect()}
    assert got[0.1] == pytest.approx(0.70 + 0.1 / 6 * 0.25) and got[12] == got[6] == 0.95 and 0.09 not in got
    hit = labels.situation_labels(_features(spark, mmsi=1), fishing.effort_to_labels(effort)).first()
    assert hit["situation_label"] == "Fishing"  # the label's end is the segment's start


def _reason(spark, *rows):
    e = spark.createDataFrame([(k, T0 + timedelta(hours=h), 1, T0 + timedelta(hours=h), T0 + timedelta(hours=h), float(m)) for k, h, m in rows], "event_type string, event_timestamp timestamp, mmsi long, start_timestamp timestamp, end_timestamp timestamp, duration_minutes double")
    return [(r["situation"], [x["event_type"] for x in r["supporting_events"]]) for r in situations.ordered(situations.reason(e)).collect()]


def test_situations(spark):
    assert _reason(spark, ("ENTRY", 0, 0), ("ENTRY", 1, 0), ("EXIT", 20, 0)) == [("Boundary Crossing", ["ENTRY", "EXIT"]), ("Boundary Crossing", ["ENTRY", "EXIT"])]
    got = _reason(spark, ("ENTRY", 0, 0), ("LOITER", 1, 0), ("ENTRY", 2, 0), ("EXIT", 30, 0))
    assert ("Prolonged Boundary Presence", ["ENTRY", "LOITER"]) in got
    assert ("Prolonged Boundary Presence", ["ENTRY", "LOITER", "EXIT"]) in _reason(spark, ("ENTRY", 0, 0), ("LOITER", 1, 0), ("EXIT", 30, 0))
    assert ("Transit", ["ENTRY", "EXIT"]) in _reason(spark, ("ENTRY", 0, 0), ("EXIT", 12, 0))
    assert "Transit" not in dict(_reason(spark, ("ENTRY", 0, 0), ("ANCHOR", 1, 60), ("EXIT", 2, 0)))
    assert _reason(spark, ("ANCHOR", 0, 60)) == [("Anchorage", ["ANCHOR"])] and _reason(spark, ("ANCHOR", 0, 59.9)) == []
    assert _reason(spark) == []


def test_asof_takes_the_earlier_point(spark):
    p = places(spark, [(1, 1), (2, 2), (3, 3)])
    e = spark.createDataFrame([(7, 1, T0 + timedelta(seconds=90)), (8, 1, T0 - timedelta(hours=1)), (9, 1, T0 + timedelta(hours=9)), (10, 2, T0)], "event_id long, mmsi long, event_timestamp timestamp")
    got = {r["event_id"]: r["longitude"] for r in analytics.nearest_points(e, p).collect()}
    assert got == {7: 2.0, 8: 1.0, 9: 3.0, 10: None}


def test_splits_and_samples(spark):
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 2).cast("string").alias("label"), (F.col("id") % 20).alias("mmsi"))
    split = {(r["label"], r["split"]): r["count"] for r in analytics.stratified_split(rows, "label", "id").groupBy("label", "split").count().collect()}
    assert split == {(x, s): n for x in "01" for s, n in (("train", 70), ("validation", 15), ("test", 15))}
    v = analytics.vessel_split(rows)
    assert v.filter("split = 'test'").select("mmsi").distinct().count() == 3
    assert v.groupBy("mmsi").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert analytics.sample_groups(rows, "label", "id", 10, capped=["1"]).count() == 110


def test_scalar_expressions(spark):
    r = spark.range(1).select(
        exprs.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"), exprs.iso(F.lit(T0)).alias("a"), exprs.iso(F.lit(T0 + timedelta(microseconds=5))).alias("b"), exprs.human(F.lit(1234567)).alias("h"),
        exprs.clip(F.lit(None).cast("double"), 0.0).alias("n"), exprs.ratio(F.lit(1.0), F.lit(0.0)).alias("z"),
    ).first()
    assert r["km"] == pytest.approx(111.195, abs=1e-3) and r["a"] == "2024-01-01T00:00:00+00:00" and r["b"] == "2024-01-01T00:00:00.000005+00:00"
    assert (r["h"], r["n"], r["z"]) == ("1.2M", None, 0.0)


def test_distance_from_near_and_far(spark):
    """The nearest of many edges, whatever the cell in which it is found."""
    rng = random.Random(2)
    zones = [geometry.rectangle(x, y, x + 0.5, y + 0.3) for x, y in ((rng.uniform(-20, 20), rng.uniform(30, 60)) for _ in range(20))]
    edges = geometry.edges_of(spark, zones)
    at = [(i, rng.uniform(-25, 25), rng.uniform(25, 65)) for i in range(60)] + [(100, 170.0, -40.0), (101, -120.0, 10.0), (102, 0.0, 45.0), (103, None, 1.0)]
    got = {r["k"]: r["distance_to_boundary"] for r in nearest.distance_km(spark.createDataFrame(at, "k long, x double, y double"), edges, "k", "x", "y").collect()}
    mx, my = lambda v: 6378137.0 * math.radians(v), lambda v: 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(v) / 2))

    def far(px, py, e):
        (x1, y1), (x2, y2) = (mx(e[0]), my(e[1])), (mx(e[2]), my(e[3]))
        t = max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1)) / 1000

    sides = [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in edges.collect()]
    assert got.pop(103) is None
    assert got == {k: pytest.approx(min(far(mx(x), my(y), e) for e in sides), rel=1e-9) for k, x, y in at if x is not None}


def test_rules_are_expressions(spark):
    """A rule of one's own beside the others: from the thresholds, a situation or null for each event."""
    rule = lambda t: F.when(F.col("event_type") == "EXIT", situations.situation("Left", 0.5, F.array("as_event"), "out"))
    e = spark.createDataFrame([("EXIT", T0, 1), ("ENTRY", T0 + timedelta(hours=1), 1)], "event_type string, event_timestamp timestamp, mmsi long")
    assert [r["situation"] for r in situations.ordered(situations.reason(e, rules=[*situations.DEFAULT_RULES, rule])).collect()] == ["Left", "Boundary Crossing"]


def test_a_mean_at_the_threshold_meets_it(spark):
    """(5.1 + 6.8 + 3.1) / 3 is 5; as doubles added in this order it is 4.999999999999999."""
    speeds = [5.1, 6.8, 3.1]
    assert (5.1 + 6.8 + 3.1) / 3 < 5
    rows = [("a", 1, T0 + timedelta(hours=i), 55.0, 10.0 + i / 10, v, 90.0) for i, v in enumerate(speeds)]
    moved = features.motion_features(spark.createDataFrame(rows, "segment_id string, MMSI long, timestamp timestamp, latitude double, longitude double, speed double, heading double").coalesce(1))
    f = moved.withColumns({"crossing_count": F.lit(0).cast("long"), "anchor_duration": F.lit(599.9999999999999), "loiter_duration": F.lit(0.0), "distance_to_boundary": F.lit(400.00000000000006)})
    t = LabelThresholds(transit_min_avg_speed=5, anchorage_min_anchor_duration_minutes=600, prolonged_boundary_max_distance_km=400)
    hits = {r["rule"]: r["hits"] for r in evaluation.rule_hits(f, t).collect()}
    assert (hits["avg_speed >= 5"], hits["anchor_duration >= 600"], hits["distance_to_boundary <= 400"]) == (1, 1, 1)
    assert labels.situation_labels(f.withColumn("anchor_duration", F.lit(0.0)), None, t).first()["situation_label"] == "Transit"
