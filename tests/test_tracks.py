"""Boundary values of cleaning, segmentation, runs and events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeflow.config import CleaningConfig, EventThresholds, SegmentConfig
from wakeflow.operators import clean, events, segment

T0 = datetime(2024, 1, 1, 0, 0, 0)
COLUMNS = "MMSI long, timestamp timestamp, latitude double, longitude double, speed double, heading double"


def track(spark, rows, mmsi=1):
    """rows: (minutes, speed) or (minutes, speed, latitude, longitude, heading)."""
    full = [(mmsi, T0 + timedelta(minutes=r[0]), *(r[2:4] if len(r) > 2 else (50.0, 5.0)), r[1], r[4] if len(r) > 4 else None) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


def test_clean_limits(spark):
    raw = spark.createDataFrame(
        [
            ("1", "01/02/2024 00:00:00", "90", "-180", "1", ""), ("1", "01/02/2024 00:00:00", "10", "10", "2", "3"), ("1", "02/02/2024 00:00:00", "90.1", "0", "1", "1"),
            ("992000000", "01/02/2024 00:00:00", "1", "1", "1", "1"), ("992999999", "01/02/2024 00:00:00", "1", "1", "1", "1"), ("993000000", "01/02/2024 00:00:00", "1", "1", "x", "NaN"),
            ("2", "never", "1", "1", "1", "1"), ("12.7", "01/02/2024 00:00:00", "1", "1", "1", "1"),
        ],
        "mmsi string, BaseDateTime string, LAT string, LON string, SOG string, COG string",
    )
    std = clean.standardize(raw.coalesce(1))
    rows = {r["MMSI"]: r for r in clean.clean(std).collect()}
    assert set(rows) == {1, 993000000, 12}
    assert rows[1]["latitude"] == 90 and rows[1]["trajectory_date"] == "2024-02-01"
    assert rows[993000000]["speed"] is None and rows[993000000]["heading"] is None
    assert clean.cleaning_stats(std, CleaningConfig()).first().asDict() == {"raw_rows": 8, "cleaned_rows": 3, "invalid_coordinate_rows": 1, "duplicate_timestamp_rows": 1, "vessel_count": 3}
    with pytest.raises(ValueError):
        clean.standardize(raw.drop("LAT"))


def test_segments_anchor_at_first_point(spark):
    points = track(spark, [(7 + i * 3, 1.0) for i in range(10)] + [(7 + 30 + i, 1.0) for i in range(9)])
    rows = segment.segment_points(points, SegmentConfig(window_minutes=(30, 60)))
    got = {(r["window_minutes"], r["number_of_points"]): r["count"] for r in rows.groupBy("window_minutes", "number_of_points").count().collect()}
    assert got == {(30, 10): 10, (60, 19): 19}  # the second half hour has 9 points
    assert rows.filter("window_minutes = 30").first()["segment_id"] == "1_20240101_30min_000000_20240101T000700Z"
    midnight = track(spark, [(1435 + i, 1.0) for i in range(10)])
    assert segment.segments(midnight, SegmentConfig(window_minutes=(30,), min_points=5)).count() == 2


def test_runs_gaps_and_strict_durations(spark):
    t = EventThresholds()
    p = lambda rows: events.prepare_points(track(spark, rows))
    assert events.anchor_events(p([(0, 0.1), (30, 0.1), (60, 0.1)]), t).count() == 0  # exactly 60 minutes
    assert events.anchor_events(p([(0, 0.1), (30, 0.1), (60, 0.1), (61, 0.1)]), t).count() == 1
    assert events.anchor_events(p([(0, 0.1), (30 + 1 / 60, 0.1), (60, 0.1), (61, 0.1)]), t).count() == 0  # gap over 30
    assert events.anchor_events(p([(0, 0.1), (30, None), (60, 0.1), (90, 0.1)]), t).count() == 0  # null splits
    assert events.anchor_events(p([(0, 0.5), (30, 0.5), (61, 0.5)]), t).count() == 0  # not below


def test_runs_equal_a_plain_splitter(spark):
    rng = random.Random(4)
    rows = []
    for v in range(30):
        at = 0
        for _ in range(40):
            at += rng.choice([5, 10, 30, 31, 45])
            rows.append((v, T0 + timedelta(minutes=at), 50.0, 5.0, rng.choice([0.1, 0.4, 0.5, 3.0, None]), None))
    got = {(r["MMSI"], r["s"], r["n"]) for r in events.runs(spark.createDataFrame(rows, COLUMNS), 0.5, 30).groupBy("MMSI", "run_id").agg(F.min("timestamp").alias("s"), F.count("*").alias("n")).collect()}
    want = set()
    for v in range(30):
        run, last = [], None
        for r in [r for r in rows if r[0] == v] + [(v, T0 + timedelta(days=99), 0, 0, 9.0, None)]:
            slow = r[4] is not None and r[4] < 0.5
            if run and (not slow or r[1] - last > timedelta(minutes=30)):
                want.add((v, run[0], len(run)))
                run = []
            if slow:
                run.append(r[1])
            last = r[1]
    assert got == want


def test_loiter_suppressed_by_anchor_and_radius(spark):
    t = EventThresholds()
    slow = [(i * 20, 1.5) for i in range(10)]
    p = events.prepare_points(track(spark, slow))
    assert events.loiter_events(p, events.anchor_events(p, t), t).count() == 1
    q = events.prepare_points(track(spark, slow + [(200 + i * 20, 0.1) for i in range(5)]))
    assert events.loiter_events(q, events.anchor_events(q, t), t).count() == 0
    wide = events.prepare_points(track(spark, [(i * 20, 1.5, 50 + i * 0.01, 5.0) for i in range(10)]))
    assert events.loiter_events(wide, events.anchor_events(wide, t), t).count() == 0


def test_maneuver_coverage(spark):
    spin = lambda step: events.prepare_points(track(spark, [(i * step, 5.0, 50.0, 5.0, (i * 97) % 360.0) for i in range(10)]))
    assert events.maneuver_events(spin(14 / 9)).count() == 0  # 14 of 30 minutes
    assert events.maneuver_events(spin(2.0)).count() == 1


@pytest.mark.parametrize(("hours", "want"), [([0, 8, 16, 24], [4]), ([0, 6, 12, 18, 24], [4, 5]), ([0, 8, 16, 24.1], []), ([0, 1, 2, 2], [4]), ([0, 1, 2, 3, 3], [4]), ([0, 1, 2], [])])
def test_repeated_crossings(spark, hours, want):
    b = spark.createDataFrame([("EEZ entry" if i % 2 else "EEZ exit", T0 + timedelta(hours=h), 1) for i, h in enumerate(hours)], "event_type string, event_timestamp timestamp, mmsi long")
    got = events.repeated_crossings(events.boundary_sequence(b)).orderBy("event_timestamp").collect()
    assert [r["details"]["crossing_count"] for r in got] == want


def test_boundary_names(spark):
    rows = spark.createDataFrame([(" EEZ_Entry ",), ("enter",), ("leave",), ("zone exit",), ("other",)], "event_type string")
    got = [r[0] for r in rows.select(events.normalized_boundary_type(F.col("event_type"))).collect()]
    assert got == ["ENTRY", "ENTRY", "EXIT", "EXIT", None]


def test_empty_inputs(spark):
    none = track(spark, [])
    boundary = spark.createDataFrame([], "event_type string, event_timestamp timestamp, mmsi long")
    assert events.event_sequence(none, boundary).count() == 0
    assert segment.segments(none).count() == 0


def _hot(rng, n=4000, others=100):
    """A vessel with nearly all points over a year, with silences longer than a piece, beside small ones."""
    rows = []
    for mmsi, count in ((1, n), *((m, 10) for m in range(2, 2 + others // 10))):
        at = T0
        for _ in range(count):
            at += timedelta(minutes=rng.choice([1, 7, 12, 31]) if rng.random() < 0.995 else rng.choice([20_000, 45_000]))
            rows.append((mmsi, at, 50 + rng.gauss(0, 0.003), 5 + rng.gauss(0, 0.003), rng.choice([0.1, 0.2, 1.5, None, 8.0]), rng.choice([None, 1.0, 100.0, 200.0])))
    return rows


@pytest.mark.parametrize("minutes", [60, 10_080])
def test_runs_and_flags_in_pieces(spark, minutes):
    """Pieces shorter than gaps, and longer: as one scan of the whole track has it."""
    from wakeflow.operators import pieces

    rng = random.Random(12)
    rows = _hot(rng)
    df = spark.createDataFrame(rows, COLUMNS).withColumn("slow", F.coalesce(F.col("speed") < 0.5, F.lit(False))).withColumn("fast", F.coalesce(F.col("speed") > 1, F.lit(False)))
    got = pieces.runs(df, "MMSI", "timestamp", ["slow", "fast"], 30, minutes, since=F.col("heading").isNotNull())
    got = pieces.previous(got, "MMSI", "timestamp", ["fast", "heading"], "before", minutes)
    want, state = {}, {}
    for m, at, _, _, speed, heading in sorted(rows, key=lambda r: (r[0], r[1])):
        last, slow, fast, i, j, origin, before = state.get(m, (None, False, False, 0, 0, None, None))
        now = (speed is not None and speed < 0.5, speed is not None and speed > 1)
        gap = last is not None and at - last > timedelta(minutes=30)
        i, j = i + (now[0] != slow or gap), j + (now[1] != fast or gap)
        origin = origin or (at if heading is not None else None)
        want[m, at] = (i, j, before)
        state[m] = (at, *now, i, j, origin, (now[1], heading))
    rows = got.collect()
    assert {(r["MMSI"], r["timestamp"].replace(tzinfo=T0.tzinfo)): (r["run_slow"], r["run_fast"], tuple(r["before"]) if r["before"] else None) for r in rows} == want
    assert {(r["MMSI"], r["origin"].replace(tzinfo=T0.tzinfo)) for r in rows} == {(m, s[5]) for m, s in state.items()}


def test_a_hot_vessel_is_spread_over_tasks(spark, monkeypatch):
    """With 97 % of the points in one vessel, the largest partition of the scan holds a small share."""
    from wakeflow.operators import pieces

    rows = spark.createDataFrame(_hot(random.Random(1)), COLUMNS).withColumn("slow", F.coalesce(F.col("speed") < 0.5, F.lit(False)))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in pieces.runs(rows, "MMSI", "timestamp", ["slow"], 30, 600).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 3 * sum(sizes) / 16


@pytest.mark.parametrize("minutes", [60, 10_080])
def test_nearest_points_over_empty_pieces(spark, minutes):
    """The last point before and the first after come from pieces far away too; ties in a second and between both sides."""
    from wakeflow.operators import analytics

    rng = random.Random(7)
    points = [(m, T0 + timedelta(seconds=rng.choice([5, 5000, 400_000]) * rng.randrange(40), microseconds=rng.choice([0, 1, 500_000])), rng.random(), rng.random()) for m in (1, 1, 1, 2) for _ in range(30)]
    points = list({(p[0], p[1]): p for p in points}.values())
    events_ = [(i, rng.choice([1, 1, 2, 3]), T0 + timedelta(seconds=rng.choice([5, 2500, 200_000]) * rng.randrange(-5, 90))) for i in range(150)]
    got = analytics.nearest_points(spark.createDataFrame(events_, "event_id long, mmsi long, event_timestamp timestamp"), spark.createDataFrame(points, "MMSI long, timestamp timestamp, latitude double, longitude double"), minutes=minutes)
    sec = lambda t: int((t - T0).total_seconds() // 1)
    want = {}
    for i, m, at in events_:
        near = sorted((abs(sec(p[1]) - sec(at)), sec(p[1]), p[1], p[2]) for p in points if p[0] == m)
        want[i] = near[0][2:] if near else (None, None)
    assert {r["event_id"]: (r["point_timestamp"] and r["point_timestamp"].replace(tzinfo=T0.tzinfo), r["latitude"]) for r in got.collect()} == want
