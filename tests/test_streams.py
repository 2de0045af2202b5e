"""Streams of shuffled positions against the batch path, and the file source and sink over failures."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeflow.config import EventThresholds
from wakeflow.operators import events, geofence
from wakeflow.streaming import files, tracks

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "MMSI long, timestamp timestamp, latitude double, longitude double, speed double, heading double, inside_eez boolean"
#: the last word of a stream: its time lets the watermark pass all others, and it makes no event
END = (999, T0 + timedelta(days=60), 0.0, 0.0, 20.0, None, None)


@pytest.fixture
def rocks(spark):
    key, value = tracks.STATE_PROVIDER
    spark.conf.set(key, value)
    yield spark
    spark.conf.unset(key)


def voyage(rng, mmsi, n, zones=True):
    """A track of slow and fast stretches, silences, turns and zone changes; times are distinct."""
    at, lat, lon, out, inside = T0 + timedelta(seconds=rng.randrange(5000)), rng.uniform(-60, 60), rng.uniform(-170, 170), [], False
    while len(out) < n:
        slow, speed, turning = rng.random() < 0.6, rng.choice([0.2, 0.4, 1.0, 1.7, 9.0]), rng.random() < 0.5
        for _ in range(rng.randint(1, 25)):
            at += timedelta(seconds=rng.choice([60, 200, 400, 900]) if rng.random() < 0.97 else rng.choice([1800, 1801, 9000]))
            lat, lon = lat + rng.gauss(0, 0.002 if slow else 0.03), lon + rng.gauss(0, 0.002 if slow else 0.03)
            inside = inside if rng.random() < 0.85 or not zones else not inside
            out.append((mmsi, at, lat, lon, rng.choice([None, speed]) if rng.random() < 0.05 else speed + rng.random() / 10, None if rng.random() < 0.1 else rng.uniform(0, 360) if turning else 90.0, inside if zones else None))
    return out[:n]


def shuffled(rng, rows, minutes, parts):
    """The rows in an order that disagrees with their times by less than ``minutes``, in parts."""
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, minutes)))
    cuts = sorted(rng.sample(range(1, len(order)), parts - 1))
    return [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)]


def fed(spark, folder, parts, schema=SCHEMA):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def run(spark, found, folder):
    files.write_stream(found, str(folder / "out"), str(folder / "state")).awaitTermination()
    return files.read_written(spark, str(folder / "out"), tracks.FOUND)


def plain(df):
    rounded = lambda v: round(v, 7) if isinstance(v, float) else tuple(map(rounded, v)) if isinstance(v, tuple) else v
    return sorted((rounded(tuple(r)) for r in df.collect()), key=repr)


THRESHOLDS = EventThresholds(repeated_crossing_count=2, maneuver_window_minutes=60, maneuver_min_points=3, maneuver_min_point_coverage_ratio=0.3, maneuver_heading_circular_variance_threshold=0.3)


@pytest.mark.parametrize(("seed", "minutes", "parts"), [(1, 50, 4), (3, 300, 2)])
def test_events_of_a_shuffled_stream_equal_the_batch(rocks, tmp_path, seed, minutes, parts):
    rng = random.Random(seed)
    rows = [r for m in range(1, 6) for r in voyage(rng, m, 250)]
    points = rocks.createDataFrame(rows, SCHEMA)
    want = events.event_sequence(points.drop("inside_eez"), geofence.transitions(points), THRESHOLDS)
    double = [(*r[:2], 0.0, 0.0, 0.1, 1.0, True) for r in rng.sample(rows, 9)]  # times that stand twice: the first that comes counts
    order = shuffled(rng, rows, minutes, parts)
    order[-1] = [*order[-1], *[d for d in double if d[1] >= max(r[1] for p in order for r in p) - timedelta(minutes=300)], END]
    found = run(rocks, tracks.found_stream(fed(rocks, tmp_path / "in", order), "320 minutes", THRESHOLDS), tmp_path)
    assert tracks.late(found).count() == 0
    got, want = plain(tracks.as_events(found, THRESHOLDS)), plain(want)
    assert got == want
    assert {r[0] for r in want} == {"ANCHOR", "LOITER", "MANEUVERING", "ENTRY", "EXIT", "REPEATED_CROSSING"}


def test_points_after_the_watermark_are_given_out(rocks, tmp_path):
    rng = random.Random(9)
    rows = voyage(rng, 1, 200)
    old = [rows[3], rows[50]]
    rest = [r for r in rows if r not in old]
    parts = [rest[:120], rest[120:190], [*old, *rest[190:]], [END]]
    found = run(rocks, tracks.found_stream(fed(rocks, tmp_path / "in", parts), "10 minutes", THRESHOLDS), tmp_path)
    assert sorted((r["mmsi"], r["event_timestamp"].replace(tzinfo=timezone.utc)) for r in tracks.late(found).collect()) == sorted((1, r[1]) for r in old)
    points = rocks.createDataFrame(rest, SCHEMA)
    assert plain(tracks.as_events(found, THRESHOLDS)) == plain(events.event_sequence(points.drop("inside_eez"), geofence.transitions(points), THRESHOLDS))


def test_crossings_of_a_stream_equal_the_batch(rocks, tmp_path):
    """Ties of one instant included."""
    rng = random.Random(4)
    schema = "event_type string, event_timestamp timestamp, mmsi long"
    rows = [(rng.choice(["EEZ entry", "EEZ exit"]), T0 + timedelta(hours=rng.choice([1, 2, 6, 30]) * i // 3), m) for m in (1, 2, 3) for i in range(60)]
    want = events.repeated_crossings(events.boundary_sequence(rocks.createDataFrame(rows, schema)), THRESHOLDS)
    order = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 5)))
    parts = [order[:40], order[40:41], order[41:150], [*order[150:], ("EEZ exit", END[1], 999)]]
    found = run(rocks, tracks.crossing_stream(fed(rocks, tmp_path / "in", parts, schema), "6 hours", THRESHOLDS), tmp_path)
    got = tracks.as_events(found.filter("kind = 'REPEATED_CROSSING'"), THRESHOLDS)
    assert plain(got) == plain(want) and got.count() > 20


def test_hull_keeps_the_farthest_point():
    rng = random.Random(2)
    for _ in range(200):
        points = [(rng.uniform(40, 41), rng.uniform(5, 6)) for _ in range(rng.randint(1, 60))]
        run_ = tracks.Run.of(0, *points[0])
        for p in points:
            run_.add(0, *p, 1.0)
        lat, lon = np.mean([p[0] for p in points]), np.mean([p[1] for p in points])
        assert run_.km() == pytest.approx(max(tracks.haversine(lat, lon, *p) for p in points), abs=1e-9)
        assert len(run_.d["hull"]) <= len(points)


def test_state_stays_small():
    """A vessel that lies in port for a month keeps sums and a hull, no points."""
    rng, track = random.Random(3), tracks.Track(None, EventThresholds(), tracks.ALL)
    for i in range(20_000):
        list(track.point(i * 120_000_000, 50 + rng.gauss(0, 1e-4), 5 + rng.gauss(0, 1e-4), 0.1, 10.0, True))
    assert len(track.d["runs"]["LOITER"]["hull"]) < 60 and len(track.d["anchors"]) == 0


def test_a_failed_batch_is_written_once(rocks, tmp_path):
    """Batches that fail before, in and after their write are run again: each row is there once."""
    rng = random.Random(5)
    rows = voyage(rng, 1, 120) + voyage(rng, 2, 120)
    schema = files.POINTS
    full = [(*r[:6], r[1].strftime("%Y-%m-%d")) for r in rows]
    for i in range(4):
        rocks.createDataFrame(full[i::4], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = files.read_points_stream(rocks, str(tmp_path / "in"), 1)
    out, state, tries = str(tmp_path / "out"), str(tmp_path / "state"), []

    def failing(batch, number):
        tries.append(number)
        if len(tries) == 2:
            raise RuntimeError("before the write")
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        if len(tries) in (3, 5):
            raise RuntimeError("after the write")

    for _ in range(3):
        query = source.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(failing).start()
        with pytest.raises(Exception, match="the write"):
            query.awaitTermination()
    files.write_stream(source, out, state).awaitTermination()
    got = files.read_written(rocks, out, schema)
    assert len(tries) > len(set(tries)) and got.count() == 240 and plain(got) == plain(rocks.createDataFrame(full, schema))


def test_csv_stream_is_cleaned_as_the_batch(spark, tmp_path):
    from wakeflow.operators.clean import clean
    from wakeflow.sources import readers

    folder = tmp_path / "raw.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("MMSI,timestamp,latitude,longitude,speed,heading\n1,01/02/2024 10:00:00,50,5,1.5,10\n2,2024-02-01 10:00:00,95,5,1,1\n3,x,1,1,1,1\n")
    (folder / "b.csv").write_text("MMSI,timestamp,latitude,longitude,speed,heading\n4.0,2024-02-01 11:00:00,1,2,,\n")
    files.write_stream(files.read_points_stream(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = files.read_written(spark, str(tmp_path / "out"), files.POINTS)
    assert plain(got) == plain(clean(readers.read_csv_files(spark, [f"{folder}/*.csv"]))) and got.count() == 2


def test_no_points(rocks, tmp_path):
    found = run(rocks, tracks.found_stream(fed(rocks, tmp_path / "in", [[END]]).filter("MMSI < 999"), "1 minute"), tmp_path)
    assert tracks.as_events(found).count() == 0 and found.filter(F.col("kind") == "LATE").count() == 0
