"""Readers, sinks, reports, classifiers, metrics and the command line."""

import json
import struct
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeflow.config import Config, load_config
from wakeflow.operators import analytics, clean, events, ml, reports, situations
from wakeflow.sources import readers, sinks

T0 = datetime(2024, 1, 1)


def test_stage_zip_and_csv(tmp_path):
    src = tmp_path / "src"
    (src / "deep").mkdir(parents=True)
    (src / "deep" / "a.csv").write_text("x\n1\n2\n3\n")
    with zipfile.ZipFile(src / "b.zip", "w") as z:
        z.writestr("c.csv", "x\n4\n5\n")
        z.writestr("note.txt", "no")
    got = readers.stage(str(src), str(tmp_path / "raw"), max_rows=2)
    assert sorted(p.rsplit("/", 1)[1] for p in got) == ["a.csv", "b_c.csv"]
    assert (tmp_path / "raw" / "a.csv").read_text() == "x\n1\n2\n"
    with pytest.raises(FileNotFoundError):
        readers.stage(str(tmp_path / "none"), str(tmp_path / "raw"))


def test_stage_keeps_equal_names_and_counts_records(tmp_path):
    for folder in ("a", "b"):
        (tmp_path / "src" / folder).mkdir(parents=True)
        (tmp_path / "src" / folder / "x.csv").write_text(f'h,t\n1,"{folder}\nmore"\n2,y\n3,z\n')
    got = readers.stage(str(tmp_path / "src"), str(tmp_path / "raw"), max_rows=2)
    assert [p.rsplit("/", 1)[1] for p in got] == ["x.csv", "b_x.csv"]
    assert [open(p).read() for p in got] == [f'h,t\n1,"{x}\nmore"\n2,y\n' for x in "ab"]


def test_projections_and_simplified_rings(spark, tmp_path):
    ring = [[0, 0], [111319.49, 0], [222638.98, 1], [222638.98, 222684.2], [0, 222684.2], [0, 0]]
    shape = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}
    crs = lambda name: {"crs": {"type": "name", "properties": {"name": name}}}
    (tmp_path / "m.geojson").write_text(json.dumps(shape | crs("urn:ogc:def:crs:EPSG::3857")))
    rows = readers.read_polygons(spark, str(tmp_path / "m.geojson")).agg(F.max("x1"), F.max("y1"), F.count("*")).first()
    assert (round(rows[0], 3), round(rows[1], 3), rows[2]) == (2.0, 2.0, 5)
    assert readers.read_polygons(spark, str(tmp_path / "m.geojson"), tolerance=0.005).count() == 4
    (tmp_path / "m.geojson").write_text(json.dumps(shape | crs("urn:ogc:def:crs:EPSG::25832")))
    with pytest.raises(ValueError):
        readers.read_polygons(spark, str(tmp_path / "m.geojson"))


def test_small_tables_are_whole_or_refused(spark, tmp_path):
    df = spark.range(5)
    with pytest.raises(ValueError):
        sinks.write_csv({"t": df}, str(tmp_path / "t.csv"), limit=4)
    with pytest.raises(ValueError):
        sinks.markdown(df, limit=4)
    assert len(sinks.markdown(df, limit=5).splitlines()) == 7


def test_evaluation(spark, tmp_path):
    from wakeflow.operators import evaluation

    names = spark.createDataFrame([("Repeated Crossing",), ("Other",), (None,)], "x string")
    got = [tuple(r) for r in names.select(evaluation.remap("x", evaluation.REASONER_TO_CLASS), evaluation.activity_of("x"), evaluation.situation_of("x")).collect()]
    assert got == [("Boundary Crossing", "Transit", "None"), (None, "Transit", "None"), (None, "Transit", "None")]
    said = spark.createDataFrame([("a", "a"), ("b", "a")], "t string, p string")
    values = sinks.write_evaluation(said, "t", "p", ["a", "b"], str(tmp_path / "m.json"))
    assert readers.read_metrics(str(tmp_path / "m.json")) == values and values["metrics"]["accuracy"] == 0.5 and len(values["classes"]) == len(values["confusion_matrix"]) == 2
    with pytest.raises(FileNotFoundError):
        readers.evaluation_inputs(spark, str(tmp_path), "a long", "a long")


def test_csv_union_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MMSI,LAT\n1,2\n")
    (tmp_path / "b.csv").write_text("LAT,MMSI,more\n3,4,x\n")
    rows = readers.read_csv_files(spark, [str(tmp_path / "*.csv")]).orderBy("_order").collect()
    assert [(r["MMSI"], r["LAT"], r["more"]) for r in rows] == [("1", "2", None), ("4", "3", "x")]
    with pytest.raises(ValueError):
        readers.read_csv_files(spark, [])
    with pytest.raises(ValueError):
        readers.read_points(spark, "points.orc")


def test_missing_boundary_events_are_empty(spark, tmp_path):
    assert readers.read_boundary_events(spark, str(tmp_path / "none.parquet")).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_envelope(spark, str(tmp_path / "none.json"), "events", "a long", missing_ok=False)


def test_polygon_files(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 1, 1, 1, 4, 0) + struct.pack("<8d", *[v for p in ring for v in p])
    (tmp_path / "z.shp").write_bytes(bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body)
    (tmp_path / "z.wkt").write_text("POLYGON ((0 0, 1 0, 1 1, 0 0))\nPOINT (3 3)\n")
    (tmp_path / "z.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}, {"geometry": None}]}))
    tables = [sorted(map(tuple, readers.read_polygons(spark, str(tmp_path / f)).collect())) for f in ("z.shp", "z.wkt", "z.geojson")]
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == 3
    assert readers.near(readers.read_polygons(spark, str(tmp_path / "z.wkt")), (1.2, 1.2, 2, 2)).count() == 3
    assert readers.near(readers.read_polygons(spark, str(tmp_path / "z.wkt")), (3, 3, 4, 4)).count() == 0
    (tmp_path / "p.wkt").write_text("POINT (1 1)")
    with pytest.raises(ValueError):
        readers.read_polygons(spark, str(tmp_path / "p.wkt"))


def _events(spark):
    rows = [("ENTRY", T0, 1, T0, T0, 0.0, None), ("ANCHOR", T0 + timedelta(hours=1), 1, T0 + timedelta(hours=1), T0 + timedelta(hours=3), 120.0, None)]
    return spark.createDataFrame(rows, "event_type string, event_timestamp timestamp, mmsi long, start_timestamp timestamp, end_timestamp timestamp, duration_minutes double, details string").withColumn("details", F.lit(None).cast(events.DETAILS))


def test_envelope_round_trip_and_reports(spark, tmp_path):
    path = str(tmp_path / "e.json")
    assert sinks.write_envelope(_events(spark), path, "event", thresholds={"a": 1}) == 2
    assert json.loads(open(path).read())["event_count"] == 2
    schema = f"event_type string, event_timestamp timestamp, mmsi long, start_timestamp timestamp, end_timestamp timestamp, duration_minutes double, details {events.DETAILS}"
    back = readers.read_envelope(spark, path, "events", schema)
    assert sorted(map(tuple, back.drop("details").collect())) == sorted(map(tuple, _events(spark).drop("details").collect()))
    lines = {r["situation"]: r["report"] for r in reports.report_lines(situations.reason(back)).collect()}
    assert "anchored for 2.0 hours" in lines["Anchorage"] and "n/a knots" in lines["Anchorage"] and "no exit" in lines["Boundary Crossing"]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1.234)], "name string, value double")
    assert sinks.markdown(df).splitlines()[2] == "| a_b | 1.234 |" and r"a\_b & 1.234" in sinks.latex(df, "t")
    sinks.write_csv({"one": df, "two": df}, str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_text().startswith("# one\n")
    table = analytics.comparison_table(spark, [{"name": "prior", "value": None}], df)
    assert [tuple(r) for r in table.collect()] == [("prior", None), ("a_b", 1.23)]
    assert sinks.write_metrics(df, str(tmp_path / "m.json")) == {"name": "a_b", "value": 1.234}


def test_config(tmp_path):
    assert load_config(None) == load_config(str(tmp_path / "none.yaml")) == Config()
    (tmp_path / "c.yaml").write_text("segmentation:\n  window_minutes: [15]\nevent_extraction:\n  max_ais_gap_minutes: 5\n")
    c = load_config(str(tmp_path / "c.yaml"))
    assert c.segmentation.window_minutes == (15,) and c.event_extraction.max_ais_gap_minutes == 5
    (tmp_path / "c.yaml").write_text("event_extraction:\n  unknown: 1\n")
    with pytest.raises(TypeError):
        load_config(str(tmp_path / "c.yaml"))


def test_config_sections_and_keys(tmp_path):
    """A file with every section of the format; the confidences of its reasoner are the defaults'."""
    (tmp_path / "c.yaml").write_text(
        """
input: {ais_csv_paths: [data/*.csv]}
output: {segments_path: segments.parquet}
schema: {required_columns: [MMSI, timestamp, latitude, longitude, speed, heading], column_aliases: {MMSI: [mmsi]}}
cleaning: {latitude_range: [-90, 90], longitude_range: [-180, 180], duplicate_subset: [MMSI, timestamp]}
segmentation: {window_minutes: [30, 60], min_points: 10}
geofencing: {batch_size: 250000}
event_extraction: {anchor_speed_knots: 0.5, max_ais_gap_minutes: 20, maneuver_min_point_coverage_ratio: 0.5, maneuver_heading_circular_variance_threshold: 0.5}
weak_supervision: {transit_max_trajectory_curvature: 2.5, anchorage_min_anchor_duration_minutes: 20.0, boundary_crossing_min_crossings: 2, prolonged_boundary_max_distance_km: 5.0, prolonged_boundary_confidence: 0.85}
gfw: {min_fishing_hours: 0.1}
classifier_training: {test_size: 0.15, validation_size: 0.15, n_jobs: 1}
situation_reasoning: {transit_max_trip_hours: 12.0, repeated_crossing_base_confidence: 0.9, prolonged_presence_confidence: 0.85}
classifier_training: {max_majority_samples: 15000}
"""
    )
    c = load_config(str(tmp_path / "c.yaml"))
    assert c.event_extraction.max_ais_gap_minutes == 20 and c.output == {"segments_path": "segments.parquet"} and c.schema.column_aliases == {"MMSI": ["mmsi"]}
    assert c.situation_reasoning == Config().situation_reasoning and c.weak_supervision == Config().weak_supervision
    (tmp_path / "c.yaml").write_text("events: {anchor_speed_knots: 1}\n")
    with pytest.raises(TypeError):
        load_config(str(tmp_path / "c.yaml"))


def test_files_are_cleaned_in_their_order(spark, tmp_path):
    for name, speed in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.csv").write_text(f"mmsi,time,lat,lon,sog,cog\n1,2024-01-01 00:00:00,1,1,{speed},0\n1,2024-01-01 00:01:00,1,1,{speed},0\n")
    raw = clean.standardize(readers.read_csv_files(spark, [str(tmp_path / "*.csv")]))
    rows = clean.clean(raw).collect()
    assert len(rows) == 2 and {r["speed"] for r in rows} == {1.0} and "_order" not in clean.clean(raw).columns
    assert clean.cleaning_stats(raw).first()["duplicate_timestamp_rows"] == 2


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    m = analytics.overall_metrics(rows, "t", "p", ["a", "b", "c"]).first()
    assert m["accuracy"] == pytest.approx(0.6) and m["macro_f1"] == pytest.approx((0.5 + 0.8 + 0) / 3)
    assert m["cohen_kappa"] == pytest.approx((5 * 3 - (2 * 2 + 2 * 3)) / (25 - 10)) and m["balanced_accuracy"] == pytest.approx(0.5)
    assert analytics.confusion(rows, "t", "p", ["a", "b", "c"]).filter("truth = 'c'").first()["a"] == 1
    assert ml.misclassified(rows.select(F.col("t").alias("label"), F.col("p").alias("predicted"))).count() == 2


def test_classifiers(spark):
    rows = spark.range(120).select(F.col("id").cast("string").alias("segment_id"), F.col("id").alias("mmsi"), *[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(ml.FEATURES)], F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("label"))
    forest = ml.fit(rows, trees=10, depth=5)
    out = ml.predict(forest, rows)
    assert out.filter("label = predicted").count() > 110 and len(ml.importances(forest)) == len(ml.FEATURES)
    weights = {r["label"]: r["weight"] for r in ml.balanced(rows).select("label", "weight").distinct().collect()}
    assert weights == {"x": 120 / 80, "y": 120 / 160}


def test_command_line_end_to_end(spark, tmp_path):
    from wakeflow import cli

    lines = ["MMSI,BaseDateTime,LAT,LON,SOG,COG"] + [f"1,{(T0 + timedelta(minutes=5 * i)):%Y-%m-%d %H:%M:%S},{50 + (i % 20) * 0.02},5.0,{0.1 if i > 30 else 8},{i * 40 % 360}" for i in range(60)]
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    (tmp_path / "z.wkt").write_text("POLYGON ((4 50.1, 6 50.1, 6 50.3, 4 50.3, 4 50.1))")
    p = lambda n: str(tmp_path / n)
    for args in (
        ["ingest", "--source", p("raw.csv"), "--output", p("points.parquet"), "--stats", p("stats.json")],
        ["segment", "--points", p("points.parquet"), "--window", "60", "--output", p("segments.parquet")],
        ["boundary", "--points", p("points.parquet"), "--polygons", p("z.wkt"), "--output", p("boundary.parquet")],
        ["events", "--points", p("points.parquet"), "--boundary", p("boundary.parquet"), "--output", p("events.json")],
        ["features", "--segments", p("segments.parquet"), "--boundary", p("boundary.parquet"), "--events", p("events.json"), "--polygons", p("z.wkt"), "--output", p("features.parquet")],
        ["labels", "--features", p("features.parquet"), "--output", p("labels.parquet")],
        ["reason", "--events", p("events.json"), "--output", p("situations.parquet")],
        ["reason", "--events", p("events.json"), "--output", p("situations.json")],
        ["report", "--situations", p("situations.parquet"), "--output", p("reports")],
        ["report", "--situations", p("situations.json"), "--output", p("more_reports")],
        ["report", "--situations", p("situations.json"), "--features", p("features.parquet"), "--output", p("full_reports")],
        ["prepare", "--source", p("raw.csv"), "--window", "60", "--output", p("prepared")],
    ):
        cli.main(args)
    rows = spark.range(90).select(F.col("id").cast("string").alias("segment_id"), (F.col("id") % 9).alias("mmsi"), *[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(ml.FEATURES)])
    folder = tmp_path / "evaluation"
    rows.write.parquet(str(folder / "features.parquet"))
    start = F.lit(T0).cast("timestamp")
    rows.select("segment_id", "mmsi", start.alias("segment_start"), start.alias("segment_end"), F.when(F.col("mmsi") < 4, "Transit").otherwise("Anchorage").alias("situation_label")).write.parquet(str(folder / "situation_labels.parquet"))
    for name in ("cleaned_ais", "segments"):
        rows.limit(1).write.parquet(str(folder / f"day_{name}.parquet"))
    sinks.write_envelope(_events(spark), str(folder / "event_sequence.json"), "event")
    sinks.write_envelope(spark.createDataFrame([("Boundary Crossing", 0.75, 8, T0, T0)], "situation string, confidence double, mmsi long, start_timestamp timestamp, end_timestamp timestamp"), str(folder / "reasoned_situations.json"), "situation")
    cli.main(["train", "--features", str(folder / "features.parquet"), "--labels", str(folder / "situation_labels.parquet"), "--trees", "5", "--test-size", "0.2", "--metrics", p("metrics.json"), "--output", p("model")])
    (tmp_path / "evaluated").mkdir()
    cli.main(["evaluate", "--folder", str(folder), "--model", p("model"), "--output", p("evaluated")])
    audited = spark.read.parquet(p("evaluated/predictions.parquet"))
    assert audited.count() == 10 and readers.read_metrics(p("evaluated/reasoning_metrics.json"))["total_test_segments"] == 10
    cli.main(["compare", "--metrics", p("metrics.json"), "--output", p("table.csv")])
    assert "this system" in (tmp_path / "table.csv").read_text()
    assert json.loads((tmp_path / "stats.json").read_text())["cleaned_rows"] == 60
    assert spark.read.parquet(p("labels.parquet")).count() == 5 and spark.read.text(p("reports")).count() > 0
    assert spark.read.parquet(p("features.parquet")).filter("crossing_count > 0").count() > 0
    texts = {n: sorted(r["value"] for r in spark.read.text(p(n)).collect()) for n in ("reports", "more_reports", "full_reports")}
    assert texts["reports"] == texts["more_reports"] != texts["full_reports"] and any("knots." in x and "passed" in x for x in texts["full_reports"])
    assert spark.read.parquet(p("prepared/raw_cleaned_ais.parquet")).count() == 60 and json.loads((tmp_path / "prepared/raw_cleaning_stats.json").read_text())["vessel_count"] == 1
    assert sorted(map(str, spark.read.parquet(p("prepared/raw_segments.parquet")).collect())) == sorted(map(str, spark.read.parquet(p("segments.parquet")).collect()))


def test_facts_of_the_segment_that_shares_most_time(spark):
    hour = lambda n: T0 + timedelta(hours=n)
    found = spark.createDataFrame([("Transit", 1, hour(0), hour(10)), ("Transit", 2, hour(0), hour(1)), ("Prolonged Boundary Presence", 1, hour(30), hour(50)), ("Transit", None, hour(0), None)], "situation string, mmsi long, start_timestamp timestamp, end_timestamp timestamp")
    found = found.withColumn("supporting_events", F.array().cast(f"array<struct<event_type:string,duration_minutes:double,details:{events.DETAILS}>>"))
    known = spark.createDataFrame([("a", 1, hour(-5), hour(2), 1.0, 11.0), ("b", 1, hour(2), hour(9), 2.0, None), ("c", 1, hour(9), hour(40), 3.5, 3.0), ("d", 1, hour(40), hour(50), 4.0, 4.0)], "segment_id string, mmsi long, segment_start timestamp, segment_end timestamp, distance_to_boundary double, avg_speed double")
    got = {(r["mmsi"], r["situation"]): (r["distance_to_boundary"], r["avg_speed"]) for r in reports.with_facts(found, known).collect()}
    assert got == {(1, "Transit"): (2.0, None), (2, "Transit"): (None, None), (1, "Prolonged Boundary Presence"): (3.5, 3.0), (None, "Transit"): (None, None)}
    lines = [r["report"] for r in reports.report_lines(found, known).collect()]
    assert len(lines) == 4 and any(x.endswith("3.5 km from the boundary.") for x in lines if x) and not any("knots" in x for x in lines if x)
