"""Registered queries over the driver's tables, with their SQL in :mod:`wakeflow.plans.oracle`.

The ``events`` table is the only time series: users stand for vessels, and place, speed
and heading follow from its value and props. Its points are hours apart, so thresholds
are scaled; the defaults in :mod:`wakeflow.config` are for real position reports.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeflow.config import EventThresholds, LabelThresholds, ReasoningThresholds, SegmentConfig
from wakeflow.functions import exprs, geometry, nearest
from wakeflow.operators import analytics, clean, evaluation, events, features, fishing, geofence, labels, ml, reports, segment, simplify, situations
from wakeflow.plans.oracle import ORACLE_SQL
from wakeflow.plans.shapes import ZONES
from wakeflow.session import once, shared_checkpoints
from wakeflow.sources import readers, sinks
from wakeflow.streaming import files, tracks

EVENTS = EventThresholds(
    anchor_speed_knots=2.0, anchor_min_duration_minutes=60, loiter_speed_knots=4.0, loiter_radius_km=100.0, loiter_min_duration_minutes=120, max_ais_gap_minutes=1440,
    maneuver_window_minutes=10080, maneuver_min_points=10, maneuver_min_point_coverage_ratio=0.5, maneuver_heading_circular_variance_threshold=0.5, repeated_crossing_count=3, repeated_crossing_window_hours=24,
)
SEGMENTS = SegmentConfig(window_minutes=(10080, 20160), min_points=10, track_keys=("MMSI",))
LABELS = LabelThresholds(anchorage_min_anchor_duration_minutes=600, boundary_crossing_min_crossings=6, prolonged_boundary_max_distance_km=400, prolonged_boundary_min_loiter_duration_minutes=600, transit_max_speed_variance=8.0, transit_max_trajectory_curvature=30.0)
REASONING = ReasoningThresholds(transit_max_trip_hours=12, anchorage_min_duration_minutes=600)
ZONE = (9.0, 54.5, 11.1, 55.5)

_ADAPTER = """
select user_id as MMSI, cast(ts as timestamp) as timestamp, 54 + (k % 10) * cast(0.2 as double) as latitude, 8 + floor(k / 10) * cast(0.4 as double) as longitude,
       value / 10 as speed, k * cast(3.6 as double) as heading
from (select *, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k from {table}) e
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_ADAPTER.format(table="{table}"), table=table)


def _edges(spark: SparkSession) -> DataFrame:
    return geometry.edges_of(spark, [geometry.rectangle(*ZONE)])


def _boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geofence.boundary_events(points(spark, sf_dir), _edges(spark))


def _sequence(spark: SparkSession, sf_dir: str, boundary: DataFrame | None = None) -> DataFrame:
    return events.event_sequence(points(spark, sf_dir), boundary if boundary is not None else _boundary(spark, sf_dir), EVENTS)


def _segment_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_points(points(spark, sf_dir), SEGMENTS)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    boundary = once(_boundary(spark, sf_dir))  # read three times
    return features.segment_features(_segment_points(spark, sf_dir), boundary, _sequence(spark, sf_dir, boundary), _edges(spark))


def _effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("user_id").alias("ssvid"), F.to_date("ts").alias("date")).agg((F.round(F.sum("value"), 6) / 100).alias("fishing_hours"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.situation_labels(_features(spark, sf_dir), fishing.effort_to_labels(_effort(spark, sf_dir), 3.0), LABELS)


def _situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return situations.reason(_sequence(spark, sf_dir), REASONING)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last bits; the small addend (also in the SQL) keeps exact halves from falling either way."""
    return df.select(*[F.round(F.col(c) + 3.7e-10, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _numbers(df: DataFrame) -> DataFrame:
    """Events with the numbers of their details as columns."""
    return rounded(df.select("event_type", "event_timestamp", "mmsi", "start_timestamp", "end_timestamp", "duration_minutes", "details.mean_speed_knots", F.coalesce("details.number_of_points", F.lit(0)).alias("number_of_points"), "details.observed_radius_km", "details.heading_circular_variance", "details.point_coverage_ratio", F.coalesce("details.crossing_count", F.lit(0)).alias("crossing_count")))


def q_clean_points(spark, sf_dir):
    raw = points(spark, sf_dir)
    # as a raw file would hold them: text, under other names, and every tenth row twice
    text = raw.select(F.col("MMSI").cast("string").alias("vessel id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("BaseDateTime"), F.col("latitude").alias("LAT"), F.col("longitude").alias("LON"), F.col("speed").alias("SOG"), F.col("heading").alias("COG"))
    return rounded(clean.clean(clean.standardize(text.unionByName(text.filter(F.col("LAT") > 55.5)))))


def q_cleaning_stats(spark, sf_dir):
    raw = points(spark, sf_dir)
    twice = raw.unionByName(raw.filter(F.col("latitude") > 55.5)).unionByName(raw.filter(F.col("longitude") > 11).withColumn("latitude", F.lit(95.0)))
    return clean.cleaning_stats(twice)


def q_segments(spark, sf_dir):
    return rounded(segment.segments(points(spark, sf_dir), SEGMENTS))


def q_segment_points(spark, sf_dir):
    days = SegmentConfig(window_minutes=(720,), min_points=2)
    return rounded(segment.segment_points(points(spark, sf_dir), days).select("segment_id", "MMSI", "timestamp", "window_minutes", "segment_start", "segment_end", "duration_seconds", "number_of_points", "trajectory_date"))


def q_anchor_events(spark, sf_dir):
    return _numbers(events.anchor_events(events.prepare_points(points(spark, sf_dir)), EVENTS))


def q_loiter_events(spark, sf_dir):
    p = events.prepare_points(points(spark, sf_dir))
    return _numbers(events.loiter_events(p, events.anchor_events(p, EVENTS), EVENTS))


def q_maneuver_events(spark, sf_dir):
    return _numbers(events.maneuver_events(events.prepare_points(points(spark, sf_dir)), EVENTS))


def q_repeated_crossings(spark, sf_dir):
    return _numbers(events.repeated_crossings(events.boundary_sequence(_boundary(spark, sf_dir)), EVENTS))


def q_event_sequence(spark, sf_dir):
    return _numbers(_sequence(spark, sf_dir))


def q_segment_motion_features(spark, sf_dir):
    f = features.motion_features(_segment_points(spark, sf_dir))
    return rounded(f.select("segment_id", "mmsi", "number_of_points", "avg_speed", "max_speed", "speed_variance", "path_length", "displacement", "heading_variance", "mean_heading_change", "loop_count", "turn_density", "stationary_ratio"), 5)


def q_crossing_counts(spark, sf_dir):
    base = segment.segments(points(spark, sf_dir), SEGMENTS).withColumnRenamed("MMSI", "mmsi")
    return features.crossing_counts(base, _boundary(spark, sf_dir))


def q_event_overlap_minutes(spark, sf_dir):
    base = segment.segments(points(spark, sf_dir), SEGMENTS).withColumnRenamed("MMSI", "mmsi")
    return rounded(features.event_overlap_minutes(base, _sequence(spark, sf_dir)))


def q_distance_to_boundary(spark, sf_dir):
    base = features.motion_features(_segment_points(spark, sf_dir))
    return rounded(nearest.distance_km(base, _edges(spark), "segment_id", "centroid_longitude", "centroid_latitude"), 5)


def _rounded_features(f: DataFrame) -> DataFrame:
    return f.select(*[F.round(F.col(c) + 3.7e-10, 6 if c == "duration_seconds" else 5).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


def q_segment_features(spark, sf_dir):
    return _rounded_features(_features(spark, sf_dir))


def q_fishing_intervals(spark, sf_dir):
    out = fishing.effort_to_labels(_effort(spark, sf_dir), 0.5)  # no sums here: rounded as they are
    return out.withColumns({c: F.round(c, 9) for c in ("fishing_hours", "label_confidence")})


def q_situation_labels(spark, sf_dir):
    return _labels(spark, sf_dir).drop("rule_details")


def q_reasoned_situations(spark, sf_dir):
    s = _situations(spark, sf_dir)
    return s.select("situation", "confidence", "mmsi", "start_timestamp", "end_timestamp", "extent_start", "extent_end", F.size("supporting_events").cast("long").alias("n_support"))


def q_event_distribution(spark, sf_dir):
    return rounded(analytics.event_distribution(_sequence(spark, sf_dir)))


def q_event_reduction(spark, sf_dir):
    return rounded(analytics.reduction(points(spark, sf_dir), _sequence(spark, sf_dir)))


def q_segment_compression(spark, sf_dir):
    return rounded(analytics.compression(_segment_points(spark, sf_dir)))


def q_top_vessels(spark, sf_dir):
    return analytics.top_vessels(points(spark, sf_dir), 10)


def q_track_bounds(spark, sf_dir):
    return rounded(analytics.bounds(points(spark, sf_dir)))


def q_track_downsample(spark, sf_dir):
    return rounded(analytics.downsample(points(spark, sf_dir), 20))


def q_nearest_point_asof(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("mmsi"), F.col("o_orderdate").cast("timestamp").alias("event_timestamp"))
    return rounded(analytics.nearest_points(o, points(spark, sf_dir)).filter("point_timestamp is not null"))


def q_segment_best_situation(spark, sf_dir):
    base = once(segment.segments(points(spark, sf_dir), SEGMENTS)).withColumnRenamed("MMSI", "mmsi")
    return analytics.best_situation(base, _situations(spark, sf_dir), ["Anchorage", "Repeated Crossing", "Prolonged Boundary Presence"], bucket_minutes=10080)


def _predictions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("truth"), F.when(F.col("o_totalprice") % 3 < 1, F.col("o_orderpriority")).when(F.col("o_totalprice") % 3 < 2, "2-HIGH").otherwise("5-LOW").alias("predicted"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def q_class_metrics(spark, sf_dir):
    return rounded(analytics.class_metrics(_predictions(spark, sf_dir), "truth", "predicted", PRIORITIES).select("class", "support", "precision", "recall", "f1"))


def q_confusion_metrics(spark, sf_dir):
    return rounded(analytics.overall_metrics(_predictions(spark, sf_dir), "truth", "predicted", PRIORITIES))


def q_confusion_matrix(spark, sf_dir):
    m = analytics.confusion(_predictions(spark, sf_dir), "truth", "predicted", PRIORITIES)
    return m.select(F.col("truth"), *[F.col(f"`{c}`").alias(f"n{i}") for i, c in enumerate(PRIORITIES, 1)])


def q_chord_deviation(spark, sf_dir):
    return rounded(analytics.chord_deviation(_segment_points(spark, sf_dir)), 5)


def q_track_simplification(spark, sf_dir):
    return simplify.simplified(points(spark, sf_dir), [0.1, 0.2, 0.5])


def q_vessel_paths(spark, sf_dir):
    p = analytics.vessel_paths(points(spark, sf_dir), 50)
    return rounded(p.select("MMSI", (F.col("part") * 50).alias("base"), F.posexplode("path").alias("i", "p")).select("MMSI", (F.col("base") + F.col("i")).alias("i"), "p.latitude", "p.longitude"))


def q_top_vessel_tracks(spark, sf_dir):
    return rounded(analytics.top_vessel_tracks(points(spark, sf_dir), 5, 20).select("MMSI", "timestamp", "latitude", "longitude", "rank"))


def q_segment_endpoints(spark, sf_dir):
    return rounded(analytics.segment_endpoints(_segment_points(spark, sf_dir)))


def q_situation_reports(spark, sf_dir):
    return reports.report_lines(_situations(spark, sf_dir))


def q_inside_zone(spark, sf_dir):
    p = geofence.classify(points(spark, sf_dir), _edges(spark))
    return p.groupBy("inside_eez", "outside_eez").agg(F.count("*").alias("n"))


def q_irregular_zone_crossings(spark, sf_dir):
    return geofence.boundary_events(points(spark, sf_dir), geometry.edges_of(spark, ZONES))


def q_irregular_zone_distance(spark, sf_dir):
    base = features.motion_features(_segment_points(spark, sf_dir))
    return rounded(nearest.distance_km(base, geometry.edges_of(spark, ZONES), "segment_id", "centroid_longitude", "centroid_latitude", capacity=8), 5)


def q_streamed_event_sequence(spark, sf_dir):
    """The points as a stream of the table's files, with a last word that lets the watermark pass them all."""
    folder = f"{shared_checkpoints(spark)}/stream-{uuid.uuid4().hex}"
    schema = "MMSI long, timestamp timestamp, latitude double, longitude double, speed double, heading double"
    spark.sql("select -1L as MMSI, timestamp'2999-01-01' as timestamp, 0D as latitude, 0D as longitude, 20D as speed, cast(null as double) as heading").write.parquet(f"{folder}/end")
    table = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = spark.sql(_ADAPTER.format(table="{table}"), table=table).unionByName(spark.readStream.schema(schema).parquet(f"{folder}/end"))
    x, y = F.col("longitude"), F.col("latitude")
    rows = rows.withColumn("inside_eez", (x > ZONE[0]) & (x < ZONE[2]) & (y > ZONE[1]) & (y < ZONE[3]))
    key, value = tracks.STATE_PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        files.write_stream(tracks.found_stream(rows, "1 hour", EVENTS), f"{folder}/out", f"{folder}/state").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return _numbers(tracks.as_events(files.read_written(spark, f"{folder}/out", tracks.FOUND), EVENTS))


def q_label_counts(spark, sf_dir):
    return labels.label_counts(_labels(spark, sf_dir))


def q_boundary_events(spark, sf_dir):
    return _boundary(spark, sf_dir)


def _labelled(spark, sf_dir):
    """Orders as labelled rows of vessels: for splits and samples, which ask for no tracks."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("mmsi"))


def q_stratified_split(spark, sf_dir):
    return analytics.stratified_split(_labelled(spark, sf_dir), "label", "id")


def q_vessel_split(spark, sf_dir):
    return analytics.vessel_split(_labelled(spark, sf_dir)).select("mmsi", "split").distinct()


def q_group_sample(spark, sf_dir):
    return analytics.sample_groups(_labelled(spark, sf_dir), "label", "id", 500, capped=PRIORITIES[:3])


def q_label_remaps(spark, sf_dir):
    s = _situations(spark, sf_dir).groupBy("situation").agg(F.count("*").alias("n"))
    return s.select("situation", evaluation.remap("situation", evaluation.REASONER_TO_CLASS).alias("class"), evaluation.remap("situation", evaluation.SITUATION_TO_ACTIVITY).alias("activity"), evaluation.situation_of("situation").alias("target"), "n")


def q_speed_without_speeds(spark, sf_dir):
    bare = _segment_points(spark, sf_dir).withColumn("speed", F.lit(None).cast("double"))
    return rounded(features.motion_features(bare).select("segment_id", "avg_speed", "max_speed", "speed_variance"), 5)


def q_feature_profile(spark, sf_dir):
    f = features.motion_features(_segment_points(spark, sf_dir))
    return rounded(evaluation.profile(f, ["avg_speed", "path_length", "number_of_points"]), 4)


def q_rule_hits(spark, sf_dir):
    return evaluation.rule_hits(_features(spark, sf_dir), LABELS)


def q_rule_details(spark, sf_dir):
    d = F.from_json("rule_details", "avg_speed double, speed_variance double, trajectory_curvature double, crossing_count double, distance_to_boundary double, anchor_duration double, loiter_duration double")
    rows = _labels(spark, sf_dir).select("segment_id", d.alias("d")).select("segment_id", "d.*")
    return rounded(rows, 4)


def q_predictions_audit(spark, sf_dir):
    given = _labels(spark, sf_dir)
    said = given.select("segment_id", F.when(F.col("segment_id").substr(-3, 1) < "5", "Transit").otherwise("Anchorage").alias("predicted"))
    return evaluation.audit(given, {"rf": said}, _situations(spark, sf_dir), bucket_minutes=10080)


def q_context_metrics(spark, sf_dir):
    return rounded(evaluation.context_metrics(q_predictions_audit(spark, sf_dir)))


def q_comparison_table(spark, sf_dir):
    e = analytics.reduction(points(spark, sf_dir), _sequence(spark, sf_dir)).select(F.lit("this system").alias("system"), "points", "events", "reduction_percent")
    return analytics.comparison_table(spark, [{"system": "prior work", "points": 338000000, "events": 53000000, "reduction_percent": 84.0}], e)


def q_event_json(spark, sf_dir):
    """Events written as JSON lines and read again; times as text."""
    folder = f"{shared_checkpoints(spark)}/events-{uuid.uuid4().hex}"
    sinks.write_json_lines(_numbers(_sequence(spark, sf_dir)), folder)
    return spark.read.schema("event_type string, event_timestamp string, mmsi long, start_timestamp string, end_timestamp string, duration_minutes double, crossing_count long").json(folder)


def q_points_written(spark, sf_dir):
    """Cleaned points written by date and read again: some columns of some vessels."""
    folder = f"{shared_checkpoints(spark)}/points-{uuid.uuid4().hex}.parquet"
    sinks.write_points(clean.clean(points(spark, sf_dir)), folder)
    return rounded(readers.read_points(spark, folder, ["MMSI", "timestamp", "latitude", "longitude"], vessels=range(1, 40)))


def q_boundary_written(spark, sf_dir):
    """Zone entries and exits written and read again, with those that no file holds."""
    folder = f"{shared_checkpoints(spark)}/boundary-{uuid.uuid4().hex}.parquet"
    sinks.write_table(_boundary(spark, sf_dir), folder)
    return readers.read_boundary_events(spark, folder).unionByName(readers.read_boundary_events(spark, f"{folder}-none"))


def q_human_numbers(spark, sf_dir):
    return analytics.top_vessels(points(spark, sf_dir), 20).select("MMSI", exprs.human(F.col("n") * 100).alias("text"))


def q_carried_state(spark, sf_dir):
    """Transitions of two batches, the second continued from the states after the first."""
    marked = geofence.classify(points(spark, sf_dir), _edges(spark))
    half = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp")
    none = spark.createDataFrame([], "mmsi long, inside boolean")
    first, states = geofence.transitions_with_state(marked.filter(half), none)
    return first.unionByName(geofence.transitions_with_state(marked.filter(~half), states)[0])


def q_forest_predictions(spark, sf_dir):
    """A small forest learned from segments of some vessels and applied to those of others."""
    rows = ml.training_rows(_features(spark, sf_dir), _labels(spark, sf_dir))
    split = analytics.vessel_split(once(rows))
    model = ml.fit(split.filter("split = 'train'"), trees=10, depth=5)
    return ml.predict(model, split.filter("split = 'test'"))


def q_boosted_predictions(spark, sf_dir):
    """As the forest, by softmax boosting."""
    rows = ml.training_rows(_features(spark, sf_dir), _labels(spark, sf_dir))
    split = analytics.vessel_split(once(rows))
    model = ml.fit(split.filter("split = 'train'"), model="boosted", trees=5, depth=3)
    return ml.predict(model, split.filter("split = 'test'"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
__all__ = ["ORACLE_SQL", "QUERIES", "points"]
