"""Segment features: motion aggregates, crossings, event overlaps, distance to the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.config import FeatureConfig
from wakeflow.functions import exprs as X
from wakeflow.functions import nearest
from wakeflow.operators.clean import require
from wakeflow.session import once

#: The columns of a feature row, in order.
FEATURE_COLUMNS = [
    "segment_id", "mmsi", "window_minutes", "segment_start", "segment_end", "duration_seconds", "number_of_points", "avg_speed", "max_speed", "speed_variance", "path_length", "displacement",
    "trajectory_curvature", "path_tortuosity", "heading_variance", "mean_heading_change", "loop_count", "turn_density", "stationary_ratio", "crossing_count", "distance_to_boundary", "anchor_duration", "loiter_duration",
]
KM_PER_HOUR_PER_KNOT = 1.852


def motion_features(points: DataFrame, config: FeatureConfig | None = None) -> DataFrame:
    """One row per segment from its points: speeds, path, headings, centroid, first and last place.

    Whether any segment has a speed decides on all of them, so the sums are checkpointed first.
    """
    config = config or FeatureConfig()
    require(points, ["segment_id", "MMSI", "timestamp", "latitude", "longitude", "speed", "heading"], "segment points")
    track = Window.partitionBy("segment_id").orderBy("timestamp")
    rows = points.withColumns({
        "step": F.coalesce(X.haversine_km(F.lag("latitude").over(track), F.lag("longitude").over(track), "latitude", "longitude"), F.lit(0.0)),
        "turn": X.heading_change("heading", F.lag("heading").over(track)),
    })
    v = F.col("speed")
    rows = rows.groupBy("segment_id").agg(
        F.first("MMSI").alias("mmsi"),
        (F.first("window_minutes") if "window_minutes" in points.columns else F.count("*")).alias("window_minutes"),
        F.min("segment_start" if "segment_start" in points.columns else "timestamp").alias("segment_start"),
        F.max("segment_end" if "segment_end" in points.columns else "timestamp").alias("segment_end"),
        F.count("*").alias("number_of_points"),
        F.avg(v).alias("avg_speed"), F.max(v).alias("max_speed"), X.clip(F.avg(v * v) - F.avg(v) * F.avg(v), low=0.0).alias("speed_variance"),
        F.sum("step").alias("path_length"), F.var_samp("heading").alias("heading_variance"), F.avg("turn").alias("mean_heading_change"),
        F.coalesce(F.sum("turn"), F.lit(0.0)).alias("total_turn"), F.count_if(F.col("turn") > config.significant_turn_degrees).alias("turns"),
        F.avg(F.when(v < config.stationary_speed_knots, 1.0).otherwise(0.0)).alias("stationary_ratio"),
        F.avg("latitude").alias("centroid_latitude"), F.avg("longitude").alias("centroid_longitude"),
        *[f(c, F.when(F.col(c).isNotNull(), F.col("timestamp"))).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("first", F.min_by), ("last", F.max_by))],
    )
    rows = rows.withColumn("duration_seconds", X.seconds_between("segment_end", "segment_start"))
    rows = rows.withColumn("displacement", X.haversine_km("first_latitude", "first_longitude", "last_latitude", "last_longitude"))
    rows = rows.withColumn("trajectory_curvature", X.ratio("path_length", "displacement")).withColumn("path_tortuosity", F.col("trajectory_curvature"))
    rows = rows.withColumn("loop_count", F.col("total_turn") / 360).withColumn("turn_density", X.ratio("turns", "path_length"))
    # only if no segment at all has a speed: from path and duration
    rows = once(rows)
    unknown = rows.filter(F.col("avg_speed").isNotNull()).isEmpty()
    made = X.ratio(F.col("path_length") / KM_PER_HOUR_PER_KNOT, F.col("duration_seconds") / 3600)
    fill = lambda c, x: (x if unknown else F.col(c)).alias(c)
    keep = [c for c in rows.columns if c not in ("avg_speed", "max_speed", "speed_variance", "total_turn", "turns")]
    return rows.select(*keep, fill("avg_speed", made), fill("max_speed", made), fill("speed_variance", F.lit(0.0)))


def buckets(start, end, minutes: int):
    """A row for each stretch of so many minutes that start to end meets."""
    return F.explode(F.sequence(F.floor(X.micros(start) / (minutes * 60_000_000)), F.floor(X.micros(end) / (minutes * 60_000_000))))


def crossing_counts(segments: DataFrame, boundary: DataFrame, bucket_minutes: int = 1440) -> DataFrame:
    """segment_id, crossing_count: boundary events of the vessel from start to end, both inclusive.

    Segments are dealt to time buckets, so that a vessel's events meet only the segments
    of their bucket.
    """
    s = segments.select("segment_id", "mmsi", "segment_start", "segment_end", buckets("segment_start", "segment_end", bucket_minutes).alias("bucket"))
    b = boundary.select(F.col("mmsi").alias("mmsi"), F.col("event_timestamp").alias("t"), F.floor(X.micros("event_timestamp") / (bucket_minutes * 60_000_000)).alias("bucket"))
    met = s.join(b, ["mmsi", "bucket"]).filter(F.col("t").between(F.col("segment_start"), F.col("segment_end"))).groupBy("segment_id").agg(F.count("*").alias("crossing_count"))
    return segments.select("segment_id").join(met, "segment_id", "left").select("segment_id", F.coalesce("crossing_count", F.lit(0)).cast("long").alias("crossing_count"))


def event_overlap_minutes(segments: DataFrame, events: DataFrame, bucket_minutes: int = 1440) -> DataFrame:
    """segment_id, anchor_duration, loiter_duration: minutes that ANCHOR and LOITER events share with the segment.

    Both sides are dealt to time buckets; a pair counts in the bucket where its overlap begins.
    """
    width = bucket_minutes * 60_000_000
    s = segments.select("segment_id", "mmsi", "segment_start", "segment_end", buckets("segment_start", "segment_end", bucket_minutes).alias("bucket"))
    e = events.filter(F.col("event_type").isin("ANCHOR", "LOITER")).select("mmsi", "event_type", F.col("start_timestamp").alias("s"), F.col("end_timestamp").alias("e"))
    e = e.select("*", buckets("s", "e", bucket_minutes).alias("bucket"))
    both = s.join(e, ["mmsi", "bucket"]).filter(X.overlaps("segment_start", "segment_end", "s", "e"))
    both = both.filter(F.col("bucket") == F.floor(F.greatest(X.micros("segment_start"), X.micros("s")) / width))
    m = X.overlap_minutes("segment_start", "segment_end", "s", "e")
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, m)), F.lit(0.0))
    sums = both.groupBy("segment_id").agg(total("ANCHOR").alias("anchor_duration"), total("LOITER").alias("loiter_duration"))
    return segments.select("segment_id").join(sums, "segment_id", "left").fillna(0.0, ["anchor_duration", "loiter_duration"])


def crossings_and_overlaps(segments: DataFrame, boundary: DataFrame, events: DataFrame, bucket_minutes: int = 1440) -> DataFrame:
    """segment_id, crossing_count, anchor_duration, loiter_duration of the segments that have any, as of the two functions above, by one join."""
    width = bucket_minutes * 60_000_000
    s = segments.select("segment_id", "mmsi", "segment_start", "segment_end", buckets("segment_start", "segment_end", bucket_minutes).alias("bucket"))
    x = boundary.select("mmsi", F.lit("CROSSING").alias("kind"), F.col("event_timestamp").alias("s"), F.col("event_timestamp").alias("e"))
    e = events.filter(F.col("event_type").isin("ANCHOR", "LOITER")).select("mmsi", F.col("event_type").alias("kind"), F.col("start_timestamp").alias("s"), F.col("end_timestamp").alias("e"))
    e = x.unionByName(e).select("*", buckets("s", "e", bucket_minutes).alias("bucket"))
    both = s.join(e, ["mmsi", "bucket"]).filter(X.overlaps("segment_start", "segment_end", "s", "e"))
    both = both.filter(F.col("bucket") == F.floor(F.greatest(X.micros("segment_start"), X.micros("s")) / width))
    m = X.overlap_minutes("segment_start", "segment_end", "s", "e")
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, m)), F.lit(0.0))
    return both.groupBy("segment_id").agg(F.count_if(F.col("kind") == "CROSSING").alias("crossing_count"), total("ANCHOR").alias("anchor_duration"), total("LOITER").alias("loiter_duration"))


def segment_features(points: DataFrame, boundary: DataFrame, events: DataFrame, edges: DataFrame | None = None, config: FeatureConfig | None = None) -> DataFrame:
    """The feature rows of segment points, boundary events and the event sequence; a null distance without polygons."""
    base = motion_features(points, config)
    out = base.join(crossings_and_overlaps(base, boundary, events), "segment_id", "left")
    if edges is not None:
        out = out.join(nearest.distance_km(base, edges, "segment_id", "centroid_longitude", "centroid_latitude"), "segment_id", "left")
    else:
        out = out.withColumn("distance_to_boundary", F.lit(None).cast("double"))
    out = out.fillna(0, ["crossing_count"]).fillna(0.0, ["anchor_duration", "loiter_duration"])
    return out.select(*FEATURE_COLUMNS)
