"""Track-anchored tumbling windows: the origin of a track's windows is its first point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.config import SegmentConfig
from wakeflow.functions import exprs as X
from wakeflow.operators.clean import require


def segment_points(points: DataFrame, config: SegmentConfig | None = None) -> DataFrame:
    """Each point once per window length, with its segment's columns; segments under min_points are dropped.

    Epoch-aligned windows cannot express the origin, so it is a window minimum. All
    windows share the shuffle by track; window lengths are exploded after the origin.
    """
    config = config or SegmentConfig()
    require(points, ["MMSI", "timestamp", "latitude", "longitude"], "points")
    rows = points.dropna(subset=["MMSI", "timestamp"])
    if "trajectory_date" not in rows.columns:
        rows = rows.withColumn("trajectory_date", F.date_format("timestamp", "yyyy-MM-dd"))
    track = Window.partitionBy(*config.track_keys)
    rows = rows.withColumn("_origin", F.min("timestamp").over(track))
    rows = rows.withColumn("window_minutes", F.explode(F.array(*[F.lit(w) for w in config.window_minutes])))
    step = F.col("window_minutes").cast("long") * 60_000_000
    rows = rows.withColumn("_index", F.floor((X.micros("timestamp") - X.micros("_origin")) / step).cast("long"))
    one = Window.partitionBy(*config.track_keys, "window_minutes", "_index")
    rows = rows.withColumns({"number_of_points": F.count("*").over(one), "segment_start": F.min("timestamp").over(one), "segment_end": F.max("timestamp").over(one)})
    rows = rows.filter(F.col("number_of_points") >= config.min_points)
    return rows.withColumns({
        "segment_id": X.segment_id("MMSI", "_origin", "window_minutes", "_index", "segment_start"),
        "duration": F.col("segment_end") - F.col("segment_start"),
        "duration_seconds": X.seconds_between("segment_end", "segment_start"),
    }).drop("_origin", "_index")


def segments(points: DataFrame, config: SegmentConfig | None = None) -> DataFrame:
    """One row per segment."""
    rows = segment_points(points, config)
    return rows.groupBy("segment_id").agg(
        *[F.first(c).alias(c) for c in ("MMSI", "window_minutes", "segment_start", "segment_end", "duration_seconds", "number_of_points")], F.avg("speed").alias("avg_speed")
    )
