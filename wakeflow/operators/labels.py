"""Weak situation labels: the most confident of the rules that match, the earlier one on ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.config import LabelThresholds
from wakeflow.functions import exprs as X
from wakeflow.operators.clean import integer, number, require
from wakeflow.operators.fishing import fishing_segments

#: Columns that rules read; nulls count as 0.
RULE_INPUTS = ["avg_speed", "speed_variance", "trajectory_curvature", "crossing_count", "distance_to_boundary", "anchor_duration", "loiter_duration"]


def rules(t: LabelThresholds) -> list[tuple]:
    """(label, confidence, source, condition, details) in the order that breaks ties."""
    c = X.settled
    no_events = (c("crossing_count") == 0) & (c("anchor_duration") == 0) & (c("loiter_duration") == 0)
    return [
        ("Transit", t.transit_confidence, "rule", (c("avg_speed") >= t.transit_min_avg_speed) & (c("speed_variance") <= t.transit_max_speed_variance) & (c("trajectory_curvature") <= t.transit_max_trajectory_curvature) & no_events, ["avg_speed", "speed_variance", "trajectory_curvature"]),
        ("Boundary Crossing", t.boundary_crossing_confidence, "rule", c("crossing_count") >= t.boundary_crossing_min_crossings, ["crossing_count"]),
        ("Prolonged Boundary Presence", t.prolonged_boundary_confidence, "rule", (c("distance_to_boundary") <= t.prolonged_boundary_max_distance_km) & (c("loiter_duration") >= t.prolonged_boundary_min_loiter_duration_minutes), ["distance_to_boundary", "loiter_duration"]),
        ("Anchorage", t.anchorage_confidence, "rule", c("anchor_duration") >= t.anchorage_min_anchor_duration_minutes, ["anchor_duration"]),
        ("Fishing", t.fishing_confidence, "fishing_label", F.col("_fishing"), []),
    ]


def situation_labels(features: DataFrame, fishing: DataFrame | None = None, t: LabelThresholds | None = None) -> DataFrame:
    """segment_id, mmsi, segment_start, segment_end, situation_label, label_confidence, label_source, rule_details (JSON)."""
    t = t or LabelThresholds()
    require(features, ["segment_id", "mmsi", "segment_start", "segment_end", *RULE_INPUTS], "features")
    rows = features.select(F.col("segment_id"), integer("mmsi").alias("mmsi"), "segment_start", "segment_end", *[number(x).alias(x) for x in RULE_INPUTS])
    rows = rows.dropna(subset=["segment_id", "mmsi", "segment_start", "segment_end"])
    filled = [x for x in RULE_INPUTS if t.missing_distance_is_zero or x != "distance_to_boundary"]
    rows = rows.fillna(0.0, filled)
    if fishing is None:
        rows = rows.withColumn("_fishing", F.lit(False))
    else:
        hit = fishing_segments(features, fishing).distinct().withColumn("_fishing", F.lit(True))
        rows = rows.join(hit, "segment_id", "left").fillna(False, ["_fishing"])
    # confidences are known when planning: one CASE in their order says what a fold over the rules would
    order = sorted(enumerate(rules(t)), key=lambda r: (-r[1][1], r[0]))
    label, confidence, source, details = (F.when(F.lit(False), F.lit(None)) for _ in range(4))
    for _, (name, score, origin, condition, names) in order:
        label, confidence, source = label.when(condition, name), confidence.when(condition, score), source.when(condition, origin)
        details = details.when(condition, F.to_json(F.struct(*names)) if names else F.lit("{}"))
    return rows.select(
        "segment_id", "mmsi", "segment_start", "segment_end", label.otherwise("Unknown").alias("situation_label"), confidence.otherwise(t.unknown_confidence).cast("double").alias("label_confidence"),
        source.otherwise("default").alias("label_source"), details.otherwise("{}").alias("rule_details"),
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("situation_label").agg(F.count("*").alias("n"))
