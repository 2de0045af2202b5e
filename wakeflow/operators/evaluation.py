"""Evaluation of classifiers and of the reasoner: label maps, rule hits, predictions side by side, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeflow.config import LabelThresholds
from wakeflow.functions import exprs as X
from wakeflow.operators.analytics import best_situation, hybrid
from wakeflow.operators.clean import require

# Label maps of the evaluation.
#: situations to the activities that a classifier learns; others to none
SITUATION_TO_ACTIVITY = {
    "Anchorage": "Anchorage",
    "Transit": "Transit",
    "Boundary Crossing": "Transit",
    "Prolonged Boundary Presence": "Transit",
    "Repeated Crossing": "Transit",
    "Fishing Activity": "Fishing Activity",
}
#: the reasoner's situations to a classifier's classes
REASONER_TO_CLASS = {
    "Anchorage": "Anchorage",
    "Prolonged Boundary Presence": "Prolonged Boundary Presence",
    "Repeated Crossing": "Boundary Crossing",
    "Boundary Crossing": "Boundary Crossing",
    "Transit": "Transit",
    "Maneuvering": "Transit",
}
ACTIVITY_CLASSES = ("Transit", "Anchorage", "Fishing Activity")
SITUATION_CLASSES = ("Boundary Crossing", "Prolonged Boundary Presence", "None")


def remap(label: Column | str, names: Mapping[str, str], default: str | None = None) -> Column:
    """The label's new name; one that has none becomes ``default``, null stays null without one."""
    label = F.col(label) if isinstance(label, str) else label
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), label)
    return found if default is None else F.coalesce(found, F.lit(default))


def activity_of(label: Column | str) -> Column:
    """Anchorage and Fishing Activity as they are, all else Transit."""
    return remap(label, {x: x for x in ("Anchorage", "Fishing Activity")}, "Transit")


def situation_of(label: Column | str) -> Column:
    """Crossings and prolonged presence as they are, all else None."""
    return remap(label, {x: x for x in SITUATION_CLASSES[:2]}, "None")


def profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, count, mean, std, min, quartiles and max of each column: one row a column, one aggregation."""
    one = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(F.col(c)).alias("mean"), F.stddev_samp(F.col(c)).alias("std"), F.min(F.col(c).cast("double")).alias("min"),
        *[F.percentile(F.col(c).cast("double"), q).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)], F.max(F.col(c).cast("double")).alias("max"),
    )
    return rows.agg(F.array(*[one(c) for c in columns]).alias("a")).select(F.inline("a"))


def rule_hits(features: DataFrame, t: LabelThresholds | None = None) -> DataFrame:
    """rule, hits: how many segments meet each single condition of the label rules."""
    t = t or LabelThresholds()
    rules = {
        f"avg_speed >= {t.transit_min_avg_speed:g}": X.settled("avg_speed") >= t.transit_min_avg_speed,
        f"anchor_duration >= {t.anchorage_min_anchor_duration_minutes:g}": X.settled("anchor_duration") >= t.anchorage_min_anchor_duration_minutes,
        f"loiter_duration >= {t.prolonged_boundary_min_loiter_duration_minutes:g}": X.settled("loiter_duration") >= t.prolonged_boundary_min_loiter_duration_minutes,
        f"crossing_count >= {t.boundary_crossing_min_crossings:g}": X.settled("crossing_count") >= t.boundary_crossing_min_crossings,
        f"distance_to_boundary <= {t.prolonged_boundary_max_distance_km:g}": X.settled("distance_to_boundary") <= t.prolonged_boundary_max_distance_km,
    }
    return features.agg(F.array(*[F.struct(F.lit(k).alias("rule"), F.count_if(c).alias("hits")) for k, c in rules.items()]).alias("a")).select(F.inline("a"))


def audit(labels: DataFrame, predictions: Mapping[str, DataFrame], situations: DataFrame, kinds: Sequence[str] = ("Boundary Crossing", "Prolonged Boundary Presence", "Repeated Crossing"), bucket_minutes: int = 1440) -> DataFrame:
    """Of labelled segments (segment_id, mmsi, segment_start, segment_end, situation_label) the truth and all predictions side by side.

    ``predictions``: by model name, segment_id and predicted activity. The situation is the
    reasoner's most confident one; ``proposed_predictions`` falls back on the first model.
    """
    require(labels, ["segment_id", "mmsi", "segment_start", "segment_end", "situation_label"], "labels")
    out = labels.select("segment_id", "mmsi", "segment_start", "segment_end", "situation_label", F.col("situation_label").alias("ground_truth"), activity_of("situation_label").alias("ground_truth_activity"), situation_of("situation_label").alias("ground_truth_situation"))
    found = best_situation(out, situations, kinds, bucket_minutes=bucket_minutes).select("segment_id", "situation")
    out = out.join(found, "segment_id", "left")
    for name, rows in predictions.items():
        out = out.join(rows.select("segment_id", F.col("predicted").alias(f"{name}_predicted_activity")), "segment_id", "left")
    out = hybrid(out, "situation", f"{next(iter(predictions))}_predicted_activity").withColumnRenamed("hybrid_prediction", "proposed_predictions")
    return out.withColumn("proposed_context_prediction", F.coalesce("situation", F.lit("None"))).drop("situation", "segment_start", "segment_end")


def context_metrics(audited: DataFrame) -> DataFrame:
    """One row: how many segments the reasoner says something of, and how often what."""
    said = F.col("proposed_context_prediction")
    count = lambda name: F.count_if(said == name)
    total, enriched = F.count("*"), F.count_if(said != "None")
    return audited.agg(
        total.alias("total_test_segments"), enriched.alias("enriched_segments"), F.coalesce(enriched / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("context_coverage_ratio"),
        count("Boundary Crossing").alias("boundary_crossing_situations_detected"), count("Prolonged Boundary Presence").alias("prolonged_presence_situations_detected"),
        count("Repeated Crossing").alias("repeated_crossing_situations_detected"),
    )
