"""Zone entries and exits: classification of points and transitions per vessel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.functions import geometry
from wakeflow.operators import pieces
from wakeflow.operators.clean import integer, moment, number, require

BOUNDARY_SCHEMA = "event_type string, event_timestamp timestamp, mmsi long"


def prepare_points(points: DataFrame) -> DataFrame:
    """Coerced points with all of vessel, time and place."""
    require(points, ["MMSI", "timestamp", "latitude", "longitude"], "points")
    ts = F.col("timestamp") if dict(points.dtypes)["timestamp"] == "timestamp" else moment("timestamp")
    out = points.withColumns({"MMSI": integer("MMSI"), "timestamp": ts, "latitude": number("latitude"), "longitude": number("longitude")})
    return out.dropna(subset=["MMSI", "timestamp", "latitude", "longitude"])


def classify(points: DataFrame, edges: DataFrame) -> DataFrame:
    return geometry.mark_inside(prepare_points(points), edges, ["MMSI", "timestamp"])


def transitions(classified: DataFrame) -> DataFrame:
    """event_type ('EEZ entry' or 'EEZ exit'), event_timestamp, mmsi wherever the flag differs from the vessel's previous point."""
    rows = pieces.previous(classified.select("MMSI", "timestamp", "inside_eez"), "MMSI", "timestamp", ["inside_eez"], "_before")
    rows = rows.withColumn("_before", F.col("_before.inside_eez")).filter(F.col("_before").isNotNull() & (F.col("_before") != F.col("inside_eez")))
    kind = F.when(F.col("inside_eez"), "EEZ entry").otherwise("EEZ exit")
    return rows.select(kind.alias("event_type"), F.col("timestamp").alias("event_timestamp"), F.col("MMSI").alias("mmsi"))


def boundary_events(points: DataFrame, edges: DataFrame) -> DataFrame:
    return transitions(classify(points, edges))


def transitions_with_state(classified: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transitions of a batch that continues from ``states`` (mmsi, inside), and the states after it."""
    seed = states.select(F.col("mmsi").alias("MMSI"), F.lit("0001-01-01").cast("timestamp").alias("timestamp"), F.col("inside").alias("inside_eez"))
    rows = classified.select("MMSI", "timestamp", "inside_eez").unionByName(seed)  # the first of all times
    latest = rows.groupBy("MMSI").agg(F.max_by("inside_eez", "timestamp").alias("inside"))
    return transitions(rows), latest.select(F.col("MMSI").alias("mmsi"), "inside")
