"""Daily fishing effort as interval labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.functions import exprs as X
from wakeflow.operators.clean import find_column, integer, moment, number
from wakeflow.operators.features import buckets

#: Names under which effort tables carry vessel, day and hours.
VESSEL_NAMES = ["mmsi", "ssvid", "vessel_mmsi"]
DAY_NAMES = ["date", "day", "timestamp", "date_utc"]
HOUR_NAMES = ["fishing_hours", "apparent_fishing_hours", "fishing_hours_sum", "hours"]

DAY_MINUTES = 1440


def effort_to_labels(effort: DataFrame, min_hours: float = 0.1) -> DataFrame:
    """mmsi, start_timestamp, end_timestamp (one day), is_fishing, fishing_hours, label_confidence."""
    vessel, day, hours = (find_column(effort, names) for names in (VESSEL_NAMES, DAY_NAMES, HOUR_NAMES))
    ts = F.col(day).cast("timestamp") if dict(effort.dtypes)[day] in ("timestamp", "date") else moment(day)
    rows = effort.select(integer(vessel).alias("mmsi"), F.date_trunc("day", ts).alias("start_timestamp"), number(hours).alias("fishing_hours")).dropna()
    rows = rows.filter(F.col("fishing_hours") >= min_hours)
    confidence = F.least(F.lit(0.70) + X.clip("fishing_hours", 0.0, 6.0) / 6 * 0.25, F.lit(0.95))
    return rows.select("mmsi", "start_timestamp", (F.col("start_timestamp") + F.expr("interval 1 day")).alias("end_timestamp"), F.lit(True).alias("is_fishing"), "fishing_hours", confidence.alias("label_confidence"))


def prepare_labels(labels: DataFrame) -> DataFrame:
    """Fishing rows only, by is_fishing, else label, else event_type, else all."""
    if "is_fishing" in labels.columns:
        flag = F.coalesce(F.col("is_fishing").cast("boolean"), F.lit(False))
    elif "label" in labels.columns:
        flag = F.lower(F.trim("label")) == "fishing"
    elif "event_type" in labels.columns:
        flag = F.lower("event_type").contains("fishing")
    else:
        flag = F.lit(True)
    rows = labels.filter(flag)
    if "segment_id" in labels.columns:
        return rows.select("segment_id").dropna().distinct()
    missing = {"mmsi", "start_timestamp", "end_timestamp"} - set(labels.columns)
    if missing:
        raise ValueError(f"fishing labels need segment_id, or {', '.join(sorted(missing))}")
    return rows.select(integer("mmsi").alias("mmsi"), F.col("start_timestamp").cast("timestamp").alias("start_timestamp"), F.col("end_timestamp").cast("timestamp").alias("end_timestamp")).dropna()


def fishing_segments(features: DataFrame, labels: DataFrame) -> DataFrame:
    """segment_id of the segments that a fishing label names or meets (ends inclusive)."""
    labels = prepare_labels(labels)
    if "segment_id" in labels.columns:
        return features.select("segment_id").join(labels, "segment_id", "left_semi")
    # both sides by day, so that a vessel's labels meet only the segments of their days
    f = labels.select(F.col("mmsi").alias("f_mmsi"), F.col("start_timestamp").alias("f_s"), F.col("end_timestamp").alias("f_e"), buckets("start_timestamp", "end_timestamp", DAY_MINUTES).alias("f_day"))
    s = features.select("segment_id", "mmsi", "segment_start", "segment_end", buckets("segment_start", "segment_end", DAY_MINUTES).alias("day"))
    hit = (F.col("mmsi") == F.col("f_mmsi")) & (F.col("day") == F.col("f_day")) & X.overlaps("segment_start", "segment_end", "f_s", "f_e")
    return s.join(f, hit, "left_semi").select("segment_id").distinct()
