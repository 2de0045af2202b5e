"""Situations as English text; facts that are missing say n/a.

Facts of a segment (distance to the boundary, mean speed) come from the segment of the
vessel that shares most time with the situation, where features are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeflow.functions import exprs as X
from wakeflow.operators.features import buckets

#: facts of features that reports mention
FACTS = ("distance_to_boundary", "avg_speed")


def _first(kind: str) -> Column:
    """The first supporting event of a type, or null."""
    return F.get(F.filter("supporting_events", lambda e: e["event_type"] == kind), F.lit(0))


def _minutes(kind: str) -> Column:
    return F.aggregate(F.filter("supporting_events", lambda e: e["event_type"] == kind), F.lit(0.0), lambda a, e: a + e["duration_minutes"])


def with_facts(situations: DataFrame, features: DataFrame, bucket_minutes: int = 1440) -> DataFrame:
    """``situations`` with the facts of the segment that shares most time with each; the earliest, then by name, on ties; null where none meets it.

    Both sides meet in time buckets; a situation is told by all it is but its events.
    """
    key = ["mmsi", "situation", "start_timestamp", "end_timestamp"]
    s = situations.select(*key, buckets("start_timestamp", "end_timestamp", bucket_minutes).alias("bucket"))
    g = features.select(F.col("mmsi").alias("g_mmsi"), "segment_id", "segment_start", "segment_end", *FACTS, buckets("segment_start", "segment_end", bucket_minutes).alias("g_bucket"))
    met = s.join(g, (F.col("mmsi") == F.col("g_mmsi")) & (F.col("bucket") == F.col("g_bucket")) & X.overlaps("start_timestamp", "end_timestamp", "segment_start", "segment_end"))
    order = F.struct(-X.overlap_minutes("start_timestamp", "end_timestamp", "segment_start", "segment_end"), "segment_start", "segment_id")
    best = met.groupBy(*key).agg(F.min_by(F.struct(*FACTS), order).alias("facts"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in key], *[F.col(f"facts.{c}").alias(c) for c in FACTS])
    same = [situations[c].eqNullSafe(best[f"_{c}"]) for c in key]
    return situations.join(best, same[0] & same[1] & same[2] & same[3], "left").drop(*[f"_{c}" for c in key])


def report_text(situations: DataFrame) -> Column:
    """One sentence or two for each kind of situation; with the facts of features where ``situations`` has their columns."""
    known = lambda c, form: F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c))).otherwise("") if c in situations.columns else F.lit("")
    value = lambda c, form: F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_string(form, c))
    who = F.concat(F.lit("Vessel "), F.col("mmsi").cast("string"))
    when = F.date_format("start_timestamp", "yyyy-MM-dd HH:mm")
    count = lambda kind: F.size(F.filter("supporting_events", lambda e: e["event_type"] == kind))
    detail = lambda kind, name: _first(kind)["details"][name]
    hours = (F.unix_micros("end_timestamp") - F.unix_micros("start_timestamp")) / F.lit(3.6e9)
    texts = {
        "Anchorage": F.concat(who, F.lit(" anchored for "), value(_minutes("ANCHOR") / 60, "%.1f"), F.lit(" hours from "), when, F.lit(" at a mean speed of "), value(detail("ANCHOR", "mean_speed_knots"), "%.2f"), F.lit(" knots.")),
        "Prolonged Boundary Presence": F.concat(who, F.lit(" entered the zone at "), when, F.lit(" and loitered "), count("LOITER").cast("string"), F.lit(" times, "), value(_minutes("LOITER") / 60, "%.1f"), F.lit(" hours in all"), known("distance_to_boundary", ", %.1f km from the boundary"), F.lit(".")),
        "Repeated Crossing": F.concat(who, F.lit(" crossed the boundary "), value(detail("REPEATED_CROSSING", "crossing_count"), "%d"), F.lit(" times within "), value(detail("REPEATED_CROSSING", "window_hours"), "%d"), F.lit(" hours up to "), when, F.lit(".")),
        "Boundary Crossing": F.concat(who, F.lit(" entered the zone at "), when, F.when(count("EXIT") > 0, F.concat(F.lit(" and left after "), value(hours, "%.1f"), F.lit(" hours."))).otherwise(F.lit("; no exit was seen."))),
        "Maneuvering": F.concat(who, F.lit(" changed heading strongly from "), when, F.lit(" (circular variance "), value(detail("MANEUVERING", "heading_circular_variance"), "%.2f"), F.lit(").")),
        "Transit": F.concat(who, F.lit(" passed through the zone from "), when, F.lit(" in "), value(hours, "%.1f"), F.lit(" hours"), known("avg_speed", " at a mean speed of %.1f knots"), F.lit(".")),
    }
    out = F.when(F.lit(False), F.lit(None))
    for kind, text in texts.items():
        out = out.when(F.col("situation") == kind, text)
    return out.otherwise(F.concat(who, F.lit(": "), F.col("situation"), F.lit(" from "), when, F.lit(".")))


def report_lines(situations: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """mmsi, situation, start_timestamp, end_timestamp, report."""
    situations = situations if features is None else with_facts(situations, features)
    return situations.select("mmsi", "situation", "start_timestamp", "end_timestamp", report_text(situations).alias("report"))
