"""Discrete events from points: anchoring, loitering, manoeuvring, repeated crossings.

Runs are numbered over pieces of the tracks (:mod:`wakeflow.operators.pieces`) and
aggregated, in part first, so a vessel with most of the points is shared by many tasks.
Only rows of runs and crossings, which are few, are windowed by vessel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.config import EventThresholds
from wakeflow.functions import exprs as X
from wakeflow.operators import pieces
from wakeflow.operators.clean import integer, moment, number, require

#: The details of an event, in order.
DETAILS = (
    "struct<speed_threshold_knots:double,mean_speed_knots:double,number_of_points:bigint,radius_threshold_km:double,observed_radius_km:double,"
    "window_minutes:int,heading_circular_variance:double,circular_variance_unit:string,circular_variance_threshold:double,point_coverage_ratio:double,min_point_coverage_ratio:double,"
    "crossing_count:bigint,crossing_threshold:int,window_hours:int>"
)
EVENT_COLUMNS = ["event_type", "event_timestamp", "mmsi", "start_timestamp", "end_timestamp", "duration_minutes", "details"]


def _details(**values: Column) -> Column:
    names = [f.split(":")[0] for f in DETAILS[7:-1].split(",")]
    return F.struct(*[values.get(n, F.lit(None)).alias(n) for n in names]).cast(DETAILS)


def prepare_points(points: DataFrame) -> DataFrame:
    require(points, ["MMSI", "timestamp", "latitude", "longitude", "speed", "heading"], "points")
    ts = F.col("timestamp") if dict(points.dtypes)["timestamp"] == "timestamp" else moment("timestamp")
    rows = points.select(integer("MMSI").alias("MMSI"), ts.alias("timestamp"), *[number(c).alias(c) for c in ("latitude", "longitude", "speed", "heading")])
    return rows.dropna(subset=["MMSI", "timestamp", "latitude", "longitude"])


def normalized_boundary_type(c: Column) -> Column:
    """ENTRY, EXIT or null."""
    name = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))
    return F.when(name.contains("entry") | (name == "enter"), "ENTRY").when(name.contains("exit") | (name == "leave"), "EXIT")


def boundary_sequence(boundary: DataFrame) -> DataFrame:
    """Zone entries and exits as events without duration."""
    rows = boundary.select(normalized_boundary_type(F.col("event_type")).alias("event_type"), F.col("event_timestamp"), integer("mmsi").alias("mmsi")).dropna()
    return rows.select("event_type", "event_timestamp", "mmsi", F.col("event_timestamp").alias("start_timestamp"), F.col("event_timestamp").alias("end_timestamp"), F.lit(0.0).alias("duration_minutes"), _details().alias("details"))


def runs(points: DataFrame, below_knots: float, max_gap_minutes: float) -> DataFrame:
    """The points slower than the threshold, with run_id: a run ends where a point is not slow or a gap is longer than allowed."""
    return _numbered(points, {"run": below_knots}, max_gap_minutes).withColumnRenamed("run_id_run", "run_id").filter("slow_run").drop("slow_run", "origin")


def _numbered(points: DataFrame, limits: dict[str, float], max_gap_minutes: float) -> DataFrame:
    """``points`` with slow_x and run_id_x for each named limit, and origin, the time of the track's first heading, by one sort of its pieces."""
    rows = points.withColumns({f"slow_{x}": F.coalesce(F.col("speed") < below, F.lit(False)) for x, below in limits.items()})
    return pieces.runs(rows, "MMSI", "timestamp", [f"slow_{x}" for x in limits], max_gap_minutes, since=F.col("heading").isNotNull()).withColumnsRenamed({f"run_slow_{x}": f"run_id_{x}" for x in limits})


def _track_runs(points: DataFrame, t: EventThresholds, kinds: Sequence[str]) -> DataFrame:
    """kind, MMSI, s, e, v (mean speed), n (points), km (radius), variance (of headings), coverage, m (minutes) of the runs and windows that make events of the kinds."""
    limits = {k: v for k, v in (("ANCHOR", t.anchor_speed_knots), ("LOITER", t.loiter_speed_knots)) if k in kinds}
    rows = _numbered(points, limits, t.max_ais_gap_minutes)
    member = [(k, F.col(f"slow_{k}"), F.col(f"run_id_{k}")) for k in limits]
    if "MANEUVERING" in kinds:  # windows from the vessel's first heading on
        has = F.col("heading").isNotNull()
        member.append(("MANEUVERING", has, F.floor((X.micros("timestamp") - X.micros("origin")) / F.lit(t.maneuver_window_minutes * 60_000_000))))
    runs_of = F.array(*[F.when(on, F.struct(F.lit(k).alias("kind"), run.cast("long").alias("run"))) for k, on, run in member])
    rows = rows.select("MMSI", "timestamp", "latitude", "longitude", "speed", "heading", F.explode(F.filter(runs_of, lambda x: x.isNotNull())).alias("of")).select("*", "of.*")
    key = ["MMSI", "kind", "run"]
    out = rows.groupBy(*key).agg(
        F.min("timestamp").alias("s"), F.max("timestamp").alias("e"), F.avg("speed").alias("v"), F.count("*").alias("n"), X.circular_variance("heading").alias("variance"), F.avg("latitude").alias("clat"), F.avg("longitude").alias("clon")
    )
    span = F.least(F.lit(1.0), X.minutes_between("e", "s") / F.lit(float(t.maneuver_window_minutes)))
    filled = F.least(F.lit(1.0), F.col("n") / F.lit(float(max(1, int(t.maneuver_min_points)))))
    out = out.withColumns({"m": X.minutes_between("e", "s"), "coverage": F.least(span, filled)})
    kind, keep = F.col("kind"), F.lit(False)
    keep |= (kind == "ANCHOR") & (F.col("m") > t.anchor_min_duration_minutes)
    keep |= (kind == "LOITER") & (F.col("m") > t.loiter_min_duration_minutes)
    scattered = F.col("variance") >= t.maneuver_heading_circular_variance_threshold
    keep |= (kind == "MANEUVERING") & (F.col("n") >= t.maneuver_min_points) & (F.col("coverage") >= min(1.0, max(0.0, t.maneuver_min_point_coverage_ratio))) & scattered
    out = out.filter(keep)
    if "LOITER" in kinds:  # how far the points of a run that is long enough are from its middle: points meet runs, runs are never one task's
        middle = out.filter(kind == "LOITER").select("MMSI", "run", "clat", "clon")
        wide = rows.filter(kind == "LOITER").select("MMSI", "run", "latitude", "longitude").join(middle, ["MMSI", "run"])
        wide = wide.groupBy("MMSI", "run").agg(F.max(X.haversine_km("clat", "clon", "latitude", "longitude")).alias("km")).withColumn("kind", F.lit("LOITER"))
        out = out.join(wide, key, "left").filter((kind != "LOITER") | (F.col("km") <= t.loiter_radius_km))
    else:
        out = out.withColumn("km", F.lit(None).cast("double"))
    return out.drop("run", "clat", "clon")


def _not_anchored(rows: DataFrame) -> DataFrame:
    """``rows`` without the loitering that meets an anchoring of its vessel.

    Anchorings stand at their start and loiterings at their end, so the latest end of
    the anchorings before a loitering tells whether one meets it: no pairs are formed.
    """
    loiter = F.col("kind") == "LOITER"
    before = Window.partitionBy("MMSI").orderBy(F.when(loiter, F.col("e")).otherwise(F.col("s")), loiter.cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("anchored", F.max(F.when(F.col("kind") == "ANCHOR", F.col("e"))).over(before))
    return rows.filter(~loiter | F.col("anchored").isNull() | (F.col("anchored") < F.col("s"))).drop("anchored")


def as_events(rows: DataFrame, t: EventThresholds) -> DataFrame:
    """Rows of kind, MMSI, s, e, v, n, km, variance, coverage, m as events. Repeated crossings stand at the last of them, all others at their start."""
    only = lambda kinds, x: F.when(F.col("kind").isin(*kinds), x)
    slow, turn, again = ("ANCHOR", "LOITER"), ("MANEUVERING",), ("REPEATED_CROSSING",)
    details = _details(
        speed_threshold_knots=F.when(F.col("kind") == "ANCHOR", t.anchor_speed_knots).when(F.col("kind") == "LOITER", t.loiter_speed_knots),
        mean_speed_knots=only(slow, F.col("v")), number_of_points=only((*slow, *turn), F.col("n")), radius_threshold_km=only(("LOITER",), F.lit(t.loiter_radius_km)), observed_radius_km=only(("LOITER",), F.col("km")),
        window_minutes=only(turn, F.lit(t.maneuver_window_minutes)), heading_circular_variance=only(turn, F.col("variance")), circular_variance_unit=only(turn, F.lit("0-1")),
        circular_variance_threshold=only(turn, F.lit(t.maneuver_heading_circular_variance_threshold)), point_coverage_ratio=only(turn, F.col("coverage")), min_point_coverage_ratio=only(turn, F.lit(t.maneuver_min_point_coverage_ratio)),
        crossing_count=only(again, F.col("n")), crossing_threshold=only(again, F.lit(t.repeated_crossing_count)), window_hours=only(again, F.lit(t.repeated_crossing_window_hours)),
    )
    at = F.when(F.col("kind") == "REPEATED_CROSSING", F.col("e")).otherwise(F.col("s"))
    return rows.select(F.col("kind").alias("event_type"), at.alias("event_timestamp"), F.col("MMSI").alias("mmsi"), F.col("s").alias("start_timestamp"), F.col("e").alias("end_timestamp"), F.col("m").alias("duration_minutes"), details.alias("details"))


def anchor_events(points: DataFrame, t: EventThresholds | None = None) -> DataFrame:
    """Slow runs that are long enough."""
    t = t or EventThresholds()
    return as_events(_track_runs(points, t, ["ANCHOR"]), t)


def loiter_events(points: DataFrame, anchors: DataFrame, t: EventThresholds | None = None) -> DataFrame:
    """Slow runs inside a small circle that meet no anchoring of their vessel."""
    t = t or EventThresholds()
    found = _track_runs(points, t, ["LOITER"])
    given = anchors.select(F.col("mmsi").alias("MMSI"), F.lit("ANCHOR").alias("kind"), F.col("start_timestamp").alias("s"), F.col("end_timestamp").alias("e"))
    return as_events(_not_anchored(found.unionByName(given, allowMissingColumns=True)).filter("kind = 'LOITER'"), t)


def maneuver_events(points: DataFrame, t: EventThresholds | None = None) -> DataFrame:
    """Windows anchored at a vessel's first heading whose headings scatter."""
    t = t or EventThresholds()
    return as_events(_track_runs(points, t, ["MANEUVERING"]), t)


def _counted(crossings: DataFrame, t: EventThresholds) -> DataFrame:
    """Crossings with n, the crossings of the hours up to each, s, the first of them, and ``repeated`` where they are too many: for the first crossing of an instant that makes them so.

    A range frame holds peers of the same instant, a row count up to this row must not:
    the window's first row number is taken over the range, then subtracted.
    """
    order = Window.partitionBy("mmsi").orderBy("event_timestamp", "event_type")
    rows = crossings.withColumns({"us": X.micros("event_timestamp"), "rn": F.row_number().over(order), "before": F.lag("event_timestamp").over(order)})
    window = Window.partitionBy("mmsi").orderBy("us").rangeBetween(-t.repeated_crossing_window_hours * 3_600_000_000, 0)
    rows = rows.withColumns({"n": F.col("rn") - F.min("rn").over(window) + 1, "s": F.min("event_timestamp").over(window)})
    told = F.col("before").eqNullSafe(F.col("event_timestamp")) & (F.col("n") - 1 > t.repeated_crossing_count)
    return rows.withColumn("repeated", (F.col("n") > t.repeated_crossing_count) & ~told)


def _repeated(t: EventThresholds) -> Column:
    """The event of a crossing that :func:`_counted` marks, as a struct."""
    details = _details(crossing_count=F.col("n"), crossing_threshold=F.lit(t.repeated_crossing_count), window_hours=F.lit(t.repeated_crossing_window_hours))
    values = [F.lit("REPEATED_CROSSING"), F.col("event_timestamp"), F.col("mmsi"), F.col("s"), F.col("event_timestamp"), X.minutes_between("event_timestamp", "s"), details]
    return F.struct(*[v.alias(c) for v, c in zip(values, EVENT_COLUMNS, strict=True)])


def repeated_crossings(boundary: DataFrame, t: EventThresholds | None = None) -> DataFrame:
    """Every crossing that ends a window of the given hours with more than the given number of crossings."""
    t = t or EventThresholds()
    return _counted(boundary, t).filter("repeated").select(_repeated(t).alias("x")).select("x.*")


def event_sequence(points: DataFrame, boundary: DataFrame, t: EventThresholds | None = None) -> DataFrame:
    """All events of all vessels; sort by (event_timestamp, mmsi, event_type) where order matters.

    One pass over the points and one over the crossings, each shuffled once by vessel.
    """
    t = t or EventThresholds()
    tracks = as_events(_not_anchored(_track_runs(prepare_points(points), t, ["ANCHOR", "LOITER", "MANEUVERING"])), t)
    both = F.array(F.struct(*EVENT_COLUMNS), F.when(F.col("repeated"), _repeated(t)))
    crossings = _counted(boundary_sequence(boundary), t).select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("x.*")
    return crossings.unionByName(tracks)
