"""Evaluation and map queries: distributions, ratios, as-of joins, top-1 interval joins, confusion metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeflow.functions import exprs as X
from wakeflow.operators import pieces, simplify
from wakeflow.operators.features import buckets

#: Event types of a distribution, in order.
EVENT_TYPES = ("ENTRY", "EXIT", "ANCHOR", "LOITER", "MANEUVERING", "REPEATED_CROSSING")


def event_distribution(events: DataFrame, types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """event_type, n, percent over a fixed list, zeros included."""
    spark = events.sparkSession
    listed = spark.createDataFrame([(t,) for t in types], "event_type string")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    rows = listed.join(counts, "event_type", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())  # as many rows as types
    return rows.select("event_type", "n", (100.0 * X.ratio("n", total)).alias("percent"))


def reduction(points: DataFrame, events: DataFrame) -> DataFrame:
    """points, events, reduction_percent and events per thousand points: one row."""
    both = points.agg(F.count("*").alias("points")).crossJoin(events.agg(F.count("*").alias("events")))
    return both.select("points", "events", (100 * X.ratio(F.col("points") - F.col("events"), "points")).alias("reduction_percent"), (1000 * X.ratio("events", "points")).alias("events_per_1000"))


def compression(segment_points: DataFrame) -> DataFrame:
    """points, segments and 1 - 2 * segments / points: one row."""
    return segment_points.agg(F.count("*").alias("points"), F.count_distinct("segment_id").alias("segments")).withColumn("compression_ratio", 1 - X.ratio(2 * F.col("segments"), "points"))


def top_vessels(points: DataFrame, k: int) -> DataFrame:
    """The k vessels with most points, with rank from 0 and a colour number."""
    counts = points.groupBy("MMSI").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "MMSI").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "MMSI")) - 1  # k rows
    return counts.withColumn("rank", rank).withColumn("palette_index", F.pmod("rank", F.lit(10)))


def downsample(points: DataFrame, target: int = 300) -> DataFrame:
    """Every N-th point of each vessel in time order, N = max(1, n // target)."""
    vessel = Window.partitionBy("MMSI")
    rows = points.withColumns({"_i": F.row_number().over(vessel.orderBy("timestamp")) - 1, "_step": F.greatest(F.lit(1), F.floor(F.count("*").over(vessel) / target))})
    return rows.filter(F.pmod("_i", "_step") == 0).drop("_i", "_step")


def top_vessel_tracks(points: DataFrame, k: int, target: int = 300) -> DataFrame:
    """The points of the k vessels with most points, thinned to about ``target`` each, with the vessel's rank."""
    top = top_vessels(points, k).select("MMSI", "rank")
    return downsample(points.join(F.broadcast(top), "MMSI"), target)  # k rows


def vessel_paths(points: DataFrame, part: int = 10_000) -> DataFrame:
    """MMSI, part (from 0) and the places of that part in time order as one array of at most so many; of rows with a vessel, time and place."""
    rows = simplify.numbered(points).withColumn("part", F.floor(F.col("i") / F.lit(part)))
    place = F.struct(F.col("y").alias("latitude"), F.col("x").alias("longitude"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("i", place.alias("p")))), lambda x: x["p"])
    return rows.groupBy("MMSI", "part").agg(path.alias("path"))


def segment_endpoints(segment_points: DataFrame) -> DataFrame:
    """MMSI, segment_id, number (of the segment in the vessel's, by start) and the first and last place of each segment."""
    one = segment_points.groupBy("MMSI", "segment_id").agg(*[f(c, "timestamp").alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in ("timestamp", "latitude", "longitude")])
    return one.withColumn("number", F.row_number().over(Window.partitionBy("MMSI").orderBy("first_timestamp", "segment_id")))  # segments of a vessel


def bounds(points: DataFrame) -> DataFrame:
    """One row: box and centre of all points."""
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def nearest_points(events: DataFrame, points: DataFrame, event_key: str = "event_id", minutes: int | None = None) -> DataFrame:
    """Each event with the place of its vessel's nearest point in whole seconds, the earlier on ties.

    Events and points are laid in one order per vessel and piece of time; the last point
    before and the first after come from windows, so no pairs are formed. Where a piece
    has none, the last point of the pieces before it and the first of those after it are
    carried over by a summary of one row a piece.
    """
    p = points.select(F.col("MMSI").alias("mmsi"), F.col("timestamp").alias("t"), F.lit(0).alias("kind"), F.struct(F.col("timestamp").alias("t"), "latitude", "longitude").alias("p"), F.lit(None).cast(dict(events.dtypes)[event_key]).alias(event_key))
    e = events.select("mmsi", F.col("event_timestamp").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), event_key)
    rows = p.unionByName(e).withColumns({"sec": F.unix_seconds("t"), "piece": pieces.piece("t", minutes)})  # pieces are whole minutes: none cuts a second
    line = Window.partitionBy("mmsi", "piece").orderBy("sec", "kind", "t")
    # of several points in a second, the first; all of them stand before the second's events
    head = F.when(F.col("kind") == 0, F.coalesce(F.lag("sec").over(line) != F.col("sec"), F.lit(True)))
    rows = rows.withColumn("p", F.when(head, F.col("p")))
    before = F.last("p", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("p", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    near = rows.withColumns({"before": before, "after": after}).filter("kind = 1")
    ends = rows.groupBy("mmsi", "piece").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("sec"))).alias("first"), F.max_by("p", F.when(F.col("p").isNotNull(), F.col("sec"))).alias("last"))
    track = Window.partitionBy("mmsi").orderBy("piece")
    last, first = F.last("last", ignorenulls=True).over(track.rowsBetween(Window.unboundedPreceding, -1)), F.first("first", ignorenulls=True).over(track.rowsBetween(1, Window.unboundedFollowing))
    near = near.join(ends.select("mmsi", "piece", last.alias("carried"), first.alias("coming")), ["mmsi", "piece"])
    near = near.withColumns({"before": F.coalesce("before", "carried"), "after": F.coalesce("after", "coming")})
    gap = lambda c: F.abs(F.unix_seconds(f"{c}.t") - F.col("sec"))
    best = F.when(F.col("before").isNull() | (gap("after") < gap("before")), F.col("after")).otherwise(F.col("before"))
    return near.select(event_key, "mmsi", F.col("t").alias("event_timestamp"), best["t"].alias("point_timestamp"), best["latitude"].alias("latitude"), best["longitude"].alias("longitude"))


def best_situation(segments: DataFrame, situations: DataFrame, kinds: Sequence[str], buffer_minutes: int = 15, bucket_minutes: int = 1440) -> DataFrame:
    """segment_id and the most confident situation of the kinds that meets it, widened by the buffer; the first by start and name on ties.

    Both sides are dealt to time buckets; a pair that meets in several of them is the same
    pair, and the best is taken all the same.
    """
    wide = F.expr(f"interval {int(buffer_minutes)} minutes")
    s = situations.filter(F.col("situation").isin(*kinds)).select(F.col("mmsi").alias("s_mmsi"), "situation", "confidence", F.col("start_timestamp").alias("t"), (F.col("start_timestamp") - wide).alias("s"), (F.col("end_timestamp") + wide).alias("e"))
    s = s.select("*", buckets("s", "e", bucket_minutes).alias("s_bucket"))
    g = segments.select("segment_id", "mmsi", "segment_start", "segment_end", buckets("segment_start", "segment_end", bucket_minutes).alias("bucket"))
    met = g.join(s, (F.col("mmsi") == F.col("s_mmsi")) & (F.col("bucket") == F.col("s_bucket")) & X.overlaps("segment_start", "segment_end", "s", "e"))
    best = met.groupBy("segment_id").agg(F.min_by(F.struct("situation", "confidence"), F.struct(-F.col("confidence"), "t", "situation")).alias("b"))
    return segments.select("segment_id").join(best, "segment_id", "left").select("segment_id", F.col("b.situation").alias("situation"), F.col("b.confidence").alias("confidence"))


def chord_deviation(segment_points: DataFrame) -> DataFrame:
    """segment_id, mean and max distance of its points from the chord (km), and from the chord's place at their time."""
    one = Window.partitionBy("segment_id").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kx, ky = F.cos(F.radians("latitude")) * 111.32, F.lit(110.57)
    rows = segment_points.withColumns({f"{n}_{c}": f(c).over(one) for c in ("latitude", "longitude", "timestamp") for n, f in (("a", F.first), ("b", F.last))})
    dx, dy = (F.col("b_longitude") - F.col("a_longitude")) * kx, (F.col("b_latitude") - F.col("a_latitude")) * ky
    px, py = (F.col("longitude") - F.col("a_longitude")) * kx, (F.col("latitude") - F.col("a_latitude")) * ky
    square = dx * dx + dy * dy
    t = X.clip(F.coalesce((px * dx + py * dy) / F.when(square > 0, square), F.lit(0.0)), 0.0, 1.0)
    span = X.micros("b_timestamp") - X.micros("a_timestamp")
    u = F.coalesce((X.micros("timestamp") - X.micros("a_timestamp")) / F.when(span > 0, span), F.lit(0.0))
    off = lambda w: F.sqrt(F.pow(px - w * dx, 2) + F.pow(py - w * dy, 2))
    rows = rows.withColumns({"spatial": off(t), "temporal": off(u)})
    return rows.groupBy("segment_id").agg(*[f(c).alias(f"{n}_{c}_km") for c in ("spatial", "temporal") for n, f in (("mean", F.avg), ("max", F.max))])


def confusion(predictions: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """truth and a column of counts per predicted class."""
    return predictions.groupBy(F.col(truth).alias("truth")).pivot(predicted, list(classes)).count().fillna(0)


def class_metrics(predictions: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """class, support, precision, recall, f1 of each listed class; divisions by zero give 0."""
    spark = predictions.sparkSession
    pairs = predictions.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    listed = spark.createDataFrame([(c,) for c in classes], "class string")
    rows = listed.join(pairs, (F.col("class") == F.col("t")) | (F.col("class") == F.col("p")), "left").groupBy("class").agg(
        F.coalesce(F.sum(F.when((F.col("t") == F.col("class")) & (F.col("p") == F.col("class")), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("t") == F.col("class"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col("p") == F.col("class"), F.col("n"))), F.lit(0)).alias("said"),
    )
    rows = rows.withColumns({"precision": X.ratio("tp", "said"), "recall": X.ratio("tp", "support")})
    return rows.withColumn("f1", X.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall_metrics(predictions: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro and weighted precision, recall and F1, Cohen's kappa, Matthews correlation."""
    rows = class_metrics(predictions, truth, predicted, classes)
    total = predictions.agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(predicted)).alias("right"))
    per = rows.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[X.ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        F.sum(F.col("support").cast("double") * F.col("said")).alias("st"), F.sum(F.pow("support", 2)).alias("tt"), F.sum(F.pow("said", 2)).alias("ss"),
    )
    one = total.crossJoin(per)
    n, right = F.col("n").cast("double"), F.col("right").cast("double")
    kappa = X.ratio(n * right - F.col("st"), n * n - F.col("st"))
    mcc = X.ratio(n * right - F.col("st"), F.sqrt((n * n - F.col("tt")) * (n * n - F.col("ss"))))
    return one.select(X.ratio(right, n).alias("accuracy"), "balanced_accuracy", *[f"{a}_{b}" for a in ("macro", "weighted") for b in ("precision", "recall", "f1")], kappa.alias("cohen_kappa"), mcc.alias("mcc"))


def hybrid(predictions: DataFrame, situation: str, activity: str) -> DataFrame:
    """The situation if there is one, else the classifier's activity."""
    return predictions.withColumn("hybrid_prediction", F.coalesce(situation, activity))


def _ranked(rows: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """``rows`` with _n, the number of the row in its group (from 1) by a seeded digest of its key, and _all, the rows of the group.

    A group is dealt by the head of the digest, so one with most of the rows is shared by
    256 tasks; what stands before each part comes from a count of the parts.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    rows = rows.withColumn("_digest", digest).withColumn("_part", F.coalesce(F.substring("_digest", 1, 2), F.lit("")))
    parts = rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("_size"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_all": F.sum("_size").over(whole)}).drop("_size")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_digest", key)))
    rows = rows.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return rows.withColumn("_n", F.col("_n") + F.col("_before")).drop("_digest", "_part", "_group", "_of", "_before")


def sample_groups(rows: DataFrame, group: str, key: str, cap: int, seed: int = 42, capped: Sequence[str] | None = None) -> DataFrame:
    """At most ``cap`` rows of each group (or of the listed groups), by a seeded digest; nulls of the group are dropped."""
    keep = F.col("_n") <= cap
    rows = _ranked(rows.filter(F.col(group).isNotNull()), group, key, seed)
    return rows.filter(keep if capped is None else keep | ~F.col(group).isin(*capped)).drop("_n", "_all")


def stratified_split(rows: DataFrame, label: str, key: str, fractions: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``rows`` with split: train, validation or test, in these shares of each label."""
    at = (F.col("_n") - 0.5) / F.col("_all")
    split = F.when(at <= fractions[0], "train").when(at <= fractions[0] + fractions[1], "validation").otherwise("test")
    return _ranked(rows, label, key, seed).withColumn("split", split).drop("_n", "_all")


def vessel_split(rows: DataFrame, fraction: float = 0.15, seed: int = 42, vessel: str = "mmsi") -> DataFrame:
    """``rows`` with split: whole vessels in test, max(1, int(n * fraction)) of them."""
    ids = rows.select(vessel).distinct()
    n = max(1, int(ids.count() * fraction))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(vessel).cast("string")).cast("binary"))
    test = ids.orderBy(digest, vessel).limit(n).withColumn("split", F.lit("test"))
    return rows.join(test, vessel, "left").fillna("train", ["split"])


def comparison_table(spark: SparkSession, prior: list[dict], computed: DataFrame, digits: int = 2) -> DataFrame:
    """Literal rows of prior work above one computed row, numbers rounded."""
    kinds = dict(computed.dtypes)
    literal = spark.createDataFrame([tuple(r.get(c) for c in computed.columns) for r in prior], computed.schema) if prior else computed.limit(0)
    out = literal.unionByName(computed)
    return out.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in computed.columns])
