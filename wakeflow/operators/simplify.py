"""Exact Douglas-Peucker simplification of tracks of any length.

A track is cut into chunks of ``CHUNK`` points, each with its convex hull: the distance from
a segment is convex, so the farthest point of a whole chunk is on its hull. Rounds split
what is open for all tracks and tolerances at once: an interval meets the hulls of the
chunks inside it and the points of the two at its ends, finds its farthest point, and is
split there or closed. Intervals of at most CHUNK points are taken to their end in one step
each, from the one or two chunks that they lie in. No task sees more of a track than that.

Distances are in degrees, rounded to 1e-12; of equal ones the first point counts. A round
is a job, and there are about as many as halvings bring the longest track down to a chunk;
more where a track folds so that intervals are cut off at their ends.

Defined cases: a track of one or two points keeps them; equal places are points of their
own; rows without a vessel, time or place are left out; equal times of a vessel are ordered by place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.functions import exprs as X
from wakeflow.operators import pieces
from wakeflow.session import once

CHUNK = 4096
DIGITS = 12
POINTS = "array<struct<i:bigint,x:double,y:double>>"
_KEY = ["MMSI", "tolerance", "a", "b"]
_ENDS = ["ax", "ay", "bx", "by"]


def numbered(points: DataFrame) -> DataFrame:
    """MMSI, i (from 0, in time order), x, y: counted in pieces of time, so that no track is one task."""
    rows = points.select("MMSI", "timestamp", F.col("longitude").alias("x"), F.col("latitude").alias("y")).dropna().withColumn("piece", pieces.piece("timestamp"))
    sizes = rows.groupBy("MMSI", "piece").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("MMSI").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("MMSI", "piece").orderBy("timestamp", "x", "y")) - 1
    return rows.withColumn("own", own).join(sizes.select("MMSI", "piece", before.alias("base")), ["MMSI", "piece"]).select("MMSI", (F.col("base") + F.col("own")).alias("i"), "x", "y")


def distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From points to the segment a to b."""
    d = b - a
    square = float(d @ d)
    t = np.clip((p - a) @ d / square, 0, 1) if square else np.zeros(len(p))
    return np.round(np.hypot(*(p - (a + t[:, None] * d)).T), DIGITS)


def kept(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """The numbers of the points of a short track that stay."""
    on, stack = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
    on[[0, -1]] = True
    while stack:
        a, b = stack.pop()
        if b - a > 1:
            d = distance(xy[a + 1 : b], xy[a], xy[b])
            i = a + 1 + int(d.argmax())
            if d[i - a - 1] > tolerance:
                on[i] = True
                stack += [(a, i), (i, b)]
    return np.flatnonzero(on)


def hull(xy: np.ndarray) -> np.ndarray:
    """Numbers of the hull's corners; of equal places the first, and of points along a side also the first."""
    _, first = np.unique(xy, axis=0, return_index=True)  # by x, then y
    turn = lambda o, a, b: (xy[a, 0] - xy[o, 0]) * (xy[b, 1] - xy[o, 1]) - (xy[a, 1] - xy[o, 1]) * (xy[b, 0] - xy[o, 0])
    corners: list[int] = []
    for line in (first.tolist(), first[::-1].tolist()):
        half: list[int] = []
        for p in line:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        corners += half[:-1]
    corners = corners or [int(first[0])]
    out = set(corners)
    for a, b in zip(corners, [*corners[1:], corners[0]], strict=True):
        out.add(int(np.flatnonzero(distance(xy, xy[a], xy[b]) <= 10**-DIGITS)[0]))
    return np.array(sorted(out))


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, places and offsets of an array column of points."""
    flat = column.flatten()
    at = np.concatenate([[0], np.cumsum(np.array(column.value_lengths().fill_null(0)))])
    return flat.field("i").to_numpy(), np.stack([flat.field(c).to_numpy() for c in "xy"], axis=1), at


def _hulls(batches):
    for batch in batches:
        i, xy, at = _points(batch.column("p"))
        own = [a + hull(xy[a:b]) for a, b in zip(at, at[1:], strict=False)]
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        points = pa.StructArray.from_arrays([pa.array(i[flat]), pa.array(xy[flat, 0]), pa.array(xy[flat, 1])], ["i", "x", "y"])
        cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("MMSI"), batch.column("chunk"), pa.ListArray.from_arrays(cuts, points)], ["MMSI", "chunk", "p"])


def _finished(batches):
    """Of short intervals with their points: the numbers that stay and the sum of the others' distances."""
    for batch in batches:
        i, xy, at = _points(batch.column("p"))
        rows = []
        for lo, hi, a, b, tolerance in zip(at, at[1:], batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tolerance").to_pylist(), strict=False):
            own = slice(lo + int(np.searchsorted(i[lo:hi], a)), lo + int(np.searchsorted(i[lo:hi], b, "right")))
            on = kept(xy[own], tolerance)
            off = sum(float(distance(xy[own][s : e + 1], xy[own][s], xy[own][e]).sum()) for s, e in zip(on, on[1:], strict=False))
            rows.append((i[own][on].tolist(), off))
        yield pa.RecordBatch.from_arrays([batch.column("MMSI"), batch.column("tolerance"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.float64())], ["MMSI", "tolerance", "stay", "off"])


def _off(p: Column) -> Column:
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    t = X.clip(F.coalesce(((p["x"] - F.col("ax")) * dx + (p["y"] - F.col("ay")) * dy) / F.when(square > 0, square), F.lit(0.0)), 0.0, 1.0)
    return F.round(F.sqrt(F.pow(p["x"] - (F.col("ax") + t * dx), 2) + F.pow(p["y"] - (F.col("ay") + t * dy), 2)), DIGITS)


def _solved(points: DataFrame, tolerances: Sequence[float], size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ends of the tracks (MMSI, n); kept points (MMSI, tolerance, i), some several times; sums of distances (MMSI, tolerance, off)."""
    size_ = F.lit(size).cast("long")
    rows = numbered(points).withColumn("chunk", F.floor(F.col("i") / size_))
    chunks = once(rows.groupBy("MMSI", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p")))
    hulls = once(chunks.mapInArrow(_hulls, f"MMSI long, chunk long, p {POINTS}"))
    first, last = F.min_by(F.element_at("p", 1), "chunk"), F.max_by(F.element_at("p", -1), "chunk")
    ends = once(chunks.groupBy("MMSI").agg(first.alias("f"), last.alias("l")))
    open_ = ends.select("MMSI", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])).alias("tolerance"), F.col("f.i").alias("a"), F.col("l.i").alias("b"), F.col("f.x").alias("ax"), F.col("f.y").alias("ay"), F.col("l.x").alias("bx"), F.col("l.y").alias("by"))
    near, stay, closed = open_.filter(F.col("b") - F.col("a") <= size), open_.select("MMSI", "tolerance", F.explode(F.array("a", "b")).alias("i")), open_.limit(0)
    while True:
        far = open_.filter(F.col("b") - F.col("a") > size)
        if far.isEmpty():
            break
        spans = far.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("a") + 1) / size_), F.floor((F.col("b") - 1) / size_))))
        whole = (F.col("chunk") * size_ > F.col("a")) & ((F.col("chunk") + 1) * size_ - 1 < F.col("b"))
        best = lambda p: F.array_max(F.transform(p, lambda x: F.struct(_off(x).alias("d"), (-x["i"]).alias("i"), x["x"].alias("x"), x["y"].alias("y"))))
        inner = F.filter("p", lambda x: (x["i"] > F.col("a")) & (x["i"] < F.col("b")))
        met = spans.filter(whole).join(hulls, ["MMSI", "chunk"]).select(*_KEY, *_ENDS, best(F.col("p")).alias("m"))
        met = met.unionByName(spans.filter(~whole).join(chunks, ["MMSI", "chunk"]).select(*_KEY, *_ENDS, best(inner).alias("m")))
        found = once(met.groupBy(*_KEY, *_ENDS).agg(F.max("m").alias("m")))
        split = F.col("m.d") > F.col("tolerance")
        closed = closed.unionByName(found.filter(~split).select(*_KEY, *_ENDS))
        cut = found.filter(split).withColumn("i", -F.col("m.i"))
        stay = stay.unionByName(cut.select("MMSI", "tolerance", "i"))
        half = lambda a, ax, ay, b, bx, by: F.struct(*[F.col(c).alias(n) for c, n in zip((a, ax, ay, b, bx, by), ("a", "ax", "ay", "b", "bx", "by"), strict=True)])
        open_ = cut.select("MMSI", "tolerance", F.explode(F.array(half("a", "ax", "ay", "i", "m.x", "m.y"), half("i", "m.x", "m.y", "b", "bx", "by"))).alias("h")).select("MMSI", "tolerance", "h.*")
        near = near.unionByName(open_.filter(F.col("b") - F.col("a") <= size))
    held = near.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("a") / size_), F.floor(F.col("b") / size_)))).join(chunks, ["MMSI", "chunk"])
    held = held.groupBy(*_KEY).agg(F.flatten(F.sort_array(F.collect_list("p"))).alias("p"))  # two chunks at most
    done = once(held.mapInArrow(_finished, "MMSI long, tolerance double, stay array<long>, off double"))
    stay = stay.unionByName(done.select("MMSI", "tolerance", F.explode("stay").alias("i")))
    inside = closed.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("a") + 1) / size_), F.floor((F.col("b") - 1) / size_)))).join(chunks, ["MMSI", "chunk"])
    off = F.aggregate(F.filter("p", lambda x: (x["i"] > F.col("a")) & (x["i"] < F.col("b"))), F.lit(0.0), lambda s, x: s + _off(x))
    return ends.select("MMSI", (F.col("l.i") + 1).alias("n")), stay, done.select("MMSI", "tolerance", "off").unionByName(inside.select("MMSI", "tolerance", off.alias("off")))


def kept_points(points: DataFrame, tolerances: Sequence[float], size: int = CHUNK) -> DataFrame:
    """MMSI, tolerance, i: the numbers, in time order from 0, of the points that stay."""
    return _solved(points, tolerances, size)[1].distinct()


def simplified(points: DataFrame, tolerances: Sequence[float], size: int = CHUNK) -> DataFrame:
    """MMSI, tolerance, points, kept and mean_error_km (of all points to the line that is left, its corners counted with both sides)."""
    ends, stay, off = _solved(points, tolerances, size)
    counts = stay.distinct().groupBy("MMSI", "tolerance").agg(F.count("*").alias("kept"))
    sums = off.groupBy("MMSI", "tolerance").agg(F.sum("off").alias("off"))
    mean = F.col("off") / F.greatest(F.col("n") + F.col("kept") - 2, F.lit(1)) * 111
    return ends.join(counts, "MMSI").join(sums, ["MMSI", "tolerance"]).select("MMSI", "tolerance", F.col("n").alias("points"), "kept", mean.alias("mean_error_km"))
