"""Events of a stream of positions in event time, equal to those of the batch path.

Points may come in any order within the watermark's delay. A vessel's points wait in list
state until the watermark has passed them, and are then taken in order; a point older than
the watermark when it comes is not used but given out as a row of kind LATE. Event-time
timers release what waits and close what no further point can extend, so a vessel that
falls silent still gets its last events, and its state shrinks to a flag and a time.

Of a vessel's track the state holds, whatever its length: the last flag and time; each open
slow run as sums and the hull of its points (the point farthest from any centre is a
vertex of the hull of their gnomonic projection); the open turning window as sums; the
anchorings that may still meet an open loitering; and the crossings of the last hours as
list state, from which those too old go at each crossing.

State needs the RocksDB provider: see :data:`STATE_PROVIDER`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wakeflow.config import EventThresholds
from wakeflow.functions.exprs import EARTH_KM
from wakeflow.operators import events

#: the setting that the streams of this module need
STATE_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MINUTE = 60_000_000
POINT = "at long, latitude double, longitude double, speed double, heading double, inside boolean"
FOUND = "kind string, MMSI long, s long, e long, v double, n long, km double, variance double, coverage double, m double"


def haversine(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q, d = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, a)))


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def hull_with(hull: list[list[float]], x: float, y: float, *more: float) -> list[list[float]]:
    """The vertices [x, y, ...], counter-clockwise, of a convex hull and one more point."""
    p = [x, y, *more]
    if len(hull) > 2 and all(_turn(a, b, p) > 0 for a, b in zip(hull, [*hull[1:], hull[0]], strict=True)):
        return hull
    points = sorted([*hull, p])
    halves = []
    for side in (points, points[::-1]):
        half: list[list[float]] = []
        for q in side:
            while len(half) > 1 and _turn(half[-2], half[-1], q) <= 0:
                half.pop()
            half.append(q)
        halves += half[:-1]
    return halves or [p]


class Run:
    """A slow run as sums and a hull; ``d`` is what state keeps of it."""

    def __init__(self, d: dict):
        self.d = d

    @classmethod
    def of(cls, at: int, lat: float, lon: float) -> Run:
        return cls({"s": at, "e": at, "n": 0, "v": 0.0, "lat": 0.0, "lon": 0.0, "from": [lat, lon], "hull": [], "wide": False})

    def add(self, at: int, lat: float, lon: float, speed: float) -> None:
        d = self.d
        d["e"], d["n"], d["v"], d["lat"], d["lon"] = at, d["n"] + 1, d["v"] + speed, d["lat"] + lat, d["lon"] + lon
        p, q, by = math.radians(d["from"][0]), math.radians(lat), math.radians(lon - d["from"][1])
        up = math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(by)
        if up < 0.1:
            d["wide"] = True
        else:
            d["hull"] = hull_with(d["hull"], math.cos(q) * math.sin(by) / up, (math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(by)) / up, lat, lon)

    def km(self) -> float:
        d = self.d
        return math.inf if d["wide"] else max(haversine(d["lat"] / d["n"], d["lon"] / d["n"], h[2], h[3]) for h in d["hull"])


class Track:
    """What a vessel's points in order make: rows of FOUND without the vessel. ``d`` is what state keeps."""

    def __init__(self, d: dict | None, t: EventThresholds, kinds: tuple[str, ...]):
        self.d = d or {"last": None, "inside": None, "runs": {}, "turn": None, "origin": None, "anchors": [], "waiting": []}
        self.t, self.kinds = t, kinds
        self.below = {k: v for k, v in (("ANCHOR", t.anchor_speed_knots), ("LOITER", t.loiter_speed_knots)) if k in kinds}

    def point(self, at: int, lat: float, lon: float, speed: float | None, heading: float | None, inside: bool | None) -> Iterator[tuple]:
        d = self.d
        if d["last"] is not None and (at - d["last"]) / MINUTE > self.t.max_ais_gap_minutes:
            yield from self._close(list(d["runs"]))
        slow = [k for k, v in self.below.items() if speed is not None and speed < v]
        yield from self._close([k for k in d["runs"] if k not in slow])
        for k in slow:
            run = Run(d["runs"][k]) if k in d["runs"] else Run.of(at, lat, lon)
            run.add(at, lat, lon, speed)
            d["runs"][k] = run.d
        if "MANEUVERING" in self.kinds and heading is not None:
            yield from self._turn(at, heading)
        if inside is not None:
            if d["inside"] is not None and d["inside"] != inside:
                yield ("ENTRY" if inside else "EXIT", at, at, None, None, None, None, None, 0.0)
            d["inside"] = inside
        d["last"] = at

    def until(self, now: int) -> Iterator[tuple]:
        """What ends because no point before ``now`` can come."""
        d, t = self.d, self.t
        if d["runs"] and (now - d["last"]) / MINUTE > t.max_ais_gap_minutes:
            yield from self._close(list(d["runs"]))
        if d["turn"] and now >= d["origin"] + (d["turn"]["i"] + 1) * t.maneuver_window_minutes * MINUTE:
            yield from self._turned()

    def next(self) -> int | None:
        """The first time at which :meth:`until` may have something."""
        d, t = self.d, self.t
        ends = [d["last"] + int(t.max_ais_gap_minutes * MINUTE) + 1] if d["runs"] else []
        ends += [d["origin"] + (d["turn"]["i"] + 1) * t.maneuver_window_minutes * MINUTE] if d["turn"] else []
        return min(ends, default=None)

    def _turn(self, at: int, heading: float) -> Iterator[tuple]:
        d = self.d
        d["origin"] = at if d["origin"] is None else d["origin"]
        i = (at - d["origin"]) // (self.t.maneuver_window_minutes * MINUTE)
        if d["turn"] and d["turn"]["i"] != i:
            yield from self._turned()
        w = d["turn"] = d["turn"] or {"i": i, "s": at, "e": at, "n": 0, "sin": 0.0, "cos": 0.0}
        angle = math.radians(heading % 360.0)
        w["e"], w["n"], w["sin"], w["cos"] = at, w["n"] + 1, w["sin"] + math.sin(angle), w["cos"] + math.cos(angle)

    def _turned(self) -> Iterator[tuple]:
        w, t = self.d["turn"], self.t
        self.d["turn"] = None
        m = (w["e"] - w["s"]) / MINUTE
        variance = 1 - math.sqrt((w["sin"] / w["n"]) ** 2 + (w["cos"] / w["n"]) ** 2)
        coverage = min(1.0, m / t.maneuver_window_minutes, w["n"] / max(1, int(t.maneuver_min_points)))
        if w["n"] >= t.maneuver_min_points and coverage >= min(1.0, max(0.0, t.maneuver_min_point_coverage_ratio)) and variance >= t.maneuver_heading_circular_variance_threshold:
            yield ("MANEUVERING", w["s"], w["e"], None, w["n"], None, variance, coverage, m)

    def _close(self, kinds: list[str]) -> Iterator[tuple]:
        d, t = self.d, self.t
        for k in sorted(kinds):  # anchorings first
            run = Run(d["runs"].pop(k))
            r = run.d
            m = (r["e"] - r["s"]) / MINUTE
            row = (k, r["s"], r["e"], r["v"] / r["n"], r["n"], None, None, None, m)
            if k == "ANCHOR" and m > t.anchor_min_duration_minutes:
                d["anchors"].append([r["s"], r["e"]])
                yield row
            elif k == "LOITER" and m > t.loiter_min_duration_minutes and (km := run.km()) <= t.loiter_radius_km:
                d["waiting"].append([*row[:5], km, *row[6:]])
        open_ = d["runs"].get("ANCHOR")
        for w in list(d["waiting"]):  # until no open anchoring can meet it
            if not (open_ and open_["s"] <= w[2]):
                d["waiting"].remove(w)
                if not any(s <= w[2] and e >= w[1] for s, e in d["anchors"]):
                    yield tuple(w)
        first = min([w[1] for w in d["waiting"]] + [r["s"] for k, r in d["runs"].items() if k == "LOITER"], default=None)
        d["anchors"] = [a for a in d["anchors"] if first is not None and a[1] >= first]


class Crossings:
    """The crossings of the last hours: a row for each that makes them too many."""

    def __init__(self, recent: list[int], t: EventThresholds):
        self.recent, self.t = recent, t

    def add(self, at: int) -> Iterator[tuple]:
        before = self.recent[-1] if self.recent else None
        self.recent = [x for x in self.recent if x >= at - self.t.repeated_crossing_window_hours * 60 * MINUTE]
        self.recent.append(at)
        n = len(self.recent)
        if n > self.t.repeated_crossing_count and not (before == at and n - 1 > self.t.repeated_crossing_count):
            yield ("REPEATED_CROSSING", self.recent[0], at, None, n, None, None, None, (at - self.recent[0]) / MINUTE)


class Ordered(StatefulProcessor):
    """Points of a vessel in event time: waits in state for the watermark, then runs them through :class:`Track` and :class:`Crossings`."""

    def __init__(self, thresholds: EventThresholds, kinds: tuple[str, ...], schema: str = POINT):
        self.values, self.kinds, self.schema = asdict(thresholds), kinds, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.t = handle, EventThresholds(**self.values)
        self.waiting = handle.getListState("waiting", self.schema)
        self.recent = handle.getListState("recent", "at long")
        self.track = handle.getValueState("track", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, late, good = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for frame in rows:
            for r in frame[self._names()].itertuples(index=False):
                r = tuple(None if pd.isna(x) else x for x in r)
                (late if r[0] < now else good).append(r)
        if good:
            self.waiting.appendList(good)
        found = [("LATE", r[0], r[0], None, 1, None, None, None, 0.0) for r in late]
        yield self._frame(key, found + self._advance(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._frame(key, self._advance(timerValues.getCurrentWatermarkInMs() * 1000))

    def _names(self) -> list[str]:
        return [f.split()[0] for f in self.schema.split(", ")]

    def _advance(self, now: int) -> list[tuple]:
        waiting = [tuple(x) for x in self.waiting.get()]
        ready = sorted((x for x in waiting if x[0] < now), key=self._order)
        rest = [x for x in waiting if x[0] >= now]
        track = Track(json.loads(self.track.get()[0]) if self.track.exists() else None, self.t, self.kinds)
        crossings = Crossings([x[0] for x in self.recent.get()], self.t)
        found: list[tuple] = []
        for x in self._distinct(ready):
            for row in self._made(track, x):
                found.append(row)
                if row[0] in ("ENTRY", "EXIT") and "REPEATED_CROSSING" in self.kinds:
                    found += crossings.add(row[1])
        found += track.until(now)
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            if crossings.recent:
                self.recent.put([(x,) for x in crossings.recent])
        self.track.update((json.dumps(track.d),))
        for at in (min((x[0] for x in rest), default=None), track.next()):
            if at is not None:
                self.handle.registerTimer(max(at, now) // 1000 + 1)
        return found

    def _order(self, x: tuple):
        return x[0]

    def _distinct(self, ready: list[tuple]) -> list[tuple]:
        """One point an instant, the first that came: equal times leave the state together."""
        return [x for i, x in enumerate(ready) if not i or ready[i - 1][0] != x[0]]

    def _made(self, track: Track, x: tuple) -> Iterator[tuple]:
        return track.point(*x)

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in FOUND.split(", ") if not f.startswith("MMSI")]
        frame = pd.DataFrame(rows, columns=names).astype({"kind": "object", "s": "Int64", "e": "Int64", "n": "Int64", **dict.fromkeys(("v", "km", "variance", "coverage", "m"), "float64")})
        frame.insert(1, "MMSI", pd.array([key[0]] * len(rows), dtype="Int64"))
        return frame


class OrderedCrossings(Ordered):
    """As :class:`Ordered`, over zone entries and exits that are given as such."""

    def _order(self, x: tuple):
        return x[0], x[1]

    def _distinct(self, ready: list[tuple]) -> list[tuple]:
        return ready

    def _made(self, track: Track, x: tuple) -> Iterator[tuple]:
        yield (x[1], x[0], x[0], None, None, None, None, None, 0.0)


ALL = ("ANCHOR", "LOITER", "MANEUVERING", "ENTRY", "REPEATED_CROSSING")


def _in_event_time(rows: DataFrame, time: str, delay: str, columns: list) -> DataFrame:
    """Rows with their event time in microseconds only: the watermark follows the time, and late rows still reach the operator, which gives them out."""
    return rows.withWatermark(time, delay).select(*columns, F.unix_micros(time).alias("at"))


def found_stream(points: DataFrame, delay: str, thresholds: EventThresholds | None = None, kinds: tuple[str, ...] = ALL) -> DataFrame:
    """FOUND of a streaming table of MMSI, timestamp, latitude, longitude, speed, heading and inside_eez (what lacks counts as null), late points as kind LATE."""
    have = set(points.columns)
    value = lambda c, kind, of=None: (F.col(of or c) if (of or c) in have else F.lit(None)).cast(kind).alias(c)
    columns = [F.col("MMSI").cast("long").alias("MMSI"), *[value(c, "double") for c in ("latitude", "longitude", "speed", "heading")], value("inside", "boolean", "inside_eez")]
    rows = _in_event_time(points, "timestamp", delay, columns)
    return rows.groupBy("MMSI").transformWithStateInPandas(Ordered(thresholds or EventThresholds(), kinds), FOUND, "append", "EventTime")


def crossing_stream(boundary: DataFrame, delay: str, thresholds: EventThresholds | None = None) -> DataFrame:
    """FOUND of a streaming table of boundary events (event_type, event_timestamp, mmsi): these and the repeated crossings."""
    kind = events.normalized_boundary_type(F.col("event_type")).alias("kind")
    rows = _in_event_time(boundary, "event_timestamp", delay, [F.col("mmsi").cast("long").alias("MMSI"), kind]).filter("kind is not null")
    return rows.groupBy("MMSI").transformWithStateInPandas(OrderedCrossings(thresholds or EventThresholds(), ALL, "at long, kind string"), FOUND, "append", "EventTime")


def late(found: DataFrame) -> DataFrame:
    """The side output: mmsi and event_timestamp of the points that came after the watermark."""
    return found.filter("kind = 'LATE'").select(F.col("MMSI").alias("mmsi"), F.timestamp_micros("s").alias("event_timestamp"))


def as_events(found: DataFrame, thresholds: EventThresholds | None = None) -> DataFrame:
    """FOUND without late points, in the columns of the batch path's events."""
    rows = found.filter("kind <> 'LATE'").withColumns({"s": F.timestamp_micros("s"), "e": F.timestamp_micros("e")})
    return events.as_events(rows, thresholds or EventThresholds())
