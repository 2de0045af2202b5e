"""Simplification in small chunks against the plain recursion over whole tracks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from wakeflow.operators import simplify

T0 = datetime(2024, 1, 1)
COLUMNS = "MMSI long, timestamp timestamp, latitude double, longitude double"


def tracks():
    rng = random.Random(8)
    out = {}
    for m in range(1, 4):  # walks, one on a coarse grid with many equal places and straight stretches
        x = y = 0.0
        out[m] = []
        for _ in range(rng.randint(120, 250)):
            x, y = x + rng.gauss(0, 0.01), y + rng.gauss(0, 0.01)
            out[m].append((round(x, 2), round(y, 2)) if m == 2 else (x, y))
    out[4] = [(0.01 * i, 0.0) for i in range(120)] + [(1.19, 0.01 * i) for i in range(100)] + [(1.19 - 0.01 * i, 0.99) for i in range(90)]  # straight
    out[5] = [(np.cos(i / 9) * (1 - i / 400), np.sin(i / 9) * (1 - i / 400)) for i in range(350)]  # a spiral
    out[6], out[7], out[8], out[9] = [(1.0, 2.0)], [(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0)] * 80, [(0.0, 0.0), (1.0, 0.5)] * 50
    return {m: [(float(x), float(y)) for x, y in t] for m, t in out.items()}


@pytest.fixture(scope="module")
def points(spark):
    rows = [(m, T0 + timedelta(minutes=97 * i), y, x) for m, t in tracks().items() for i, (x, y) in enumerate(t)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([*rows, (1, None, 1.0, 1.0), (1, T0, None, 1.0)], COLUMNS)


def test_kept_points_equal_the_plain_version(points):
    got = {}
    for r in simplify.kept_points(points, [0.0, 0.004, 0.05], size=16).collect():
        got.setdefault((r["MMSI"], r["tolerance"]), []).append(r["i"])
    want = {(m, t): simplify.kept(np.array(xy), t).tolist() for m, xy in tracks().items() for t in (0.0, 0.004, 0.05)}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert 30 < len(want[1, 0.004]) < len(want[1, 0.0])


@pytest.mark.parametrize("size", [20, 4096])
def test_errors_equal_the_plain_version(points, size):
    got = {r["MMSI"]: r for r in simplify.simplified(points, [0.02], size).collect()}
    for m, t in tracks().items():
        xy = np.array(t)
        on = simplify.kept(xy, 0.02)
        d = np.concatenate([simplify.distance(xy[a : b + 1], xy[a], xy[b]) for a, b in zip(on, on[1:], strict=False)] or [np.zeros(1)])
        assert (got[m]["points"], got[m]["kept"]) == (len(t), len(on)) and got[m]["mean_error_km"] == pytest.approx(d.mean() * 111, abs=1e-9)


def test_hulls_are_small():
    walk = np.random.default_rng(0).normal(size=(4096, 2)).cumsum(axis=0)
    on = simplify.hull(walk)
    assert len(on) < 80
    for _ in range(50):
        a, b = walk[np.random.default_rng(1).integers(0, 4096, 2)] + 0.1
        assert simplify.distance(walk, a, b).argmax() == on[simplify.distance(walk[on], a, b).argmax()]


def test_no_points(points):
    assert simplify.kept_points(points.limit(0), [0.1]).count() == 0 and simplify.simplified(points.limit(0), [0.1]).count() == 0
