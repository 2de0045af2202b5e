"""Irregular zones over the places of the driver's tables: slanted edges, holes, islands, touching and overlapping parts."""

from __future__ import annotations

import math


def star(x: float, y: float, points: int, wide: float, narrow: float, turn: float) -> list[tuple[float, float]]:
    """A ring of 2 * points corners, wide and narrow in turn."""
    corners = ((wide if i % 2 == 0 else narrow, turn + math.pi * i / points) for i in range(2 * points))
    return [(round(x + r * math.cos(a), 4), round(y + 0.6 * r * math.sin(a), 4)) for r, a in corners]


#: polygons of parts of rings of (longitude, latitude)
ZONES = [
    [[star(9.013, 54.917, 9, 0.93, 0.41, 0.3), star(9.113, 54.871, 3, 0.31, 0.17, 1.1)]],
    [[star(10.717, 55.307, 23, 0.71, 0.57, 0.05)], [[(11.217, 54.013), (11.631, 54.211), (11.419, 54.631), (11.117, 54.317)]]],
    [[star(10.419, 54.507, 5, 0.83, 0.29, 2.0), star(10.411, 54.513, 7, 0.19, 0.11, 0.7)], [star(10.433, 54.519, 4, 0.07, 0.05, 0.2)]],
]


def sides() -> list[tuple[int, int, float, float, float, float]]:
    """polygon, part, x1, y1, x2, y2 of all edges."""
    return [(i, j, *a, *b) for i, parts in enumerate(ZONES) for j, rings in enumerate(parts) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
