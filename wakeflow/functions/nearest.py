"""Nearest polygon edge by a quad tree over the edges' middles.

A cell is split while more than ``capacity`` edges have their middle in it, so cells are
small where edges are dense and no cell holds them all; a node's box is that of its edges,
whole. The tree is built level by level with grouped counts, and only its nodes' boxes
come together: capacity grows with the edges so that there are at most about ``MAX_NODES``.

Each point descends the tree, all points of a batch side by side: a box is no nearer than
its nearest side and holds an edge no farther than its farthest corner, so boxes beyond the
least such corner are cut off. What is left is a few leaves for each point, whose edges it
then meets in an equi-join; Spark splits the points of a leaf where they are many.

Defined cases: points without a finite place, and all points where there is no edge, have
a null distance; equal edges and edges of no length count like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.functions import exprs as X
from wakeflow.session import once

#: levels of the tree: cells of the last are a 2^20th of the plane wide and are not split
LEVELS = 20
CAPACITY = 64
MAX_NODES = 500_000
#: points that descend side by side
BATCH = 4096
_BOX = ["x1", "y1", "x2", "y2"]


def _interleaved(x, y):
    """Bits of two columns below 2^20 in turn: the head of the number is the cell at each level."""
    out = F.lit(0).cast("long")
    for i in range(LEVELS):
        bit = lambda c: F.shiftright(c, i).bitwiseAND(F.lit(1))  # noqa: B023, E731
        out = out.bitwiseOR(F.shiftleft(bit(x), 2 * i)).bitwiseOR(F.shiftleft(bit(y), 2 * i + 1))
    return out


def _coded(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges in metres with the code of their middle's place in the square around all, and their number."""
    ends = edges.select(X.mercator_x("x1").alias("x1"), X.mercator_y("y1").alias("y1"), X.mercator_x("x2").alias("x2"), X.mercator_y("y2").alias("y2"))
    ends = ends.filter(" and ".join(f"abs({c}) < 1e9" for c in _BOX))  # finite
    n, west, south, east, north = ends.select(F.count("*"), F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    if not n:
        return ends.withColumn("code", F.lit(0).cast("long")), 0
    size = max(east - west, north - south, 1.0) * (1 + 1e-9)
    at = lambda a, b, low: F.floor(((F.col(a) + F.col(b)) / 2 - low) / size * (1 << LEVELS)).cast("long")
    return ends.withColumn("code", _interleaved(at("x1", "x2", west), at("y1", "y2", south))), n


class Tree:
    """Nodes of all levels: boxes, the first child and number of children of each, and the key of a leaf."""

    def __init__(self, nodes: list[tuple[int, int, bool, float, float, float, float]]):
        nodes = sorted(nodes)
        self.level = np.array([n[0] for n in nodes], np.int64)
        code = np.array([n[1] for n in nodes], np.int64)
        self.leaf = np.array([n[2] for n in nodes], bool)
        self.box = np.array([n[3:] for n in nodes], float).reshape(-1, 4)
        self.key = self.level << 42 | code
        # children of a node are neighbours in the order of level and code
        self.first = np.searchsorted(self.key, (self.level + 1) << 42 | code << 2)
        self.children = np.searchsorted(self.key, (self.level + 1) << 42 | (code << 2) + 4) - self.first

    def leaves(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, keys of leaves) that may hold the points' nearest edges."""
        point = np.repeat(np.arange(len(x)), int((self.level == 1).sum()))
        node = np.tile(np.flatnonzero(self.level == 1), len(x))
        best, kept = np.full(len(x), np.inf), []
        while len(point):
            dx = np.maximum(np.maximum(self.box[node, 0] - x[point], x[point] - self.box[node, 2]), 0)
            dy = np.maximum(np.maximum(self.box[node, 1] - y[point], y[point] - self.box[node, 3]), 0)
            low = np.hypot(dx, dy)
            far = np.hypot(np.maximum(np.abs(x[point] - self.box[node, 0]), np.abs(x[point] - self.box[node, 2])), np.maximum(np.abs(y[point] - self.box[node, 1]), np.abs(y[point] - self.box[node, 3])))
            np.minimum.at(best, point, far * (1 + 1e-12) + 1e-6)
            near = low <= best[point]
            point, node, low = point[near], node[near], low[near]
            done = self.leaf[node]
            kept.append((point[done], node[done], low[done]))
            point, node = point[~done], node[~done]
            n = self.children[node]
            node = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[node], n)
            point = np.repeat(point, n)
        if not kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        point, node, low = (np.concatenate(c) for c in zip(*kept, strict=True))
        near = low <= best[point]
        return point[near], self.key[node[near]]


def quad_tree(edges: DataFrame, capacity: int | None = None) -> tuple[Tree, DataFrame]:
    """The tree of an edge table in degrees, and its edges in metres with the key of their leaf."""
    open_, n = _coded(edges)
    open_ = once(open_)
    capacity = capacity or max(CAPACITY, -(-8 * n // MAX_NODES))
    nodes, leaves = [], open_.limit(0).withColumn("leaf", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        cell = F.shiftright("code", 2 * (LEVELS - level))
        cells = once(open_.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(F.least("x1", "x2")).alias("a"), F.min(F.least("y1", "y2")).alias("b"), F.max(F.greatest("x1", "x2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d")))
        split = (F.col("n") > capacity) if level < LEVELS else F.lit(False)
        nodes += [(level, r["cell"], not r["split"], r["a"], r["b"], r["c"], r["d"]) for r in cells.withColumn("split", split).collect()]  # together at most about MAX_NODES
        dealt = open_.withColumn("cell", cell).join(cells.select("cell", split.alias("split")), "cell")
        leaves = leaves.unionByName(dealt.filter("not split").select(*_BOX, "code", (F.lit(level << 42).cast("long") + F.col("cell")).alias("leaf")))
        if not any(not x[2] for x in nodes if x[0] == level):
            break
        open_ = once(dealt.filter("split").select(*_BOX, "code"))
    return Tree(nodes), once(leaves.drop("code"))


def distance_km(points: DataFrame, edges: DataFrame, key: str, x: str, y: str, capacity: int | None = None) -> DataFrame:
    """key, distance_to_boundary: least distance to an edge in Web Mercator metres / 1000, for each key once."""
    tree, leaves = quad_tree(edges, capacity)
    tree = points.sparkSession.sparkContext.broadcast(tree)

    def search(batches):
        for batch in batches:
            px, py = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("px", "py"))
            for lo in range(0, len(px), BATCH):
                some = np.flatnonzero(np.isfinite(px[lo : lo + BATCH]) & np.isfinite(py[lo : lo + BATCH])) + lo
                point, leaf = tree.value.leaves(px[some], py[some])
                rows = pa.array(np.concatenate([some[point], np.setdiff1d(np.arange(lo, min(lo + BATCH, len(px))), some[point])]))
                leaf = pa.array(np.concatenate([leaf, np.zeros(len(rows) - len(leaf), np.int64)]), mask=np.arange(len(rows)) >= len(leaf))
                taken = batch.take(rows)
                yield pa.RecordBatch.from_arrays([taken.column("key"), taken.column("px"), taken.column("py"), leaf], ["key", "px", "py", "leaf"])

    rows = points.select(F.col(key).alias("key"), X.mercator_x(x).alias("px"), X.mercator_y(y).alias("py"))
    kind = points.schema[key].dataType.simpleString()
    met = rows.mapInArrow(search, f"key {kind}, px double, py double, leaf long").join(leaves, "leaf", "left")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    t = ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / F.when(square > 0, square)
    t = X.clip(F.coalesce(t, F.lit(0.0)), 0.0, 1.0)
    far = F.sqrt(F.pow(F.col("px") - (F.col("x1") + t * dx), 2) + F.pow(F.col("py") - (F.col("y1") + t * dy), 2))
    return met.groupBy(F.col("key").alias(key)).agg((F.min(far) / 1000).alias("distance_to_boundary"))
