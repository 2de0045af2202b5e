"""Multiclass gradient boosting with a softmax objective, as an estimator of pyspark.ml.

Each round grows one tree a class from the first and second derivatives of the softmax
loss. Inputs are cut into at most ``maxBins`` quantile bins once; then a round is as many
jobs as the trees have levels: every task adds the derivatives of its rows up by class,
node, input and bin, the tasks' sums are added by a grouped aggregation in part first, and
the driver, which sees only these sums (classes x nodes x inputs x bins at most), picks
the splits. Rows never leave their partition; their scores are brought up to date in a
reliable checkpoint every ``REFRESH`` rounds and by the trees since then in between.

Defined cases: rows with a missing or infinite input, or without a label, are an error of
the caller (impute first); a label that only some rounds see is a class like any other;
rows of weight 0 change nothing; one class alone gives probability 1.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.session import once

#: rounds after which rows' scores are written
REFRESH = 10
#: a split must lower the loss by more
LEAST_GAIN = 1e-9


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def grow(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node of each row of ``bins`` (rows x inputs): feature -1 ends; a row goes left up to and with the split's bin."""
    feature, cut, left = (np.array(tree[k]) for k in ("feature", "bin", "left"))
    node = np.zeros(len(bins), np.int64)
    while True:
        on = np.flatnonzero(feature[node] >= 0)
        if not len(on):
            return node
        at = node[on]
        node[on] = left[at] + (bins[on, feature[at]] > cut[at])


def best_split(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, int, int]:
    """(gain, input, bin) of sums by input and bin; the first of equal gains."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + reg) + gr**2 / (hr + reg) - gt**2 / (ht + reg)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    i = int(np.round(gain, 10).argmax())
    return float(gain.flat[i]), i // gain.shape[1], i % gain.shape[1]


class _Settings(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol):
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of an input, 256 at most", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's value that counts", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "added to the second derivatives of a node", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least second derivatives of a child", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows that a round learns from", TypeConverters.toFloat)
    featureRate = Param(Params._dummy(), "featureRate", "share of inputs that a round looks at", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of both shares", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "JSON of what was learned", TypeConverters.toString)


class SoftmaxBoosting(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, weightCol=None, predictionCol=None, probabilityCol=None, maxIter=None, maxDepth=None, maxBins=None, stepSize=None, regLambda=None, minChildWeight=None, subsamplingRate=None, featureRate=None, seed=None):  # noqa: N803
        super().__init__()
        self._setDefault(maxIter=250, maxDepth=6, maxBins=64, stepSize=0.08, regLambda=1.0, minChildWeight=1.0, subsamplingRate=1.0, featureRate=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        get = self.getOrDefault
        weight = F.col(get("weightCol")).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(F.col(get("featuresCol"))).alias("x"), F.col(get("labelCol")).cast("int").alias("y"), weight.alias("w"))
        top = rows.agg(F.max("y").alias("y"), F.max(F.size("x")).alias("n")).first()
        if top["y"] is None:
            raise ValueError("no rows to learn from")
        classes, inputs, n_bins = top["y"] + 1, top["n"], min(256, get("maxBins"))
        cuts = [F.lit(i / n_bins) for i in range(1, n_bins)]
        found = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.percentile_approx("v", F.array(*cuts), 10_000).alias("q")).collect()  # one row an input
        edges = {r["i"]: sorted(set(r["q"])) for r in found}
        edges = [edges.get(i, []) for i in range(inputs)]
        table, pending, model = once(rows.withColumn("id", F.monotonically_increasing_id()).mapInArrow(_binned(edges, classes), "b binary, y int, w double, u long, s array<double>")), [], []
        rng = np.random.default_rng(get("seed"))
        for number in range(get("maxIter")):
            some = np.sort(rng.choice(inputs, max(1, round(inputs * get("featureRate"))), replace=False))
            sampled = (get("subsamplingRate"), int(rng.integers(1 << 62)))
            grown = self._round(table, pending, classes, inputs, n_bins, some, sampled)
            model.append(grown)
            pending = [*pending, grown]
            if len(pending) == REFRESH and number + 1 < get("maxIter"):
                table, pending = once(table.mapInArrow(_rescored(pending, inputs), table.schema)), []
        out = SoftmaxBoostingModel()._set(trees=json.dumps({"edges": edges, "classes": classes, "rounds": model}))
        return self._copyValues(out)

    def _round(self, table: DataFrame, pending: list, classes: int, inputs: int, n_bins: int, some: np.ndarray, sampled: tuple[float, int]) -> list[dict]:
        get = self.getOrDefault
        trees = [{"feature": [-1], "bin": [0], "left": [0], "value": [0.0]} for _ in range(classes)]
        level = [[0] for _ in range(classes)]
        for depth in range(get("maxDepth")):
            width = max(map(len, level))
            if not width:
                break
            sums = table.mapInArrow(_sums(pending, trees, level, classes, inputs, n_bins, width, sampled), "slot long, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            g, h = np.zeros((2, classes * width * inputs * n_bins))
            at = np.array([r["slot"] for r in sums], np.int64)
            g[at], h[at] = [r["g"] for r in sums], [r["h"] for r in sums]
            g, h = (x.reshape(classes, width, inputs, n_bins) for x in (g, h))
            for k, tree in enumerate(trees):
                split = []
                for j, node in enumerate(level[k]):
                    if not depth:
                        tree["value"][node] = -g[k, j, 0].sum() / (h[k, j, 0].sum() + get("regLambda")) * get("stepSize")
                    gain, f, cut = best_split(g[k, j][some], h[k, j][some], get("regLambda"), get("minChildWeight"))
                    if not gain > LEAST_GAIN:
                        continue
                    f = int(some[f])
                    tree["feature"][node], tree["bin"][node], tree["left"][node] = f, cut, len(tree["feature"])
                    for part in (slice(0, cut + 1), slice(cut + 1, None)):
                        split.append(len(tree["feature"]))
                        for name, value in (("feature", -1), ("bin", 0), ("left", 0), ("value", float(-g[k, j, f][part].sum() / (h[k, j, f][part].sum() + get("regLambda")) * get("stepSize")))):
                            tree[name].append(value)
                level[k] = split
        return trees


def _matrix(column: pa.Array, inputs: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), inputs)


def _binned(edges: list[list[float]], classes: int):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(edges))
            b = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            scores = pa.array([[0.0] * classes] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), batch.column("y"), batch.column("w"), batch.column("id"), scores], ["b", "y", "w", "u", "s"])

    return run


def _scores(batch: pa.RecordBatch, b: np.ndarray, rounds: list[list[dict]]) -> np.ndarray:
    out = np.array(batch.column("s").to_pylist(), float)
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.array(tree["value"])[grow(tree, b)]
    return out


def _rescored(rounds: list[list[dict]], inputs: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = _scores(batch, _matrix(batch.column("b"), inputs), rounds)
                yield batch.set_column(batch.schema.get_field_index("s"), "s", pa.array(list(s), pa.list_(pa.float64())))

    return run


def _sums(rounds: list, trees: list[dict], level: list[list[int]], classes: int, inputs: int, n_bins: int, width: int, sampled: tuple[float, int]):
    """Sums of derivatives by class, node of the level, input and bin, of all rows of a task."""

    def run(batches):
        total = np.zeros((2, classes, width * inputs * n_bins))
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _matrix(batch.column("b"), inputs)
            p = softmax(_scores(batch, b, rounds))
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            rate, salt = sampled
            if rate < 1:  # by the row's number: the same rows whenever the round is run
                u = (batch.column("u").to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
                u = (u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                w = np.where((u >> np.uint64(11)) / float(1 << 53) < rate, w, 0.0)
            for k in range(classes):
                place = np.full(len(trees[k]["feature"]), -1)
                place[level[k]] = np.arange(len(level[k]))
                node = place[grow(trees[k], b)]
                on = node >= 0
                slot = ((node[on, None] * inputs + np.arange(inputs)) * n_bins + b[on]).ravel()
                for i, d in enumerate((p[:, k] - (y == k), p[:, k] * (1 - p[:, k]))):
                    total[i, k] += np.bincount(slot, np.repeat((d * w)[on], inputs), minlength=total.shape[2])
        flat = total.reshape(2, -1)
        at = np.flatnonzero(flat.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[0, at]), pa.array(flat[1, at])], ["slot", "g", "h"])

    return run


class SoftmaxBoostingModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        learned = json.loads(self.getOrDefault("trees"))
        learned = dataset.sparkSession.sparkContext.broadcast(learned)

        @F.pandas_udf("array<double>")
        def probability(x: pd.Series) -> pd.Series:
            value = learned.value
            rows = np.array(x.tolist(), float).reshape(len(x), len(value["edges"]))
            b = np.stack([np.searchsorted(e, rows[:, i], "left") for i, e in enumerate(value["edges"])], axis=1)
            score = np.zeros((len(x), value["classes"]))
            for trees in value["rounds"]:
                for k, tree in enumerate(trees):
                    score[:, k] += np.array(tree["value"])[grow(tree, b)]
            return pd.Series(list(softmax(score)))

        get = self.getOrDefault
        out = dataset.withColumn(get("probabilityCol"), array_to_vector(probability(vector_to_array(F.col(get("featuresCol"))))))
        values = vector_to_array(F.col(get("probabilityCol")))
        return out.withColumn(get("predictionCol"), (F.array_position(values, F.array_max(values)) - 1).cast("double"))
