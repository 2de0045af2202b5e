"""Softmax boosting against a plain numpy version, and against one class against the rest on rows that it has not seen."""

import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wakeflow.operators import boosting
from wakeflow.operators.analytics import overall_metrics


def plain(x, y, w, classes, rounds, depth, step, reg, least, edges):
    """The same model by whole arrays: probabilities of the rows."""
    score = np.zeros((len(x), classes))
    b = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1)
    for _ in range(rounds):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        for k in range(classes):
            g, h = (p[:, k] - (y == k)) * w, p[:, k] * (1 - p[:, k]) * w

            def value(rows, g=g, h=h):
                return -g[rows].sum() / (h[rows].sum() + reg) * step

            def descend(rows, level, g=g, h=h, k=k, value=value):
                best = (1e-9, None)
                for f in range(x.shape[1] if level < depth else 0):
                    for cut in range(len(edges[f])):
                        left, right = rows[b[rows, f] <= cut], rows[b[rows, f] > cut]
                        if h[left].sum() < least or h[right].sum() < least:
                            continue
                        parts = [g[r].sum() ** 2 / (h[r].sum() + reg) for r in (left, right, rows)]
                        if round(parts[0] + parts[1] - parts[2], 10) > round(best[0], 10):
                            best = (parts[0] + parts[1] - parts[2], (left, right))
                if best[1] is None:
                    score[rows, k] += value(rows)
                else:
                    for part in best[1]:
                        descend(part, level + 1)

            descend(np.arange(len(x)), 0)
    return np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)


def made(rng, n):
    """Three classes in rings and a fourth beside them, weights, a constant input and one of few values."""
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n), np.full(n, 3.0), rng.integers(0, 3, n)])
    r = np.hypot(x[:, 0], x[:, 1])
    y = np.where(x[:, 3] == 2, 3, np.digitize(r, [0.8, 1.5]))
    return x, y, rng.uniform(0.5, 2, n)


def table(spark, x, y, w, parts=3):
    return spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], ["features", "label", "weight"]).repartition(parts)


def test_equal_to_a_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y, w = made(np.random.default_rng(3), 160)
    df = table(spark, x, y, w)
    model = boosting.SoftmaxBoosting(weightCol="weight", maxIter=5, maxDepth=3, maxBins=12, stepSize=0.3, minChildWeight=0.5).fit(df)
    edges = json.loads(model.getOrDefault("trees"))["edges"]
    want = plain(x, y, w, 4, 5, 3, 0.3, 1.0, 0.5, edges)
    got = {tuple(r["features"]): r for r in model.transform(df).collect()}
    for a, p in zip(x, want, strict=True):
        r = got[tuple(a)]
        assert list(r["probability"]) == pytest.approx(list(p), abs=1e-9) and r["prediction"] == p.argmax()
        assert sum(r["probability"]) == pytest.approx(1)
    pipe = PipelineModel([model])
    pipe.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(df)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, model.transform(df).collect()))


def test_samples_are_the_same_when_run_again(spark):
    x, y, w = made(np.random.default_rng(4), 300)
    fit = lambda: boosting.SoftmaxBoosting(weightCol="weight", maxIter=3, maxDepth=2, subsamplingRate=0.6, featureRate=0.5, seed=9).fit(table(spark, x, y, w)).getOrDefault("trees")
    assert fit() == fit()


def test_one_class_alone(spark):
    df = table(spark, np.ones((5, 2)), np.zeros(5), np.ones(5))
    assert {r["prediction"] for r in boosting.SoftmaxBoosting(maxIter=2).fit(df).transform(df).collect()} == {0.0}
    with pytest.raises(ValueError, match="no rows"):
        boosting.SoftmaxBoosting(maxIter=2).fit(df.limit(0))


def test_beats_one_class_against_the_rest(spark):
    """On held-out rows, with as many trees of the same size and step."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    y = np.digitize(x[:, 0] + 0.6 * x[:, 1] * x[:, 2] + rng.normal(scale=0.2, size=1500), [-0.9, 0.0, 0.9])
    train, test = table(spark, x[:1000], y[:1000], np.ones(1000)), table(spark, x[1000:], y[1000:], np.ones(500))
    settings = {"maxIter": 15, "maxDepth": 3, "stepSize": 0.3}
    score = {}
    for name, model in (("softmax", boosting.SoftmaxBoosting(**settings)), ("rest", OneVsRest(classifier=GBTClassifier(**settings, seed=1)))):
        found = model.fit(train).transform(test).select(F.col("label").cast("string").alias("t"), F.col("prediction").cast("string").alias("p"))
        score[name] = overall_metrics(found, "t", "p", ["0.0", "1.0", "2.0", "3.0"]).first()["macro_f1"]
    assert score["softmax"] > score["rest"], score
