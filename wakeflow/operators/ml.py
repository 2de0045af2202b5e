"""Classifiers of segments on pyspark.ml: imputing, scaling, weights, forests, boosted trees, search."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.operators.analytics import overall_metrics
from wakeflow.operators.boosting import SoftmaxBoosting

#: Inputs that do not give the rules' answers away; the rest is optional.
FEATURES = ["duration_seconds", "number_of_points", "avg_speed", "max_speed", "speed_variance", "path_length", "displacement", "heading_variance", "mean_heading_change"]
ALL_FEATURES = [*FEATURES, "trajectory_curvature", "path_tortuosity", "loop_count", "turn_density", "stationary_ratio", "crossing_count", "distance_to_boundary", "anchor_duration", "loiter_duration"]


def training_rows(features: DataFrame, labels: DataFrame, inputs: Sequence[str] = FEATURES) -> DataFrame:
    """segment_id, mmsi, label and the inputs as doubles of segments whose label is known."""
    named = labels.filter(F.col("situation_label").isNotNull() & (F.col("situation_label") != "Unknown")).select("segment_id", F.col("situation_label").alias("label"))
    return features.select("segment_id", "mmsi", *[F.col(c).cast("double").alias(c) for c in inputs]).join(named, "segment_id")


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with weight n / (classes * class size)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_n"), F.count("*").alias("_k"))
    sizes = sizes.crossJoin(total).select(label, (F.col("_n") / (F.col("_k") * F.col("_size"))).alias("weight"))  # one row per class
    return rows.join(F.broadcast(sizes), label)


def pipeline(model: str = "forest", inputs: Sequence[str] = FEATURES, seed: int = 42, trees: int = 200, depth: int = 20) -> Pipeline:
    """Labels, median imputing, scaling and a forest, boosted trees by softmax, or (one_vs_rest) boosted trees one class against the rest."""
    filled = [f"{c}_filled" for c in inputs]
    stages = [
        StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
        Imputer(strategy="median", relativeError=0.0, inputCols=list(inputs), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
    ]
    if model == "forest":
        last = RandomForestClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=trees, minInstancesPerNode=2, maxDepth=min(depth, 30), seed=seed)
    elif model == "boosted":
        last = SoftmaxBoosting(featuresCol="features", labelCol="label_index", weightCol="weight", maxIter=trees, maxDepth=min(depth, 6), stepSize=0.08, subsamplingRate=0.9, featureRate=0.9, seed=seed)
    elif model == "one_vs_rest":
        last = OneVsRest(classifier=GBTClassifier(featuresCol="features", maxIter=trees, maxDepth=min(depth, 6), stepSize=0.08, seed=seed), featuresCol="features", labelCol="label_index", weightCol="weight")
    else:
        raise ValueError(f"{model}: forest, boosted or one_vs_rest")
    return Pipeline(stages=[*stages, last])


def fit(rows: DataFrame, **options) -> PipelineModel:
    return pipeline(**options).fit(balanced(rows))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """segment_id, mmsi, label and predicted name."""
    names = F.array(*[F.lit(x) for x in [*model.stages[0].labels, "Unknown"]])
    return model.transform(rows).select("segment_id", "mmsi", "label", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


class MacroF1(Evaluator):
    """The mean of the classes' F1, of the classes that occur."""

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(F.col("label_index").cast("string").alias("t"), F.col("prediction").cast("string").alias("p"))
        classes = [r["t"] for r in pairs.select("t").distinct().collect()]  # one row a class
        return overall_metrics(pairs, "t", "p", classes).first()["macro_f1"] if classes else 0.0


def load(path: str) -> PipelineModel:
    """A model that the train command saved."""
    return PipelineModel.load(path)


def search(rows: DataFrame, draws: int = 30, folds: int = 3, seed: int = 42, inputs: Sequence[str] = FEATURES) -> PipelineModel:
    """The best of random draws of forest settings by cross-validated macro F1."""
    whole = pipeline("forest", inputs, seed)
    forest = whole.getStages()[-1]
    grid = list(itertools.product((50, 100, 200), (5, 10, 20), (1, 2, 4), (0.6, 0.8, 1.0)))
    picks = random.Random(seed).sample(grid, min(draws, len(grid)))
    maps = [{forest.numTrees: a, forest.maxDepth: b, forest.minInstancesPerNode: c, forest.subsamplingRate: d} for a, b, c, d in picks]
    return CrossValidator(estimator=whole, estimatorParamMaps=maps, evaluator=MacroF1(), numFolds=folds, seed=seed).fit(balanced(rows)).bestModel


def best_model(models: dict[str, PipelineModel], validation: DataFrame) -> str:
    """The name of the model with the highest macro F1 on the validation rows."""
    classes = [r["label"] for r in validation.select("label").distinct().orderBy("label").collect()]
    score = {k: overall_metrics(predict(m, validation), "label", "predicted", classes).first()["macro_f1"] for k, m in models.items()}
    return max(sorted(score), key=score.get)


def importances(model: PipelineModel, inputs: Sequence[str] = FEATURES, top: int = 20) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(inputs, map(float, values), strict=True), key=lambda x: -x[1])[:top]


def misclassified(predictions: DataFrame) -> DataFrame:
    """label, predicted, n and share of the label's rows, of wrong predictions."""
    counts = predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
    return counts.filter(F.col("label") != F.col("predicted"))
