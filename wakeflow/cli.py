"""Command line: one command per stage; arguments override the configuration file."""

from __future__ import annotations

import argparse
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from wakeflow.config import load_config
from wakeflow.operators import analytics, clean, evaluation, events, features, fishing, geofence, labels, ml, reports, segment, situations
from wakeflow.session import once, session
from wakeflow.sources import readers, sinks

_EVENT = f"event_type string, event_timestamp timestamp, mmsi long, start_timestamp timestamp, end_timestamp timestamp, duration_minutes double, details {events.DETAILS}"

_SITUATION = "situation string, confidence double, mmsi long, start_timestamp timestamp, end_timestamp timestamp"
#: as ``reason`` writes them, with the events that support them
_REASONED = f"{_SITUATION}, supporting_events array<struct<{','.join(':'.join(f.split(' ', 1)) for f in _EVENT.split(', '))}>>"


def _ingest(spark, a, config):
    files = readers.stage(a.source, a.raw_dir, a.max_rows, a.replace_raw) if a.raw_dir else [a.source]
    raw = clean.standardize(readers.read_csv_files(spark, files))
    sinks.write_points(clean.clean(raw, config.cleaning), a.output)
    if a.stats:
        sinks.write_metrics(clean.cleaning_stats(raw, config.cleaning), a.stats)


def _segment(spark, a, config):
    c = config.segmentation
    c = replace(c, window_minutes=tuple(a.window) if a.window else c.window_minutes, min_points=a.min_points or c.min_points)
    sinks.write_table(segment.segment_points(readers.read_points(spark, a.points), c), a.output)


def _prepare(spark, a, config):
    """Ingest and segmentation in one command; of a source that is one file, the tables bear its name in front."""
    stem = f"{Path(a.source).stem}_" if Path(a.source).is_file() else ""
    points, segments, stats = (f"{a.output}/{stem}{x}" for x in ("cleaned_ais.parquet", "segments.parquet", "cleaning_stats.json"))
    Path(a.output).mkdir(parents=True, exist_ok=True)
    raw = a.raw_dir or f"{a.output}/raw"
    _ingest(spark, argparse.Namespace(source=a.source, raw_dir=raw, max_rows=a.max_rows, replace_raw=a.replace_raw, output=points, stats=stats), config)
    _segment(spark, argparse.Namespace(points=points, window=a.window, min_points=a.min_points, output=segments), config)


def _boundary(spark, a, config):
    sinks.write_table(geofence.boundary_events(readers.read_points(spark, a.points), readers.read_polygons(spark, a.polygons)), a.output)


def _events(spark, a, config):
    found = events.event_sequence(readers.read_points(spark, a.points), readers.read_boundary_events(spark, a.boundary), config.event_extraction)
    found = found.orderBy("event_timestamp", "mmsi", "event_type")
    if a.output.endswith(".json"):
        sinks.write_envelope(found, a.output, "event", thresholds=vars(config.event_extraction))
    else:
        sinks.write_json_lines(found, a.output)


def _sequence(spark, path):
    return readers.read_envelope(spark, path, "events", _EVENT) if path else spark.createDataFrame([], _EVENT)


def _features(spark, a, config):
    edges = readers.read_polygons(spark, a.polygons) if a.polygons else None
    out = features.segment_features(spark.read.parquet(a.segments), readers.read_boundary_events(spark, a.boundary), _sequence(spark, a.events), edges, config.features)
    sinks.write_table(out, a.output)


def _fishing(spark, a, config):
    sinks.write_table(fishing.effort_to_labels(readers.read_effort(spark, a.effort), a.min_hours), a.output)


def _labels(spark, a, config):
    given = readers.read_fishing_labels(spark, a.fishing) if a.fishing else None
    out = labels.situation_labels(spark.read.parquet(a.features), given, config.weak_supervision)
    sinks.write_table(out, a.output)
    labels.label_counts(spark.read.parquet(a.output)).show()


def _reason(spark, a, config):
    found = situations.ordered(situations.reason(_sequence(spark, a.events), config.situation_reasoning))
    sinks.write_envelope(found, a.output, "situation") if a.output.endswith(".json") else sinks.write_table(found, a.output)


def _report(spark, a, config):
    found = spark.read.parquet(a.situations) if a.situations.rstrip("/").endswith(".parquet") else readers.read_envelope(spark, a.situations, "situations", _REASONED, missing_ok=False)
    known = spark.read.parquet(a.features) if a.features else None
    sinks.write_text(reports.report_lines(found, known), "report", a.output)


def _train(spark, a, config):
    c = config.classifier_training
    test_size, validation_size = (x if x is not None else y for x, y in ((a.test_size, c.test_size), (a.validation_size, c.validation_size)))
    rows = ml.training_rows(spark.read.parquet(a.features), spark.read.parquet(a.labels))
    rows = analytics.sample_groups(rows, "label", "segment_id", c.max_majority_samples)
    rows = once(analytics.stratified_split(rows, "label", "segment_id", (1 - test_size - validation_size, validation_size, test_size)))
    train, validation, test = (rows.filter(F.col("split") == x) for x in ("train", "validation", "test"))
    if a.model == "best":
        models = {x: ml.fit(train, model=x, trees=a.trees) for x in ("forest", "boosted")}
        model = models[ml.best_model(models, validation)]
    else:
        model = ml.search(train) if a.tune else ml.fit(train, model=a.model, trees=a.trees)
    model.write().overwrite().save(a.output)
    classes = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]
    if a.metrics:
        sinks.write_evaluation(ml.predict(model, test), "label", "predicted", classes, a.metrics)


def _evaluate(spark, a, config):
    """Predictions of a saved model and of the reasoner, side by side, for the segments of test vessels."""
    t = readers.evaluation_inputs(spark, a.folder, _EVENT, _SITUATION)
    model = ml.load(a.model)
    rows = analytics.vessel_split(ml.training_rows(t["features"], t["labels"])).filter("split = 'test'")
    said = ml.predict(model, rows).select("segment_id", evaluation.activity_of("predicted").alias("predicted"))
    audited = evaluation.audit(t["labels"].join(rows.select("segment_id"), "segment_id", "left_semi"), {"rf": said}, t["situations"])
    sinks.write_table(audited, f"{a.output}/predictions.parquet")
    audited = spark.read.parquet(f"{a.output}/predictions.parquet")
    sinks.write_evaluation(audited, "ground_truth_activity", "rf_predicted_activity", evaluation.ACTIVITY_CLASSES, f"{a.output}/classification_metrics.json")
    sinks.write_metrics(evaluation.context_metrics(audited), f"{a.output}/reasoning_metrics.json")


def _compare(spark, a, config):
    """A table of prior results, read from JSON, above this system's metrics."""
    found = readers.read_metrics(a.metrics)["metrics"]
    own = spark.createDataFrame([("this system", float(found["accuracy"]), float(found["macro_f1"]))], "system string, accuracy double, f1 double")
    table = analytics.comparison_table(spark, readers.read_metrics(a.prior) if a.prior else [], own, 4)
    sinks.write_csv({"classifiers": table}, a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wakeflow", description=__doc__)
    top.add_argument("--config")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *required: str, **optional) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for x in required:
            sub.add_argument(f"--{x}", required=True)
        for x, value in optional.items():
            kind = {"action": "store_true"} if value is bool else {"type": value}
            sub.add_argument(f"--{x.replace('_', '-')}", **kind)
        sub.add_argument("--output", required=True)
        return sub

    command("ingest", _ingest, "source", raw_dir=str, stats=str, max_rows=int, replace_raw=bool)
    command("prepare", _prepare, "source", raw_dir=str, max_rows=int, replace_raw=bool, min_points=int).add_argument("--window", type=int, action="append")
    command("segment", _segment, "points", min_points=int).add_argument("--window", type=int, action="append")
    command("boundary", _boundary, "points", "polygons")
    command("events", _events, "points", boundary=str)
    command("features", _features, "segments", boundary=str, events=str, polygons=str)
    command("fishing", _fishing, "effort").add_argument("--min-hours", type=float, default=0.1)
    command("labels", _labels, "features", fishing=str)
    command("reason", _reason, "events")
    command("report", _report, "situations", features=str)
    train = command("train", _train, "features", "labels", metrics=str, tune=bool, test_size=float, validation_size=float)
    train.add_argument("--trees", type=int, default=200)
    train.add_argument("--model", choices=("forest", "boosted", "one_vs_rest", "best"), default="forest")
    command("evaluate", _evaluate, "folder", "model")
    command("compare", _compare, "metrics", prior=str)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(), a, load_config(a.config))


if __name__ == "__main__":
    main()
