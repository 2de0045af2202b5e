"""Sinks: Parquet tables, JSON envelopes, small CSV, LaTeX and Markdown tables, text reports."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.functions import exprs as X
from wakeflow.operators import analytics


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """One distributed write; an empty table leaves its schema."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_points(points: DataFrame, path: str) -> None:
    """Cleaned points by date, so that one day's scan reads one folder."""
    write_table(points.repartition("trajectory_date", "MMSI").sortWithinPartitions("MMSI", "timestamp"), path, "trajectory_date")


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text: times in ISO form, nulls left out, numbers that are none null."""
    fields = [X.iso(c).alias(c) if t == "timestamp" else F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """A folder of JSON lines: the form of large sequences."""
    as_json(df).write.mode("overwrite").text(path)


def write_envelope(df: DataFrame, path: str, field: str, **head: object) -> int:
    """One JSON document {..., <field>_count, <field>s: [...]}, streamed row by row through the driver; returns the count."""
    n = 0
    with Path(path).open("w") as f:
        f.write(json.dumps(head)[:-1] + (", " if head else "") + f'"{field}s": [')
        for row in as_json(df).toLocalIterator():
            f.write(("," if n else "") + "\n" + row["value"])
            n += 1
        f.write(f'\n], "{field}_count": {n}}}')
    return n


def write_metrics(row: DataFrame, path: str) -> dict:
    """A one-row table as a JSON object."""
    values = json.loads(as_json(row.limit(1)).first()["value"])
    Path(path).write_text(json.dumps(values, indent=2))
    return values


def write_evaluation(predictions: DataFrame, truth: str, predicted: str, classes: Sequence[str], path: str) -> dict:
    """One JSON object: overall metrics, metrics by class and the confusion matrix of predictions."""
    lines = lambda df: [json.loads(r["value"]) for r in as_json(df).collect()]  # noqa: E731  one row a class
    values = {
        "metrics": lines(analytics.overall_metrics(predictions, truth, predicted, classes))[0],
        "classes": lines(analytics.class_metrics(predictions, truth, predicted, classes).select("class", "support", "precision", "recall", "f1")),
        "confusion_matrix": lines(analytics.confusion(predictions, truth, predicted, classes)),
    }
    Path(path).write_text(json.dumps(values, indent=2))
    return values


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def _small(df: DataFrame, limit: int) -> list:
    """The rows of a table that is meant to be small; ValueError if it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write this table with write_table")
    return rows


def write_csv(tables: dict[str, DataFrame], path: str, limit: int = 10_000) -> None:
    """Small tables one below the other, each under a '# name' line; ValueError for one of more rows than ``limit``."""
    with Path(path).open("w", newline="") as f:
        for name, df in tables.items():
            f.write(f"# {name}\n")
            out = csv.writer(f)
            out.writerow(df.columns)
            out.writerows(_small(df, limit))
            f.write("\n")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    rows = [[str(v) if v is not None else "" for v in r] for r in _small(df, limit)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def latex(df: DataFrame, caption: str, limit: int = 1000) -> str:
    safe = lambda v: "" if v is None else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    rows = [" & ".join(map(safe, r)) + r" \\" for r in _small(df, limit)]
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", " & ".join(map(safe, df.columns)) + r" \\ \hline", *rows, r"\end{tabular}", r"\end{table}"])
