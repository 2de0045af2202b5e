"""Connected components of links by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node that links reach) for every node that ``links`` (a, b long) tie to another.

    Each round takes every node to the smallest of itself and its neighbours, and on to
    where that one goes; links between nodes that went to one place are gone, equal ones
    are one, and the next round sees what is left. So the rows of all rounds together
    follow the links, and rounds the logarithm of a component's width. Tables are written
    each round; only whether any link is left comes to the driver.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("low")))
        on = low.select(F.col("node").alias("at"), F.col("low").alias("next"))
        step = written(low.join(on, F.col("low") == F.col("at")).select("node", F.least("low", "next").alias("to")))
        if labels is None:
            labels = step.select("node", F.col("to").alias("comp"))
        else:
            moved = step.select(F.col("node").alias("at"), "to")
            labels = written(labels.join(moved, F.col("comp") == F.col("at"), "left").select("node", F.coalesce("to", "comp").alias("comp")))
        for end in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("to", f"to_{end}"), F.col(end) == F.col("node")).drop("node", end)
        edges = written(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).filter("a < b").distinct())
        if edges.isEmpty():
            return labels
