"""The corpus pipeline: whole-table stages over ``documents``, each on all its predecessor kept.

Quality rules reject documents; line dedup removes repeated chunks of lines and drops
documents of which nothing is left; the Jaccard join keeps one document of each group
of near duplicates; decontamination drops documents that hold a benchmark item; the
mix takes documents as often as the target weights of their sources ask. All but the
last return the columns of ``documents``, with n_chars as the text is then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeflow.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_rules
from wakeflow.llm.common import cut, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs).filter("n_removed_lines = 0 or trim(translate(text, '\\n\\t', '')) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mix),
]

#: rolling line hashes and prefix orders have no SQL form; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))  # each stage reads what the one before it wrote
    return docs
