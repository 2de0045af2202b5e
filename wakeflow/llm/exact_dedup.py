"""Exact dedup by a split at heavy hitters, in native DataFrame functions only.

Texts are equal when they are identical once each run of white space is one blank; the
whole SHA-256 of that text is its digest. Digests, ids and row numbers are written once
(about 48 bytes a row, whatever the texts). A Misra-Gries summary (the frequent items
aggregate of Spark, which is its merging form) of ``TRACKED`` counters is made in each
task, merged in ``FAN_IN`` groups and then once more; every digest on more than about
3.5 / TRACKED of the rows is in it. The ``HEAVY`` largest are verified: their rows are
counted exactly and their winners found by partial aggregation. These few winners are
broadcast, and their rows never meet in a shuffle; all other digests are grouped and
joined back by ordinary shuffles, in which no digest holds more than that share.

Defined cases: null text counts as empty; a null doc_id comes after all others, and is
the keep_id only where no row of the group has an id; among rows of the same doc_id and
equal text one stays, the others are copies like any other; an empty table gives an
empty result; other columns are ignored by :func:`mark` and kept by :func:`dedup`, also
if they bear names used here. Texts are hashed whole, however long.

Scale: the texts are read once and hashed in the scan. Memory is bounded by the counters
in a task and by HEAVY rows of 32-byte digests in a broadcast; both bounds are constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeflow.llm.common import free, written

#: counters of a summary, groups in which summaries merge first, and digests that are verified and broadcast
TRACKED = 4096
FAN_IN = 256
HEAVY = 512


def normal(text: Column) -> Column:
    """The text with each run of white space as one blank; only runs that change are touched. Null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][ \\x09-\\x0D]*| [ \\x09-\\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normal(text).cast("binary"), 256))


def heavy_digests(keys: DataFrame) -> DataFrame:
    """The at most HEAVY digests with the largest counters (hex strings in ``heavy``)."""
    parts = keys.select(F.hex("digest").alias("heavy"), F.spark_partition_id().alias("part")).groupBy((F.col("part") % FAN_IN).alias("part"))
    merged = parts.agg(F.expr(f"approx_top_k_accumulate(heavy, {TRACKED})").alias("s")).groupBy(F.lit("all").alias("all")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(s, {HEAVY})")).alias("e")).select("e.item").withColumnRenamed("item", "heavy").filter("heavy is not null")


def _groups(keys: DataFrame) -> DataFrame:
    """digest, first (the row that stays), n and tied (rows that share the smallest doc_id)."""
    first = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    return keys.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))


def split(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written keys (doc_id, digest, row) of ``docs``, the verified groups of heavy digests, and the groups of all others."""
    keys = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    candidates = heavy_digests(keys).select(F.unhex("heavy").alias("digest"))
    heavy = written(_groups(keys.join(F.broadcast(candidates), "digest", "left_semi")).filter("n > 1"))  # at most HEAVY rows
    return keys, heavy, _groups(keys.join(F.broadcast(heavy), "digest", "left_anti"))


def mark(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    keys, heavy, light = split(docs)
    rest = keys.join(F.broadcast(heavy), "digest", "left_anti")
    out = keys.join(F.broadcast(heavy), "digest").unionByName(rest.join(light, "digest"))
    return out.select("doc_id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Copies of heavy digests go in the scan; what is left meets its group by digest."""
    _, heavy, light = split(docs)
    key, id_, own = free(docs, "digest", "keep", "own")
    groups = lambda g: g.select(F.col("digest").alias(own), F.col("first.id").alias(id_))
    stays = docs["doc_id"].cast("long").eqNullSafe(F.col(id_))
    out = docs.withColumn(key, digest(docs["text"]))
    few = out.join(F.broadcast(groups(heavy)), F.col(key) == F.col(own), "left")
    first = few.filter(F.col(own).isNotNull() & stays).select(*out.columns)
    others = few.filter(F.col(own).isNull()).drop(own, id_)
    first = first.unionByName(others.join(groups(light), (F.col(key) == F.col(own)) & stays).select(*out.columns))
    return first.dropDuplicates([key]).drop(key)  # rows of one doc_id and equal texts
