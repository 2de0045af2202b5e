"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Each source gets a target in words: its weight's share of all
sizes, at most ``max_repeats`` times its own size, the excess reshared by weight.
A source's documents fall into at most BLOCKS blocks by a hash. The target fixes an
exact quota of block draws: every block as often as the target holds the whole
source, then further blocks in a permuted order, the last of them in part. A binary
tree splits the vector of quotas among the output shards: at each node the left
half of the shards gets a multivariate-hypergeometric draw from the node's vector, so
that every draw goes to one shard and all shards get as many. A shard takes disjoint
runs of each source's permuted blocks, and what is taken of a document is what the
shards have drawn of its block. How much that is in all follows from the quotas, which the
tree divides and neither adds to nor takes from; which shard has it follows from the tree.
:func:`mix` gives each draw a place in its shard by a seeded hash, and :func:`write_shards`
writes the shards in that order. All choices follow from the seed and the rows, so reruns agree.

Of the block drawn in part, parts are taken in the same way, and of the part at the
edge parts again; of the documents at its edge those that fit.

Defined cases: null text has size 0 and is never taken; a null source is a source,
after all others in the order of weights; rows that repeat a doc_id are documents of
their own; an empty table gives an empty result; further columns pass through
:func:`mix` unless they clash with the names it adds, which win.

Scale: texts are counted once, into a written table of numbers, and never shuffled by
:func:`plan`. The driver holds one row per source. The sums per block are partial
aggregates, at most BLOCKS rows a source and level. With LEVELS levels, a task orders
the documents of 1 / BLOCKS**LEVELS of a source.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.llm.common import free, word_count, written

#: Weights repeat over the sources in code point order.
WEIGHTS = (5, 2, 1)
BLOCKS = 1024
BLOCK_DOCUMENTS = 64
LEVELS = 3
#: more sources than this are joined by a shuffle
BROADCAST_SOURCES = 10_000


def targets(sizes: list[int], weights: list[float], max_repeats: int = 3) -> list[float]:
    """Words for each source: shares by weight of all words, none above max_repeats times its size."""
    total, fixed = float(sum(sizes)), {i: 0.0 for i, s in enumerate(sizes) if not s}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest, w = total - sum(fixed.values()), sum(weights[i] for i in free)
        share = {i: rest * weights[i] / w for i in free}
        over = {i: float(max_repeats * sizes[i]) for i in free if share[i] > max_repeats * sizes[i]}
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= over


def split_tree(draws: list[int], shards: int, seed: int) -> np.ndarray:
    """draws[i] of source i dealt to the shards: rows are shards, columns are sources."""
    rng, out = np.random.Generator(np.random.PCG64(seed)), np.zeros((shards, len(draws)), dtype=np.int64)

    def node(lo: int, hi: int, vector: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = vector
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(vector, int(vector.sum()) * (mid - lo) // (hi - lo), method="marginals")
        node(lo, mid, left)
        node(mid, hi, vector - left)

    node(0, shards, np.asarray(draws, dtype=np.int64))
    return out


def _edge(rows: DataFrame, by: str, left: str, seed: int) -> DataFrame:
    """Of the parts ``by`` of each source, in a permuted order, until ``left`` words are reached: n, b, place, state (all, part or none) and left, what is still to take of the part."""
    sums = rows.groupBy("number", by).agg(F.sum("size").alias("words"), F.first(left).alias("left"))
    order = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(seed), "number", by), by)  # at most BLOCKS rows a source
    sums = sums.withColumns({"place": F.row_number().over(order) - 1, "through": F.sum("words").over(order)})
    before = F.col("through") - F.col("words")
    state = F.when(F.col("through") <= F.col("left"), "all").when(before < F.col("left"), "part").otherwise("none")
    return sums.select(F.col("number").alias("n"), F.col(by).alias("b"), "place", state.alias("state"), (F.col("left") - before).alias("left"))


def _fitting(part: DataFrame) -> DataFrame:
    """Of the documents (number, doc_id, text_hash, key, size, left) those that fill ``left``: by key while they fit, then, four times, the one that fits best. Equal rows go together."""
    part = part.groupBy("number", "doc_id", "text_hash", "key", "left").agg(F.sum("size").alias("size"))
    fill = Window.partitionBy("number").orderBy("key", "doc_id", "text_hash")
    part = part.withColumn("through", F.sum("size").over(fill)).withColumn("in1", F.col("through") <= F.col("left"))
    one = Window.partitionBy("number")
    for taken, step in (("in1", "in2"), ("in2", "in3"), ("in3", "in4"), ("in4", "in5")):
        part = part.withColumn("short", F.col("left") - F.coalesce(F.sum(F.when(F.col(taken), F.col("size"))).over(one), F.lit(0)))
        gap = F.when(~F.col(taken), F.abs(F.col("short") - F.col("size")))
        part = part.withColumn("rank", F.row_number().over(one.orderBy(gap.asc_nulls_last(), "key", "doc_id", "text_hash")))
        part = part.withColumn(step, F.col(taken) | ((F.col("rank") == 1) & (gap < F.abs("short"))))
    return part.filter("in5").select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), F.col("number").alias("p_number"), F.lit(True).alias("fits"))


def plan(docs: DataFrame, shards: int = 8, seed: int = 17, max_repeats: int = 3) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken and ``shards``: the shard of each draw that takes the document."""
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")))
    sized = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row per source
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in found]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))], max_repeats)
    rows = []
    for i, r in enumerate(found):
        whole = min(max_repeats, int(goal[i] // sizes[i])) if sizes[i] else 0
        rest = max(0.0, goal[i] - whole * sizes[i]) if whole < max_repeats else 0.0
        parts, n = [], r["n"] // BLOCK_DOCUMENTS  # of each level, none much smaller than BLOCK_DOCUMENTS
        for _ in range(LEVELS):
            parts.append(max(1, min(BLOCKS, n)))
            n //= parts[-1]
        rows.append((i, r["source"], sizes[i], goal[i], parts[0], whole, rest, parts))
    small = F.broadcast if len(rows) <= BROADCAST_SOURCES else lambda df: df
    sources = spark.createDataFrame(rows, "number int, of_source string, source_size long, target double, blocks int, whole int, rest double, parts array<int>")
    at = sized.join(small(sources), F.col("source").eqNullSafe(F.col("of_source")))
    part = lambda i: F.pmod(F.xxhash64(F.lit(i), "key"), F.element_at("parts", i)).cast("int")
    at = at.withColumns({"b1": F.pmod("key", F.col("blocks")).cast("int"), **{f"b{i}": part(i) for i in range(2, LEVELS + 1)}})

    # whole blocks, and parts of the block, and of its part, at the edge
    states, edge, left = [], at, "rest"
    for i in range(1, LEVELS + 1):
        state = written(_edge(edge, f"b{i}", left, seed + i))
        states.append(state.select("n", "b", "place", "state"))
        part_of = state.filter("state = 'part'").select(F.col("n").alias(f"n{i}"), F.col("b").alias(f"at{i}"), F.col("left").alias(f"left{i}"))
        edge, left = edge.join(part_of, (F.col("number") == F.col(f"n{i}")) & (F.col(f"b{i}") == F.col(f"at{i}"))), f"left{i}"
    fits = _fitting(edge.filter("size > 0").select("number", "doc_id", "text_hash", "key", "size", F.col(left).alias("left")))

    # the quota of a source: its blocks as often as the target holds them whole, and those from which more is taken
    more = {r["n"]: r["count"] for r in states[0].filter("state <> 'none'").groupBy("n").count().collect()}  # one row per source
    dealt = split_tree([r[4] * r[5] + more.get(r[0], 0) for r in rows], shards, seed) if rows else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(dealt, axis=0)
    drawn = spark.createDataFrame([(i, [int(v) for v in ends[:, i]]) for i in range(len(rows))], "e_number int, ends array<long>")
    at = at.join(small(drawn), F.col("number") == F.col("e_number"))
    for i, state in enumerate(states, 1):
        state = state.select(F.col("n").alias(f"n{i}"), F.col("b").alias(f"at{i}"), F.col("place").alias(f"place{i}"), F.col("state").alias(f"state{i}"))
        on = (F.col("number") == F.col(f"n{i}")) & (F.col(f"b{i}") == F.col(f"at{i}"))
        at = at.join(state, on if i == 1 else on & (F.col(f"state{i - 1}") == "part"), "left")
    at = at.join(fits, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")) & (F.col("number") == F.col("p_number")) & (F.col(f"state{LEVELS}") == "part"), "left")
    inside = F.coalesce("fits", F.lit(False))
    for i in range(LEVELS, 0, -1):
        inside = F.when(F.col(f"state{i}") == "all", True).when(F.col(f"state{i}") == "part", inside).otherwise(False)
    # the draws of a source in their permuted order: each goes to the shard whose run it stands in
    draws = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda i: F.when((F.col("size") > 0) & ((i < F.col("whole")) | inside), i.cast("long") * F.col("blocks") + F.col("place1")))
    to = F.transform(F.filter(draws, lambda d: d.isNotNull() & (d < F.element_at("ends", -1))), lambda d: F.size(F.filter("ends", lambda e: e <= d)))
    at = at.withColumn("shards", to)
    return at.select("doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, shards: int = 8, seed: int = 17, max_repeats: int = 3) -> DataFrame:
    """The rows of ``docs``, as often as the mix takes them, with their shard and their place in it (an order key)."""
    rows = docs.drop("mix_copy", "mix_shard", "mix_order")
    id_, hash_, source_ = free(rows, "id", "hash", "source")
    chosen = plan(docs, shards, seed, max_repeats).filter(F.size("shards") > 0).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("source").alias(source_), "shards")
    chosen = chosen.dropDuplicates([id_, hash_, source_]).select(id_, hash_, source_, F.posexplode("shards").alias("mix_copy", "mix_shard"))
    same = rows["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(rows["text"], F.lit(""))) == F.col(hash_)) & rows["source"].eqNullSafe(F.col(source_))
    out = rows.join(chosen, same).withColumn("mix_order", F.xxhash64(F.lit(seed), "mix_shard", id_, hash_, "mix_copy"))
    return out.drop(id_, hash_, source_)


def write_shards(docs: DataFrame, path: str, tasks: int | None = None, **options: int) -> None:
    """The mix as Parquet, a folder for each mix_shard, its files in the shard's shuffled order.

    Ranges of (shard, order) go to ``tasks`` tasks, so a shard is as many tasks' work as it
    has rows, each file a run of its order; read by file name and row, a shard is in order.
    """
    rows = mix(docs, **options)
    by = ["mix_shard", "mix_order"]
    dealt = rows.repartitionByRange(tasks, *by) if tasks else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").partitionBy("mix_shard").parquet(path)
