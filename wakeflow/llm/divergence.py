"""Audit of how far sources of a language diverge, with exact integer arithmetic.

Terms are runs of ASCII letters and characters outside ASCII, A-Z lower-cased. A language
keeps the terms in at least ``MIN_DOCUMENTS`` of its documents. Group by group, a kept
term with c of N occurrences has p = 1 + floor(10^9 (c + 2) / (N + 2V)), and two groups
differ in a term by f = floor((p - q)^2 / (p + q)).

Pairs are sparse: a term that neither source of a pair has adds the same baseline
f(p0, q0), so a pair's sum is V times the baseline, and corrections: for terms of one
source (summed by how many terms it has with each count, against the other's p0), and
for terms that both have (a join on the term). All are integers, so the order of sums
does not matter.

The highest terms of each group come from a radix select (:func:`highest`): histograms
over the bits of the values, high bits first, are counted for all groups at once and
narrow each group's k-th value down bit group by bit group; rows that tie with it are
narrowed in the same way by the bytes of their UTF-8 form. Only what is left is ranked.

Defined cases: null text, lang and source are empty strings; groups without terms and
languages without kept terms (all sums 0) have their pairs; a source that is alone in its
language has none; rows that repeat a doc_id are documents of their own; an empty table
gives an empty result; other columns are ignored. Texts are counted whole.

Scale: the texts are read once and never shuffled; counts are combined in each batch and
each task before they are shuffled by group and term, so that a hot term or source is a
row a task. The number of pairs is that of the result; a pair's rows are summed in the
tasks that join them. Histograms have at most 2^DIGIT_BITS rows a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.llm import textbytes as tb
from wakeflow.llm.common import written

MIN_DOCUMENTS = 10
#: bits of a value and bytes of an item that one round of the radix select looks at
DIGIT_BITS = 11
DIGIT_BYTES = 2
#: ties of a group that are ranked without looking at their bytes round by round
FEW = 256


def term_table(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); each group has a row of the empty term."""

    def count(batches):
        for batch in batches:
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            n_sources = max(1, len(source.dictionary))
            group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
            for lo, hi, data, offsets in tb.chunks(batch.column("text"), 4 << 20):
                doc, code, times, terms, _ = tb.term_counts(data, offsets, tb.LETTERS)
                size = max(1, len(terms))
                key, back = np.unique(group[lo:hi][doc] * size + code, return_inverse=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, back, times)
                own = np.unique(group[lo:hi])
                of = np.concatenate([key // size, own])
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(of // n_sources)),
                        source.dictionary.take(pa.array(of % n_sources)),
                        pa.concat_arrays([terms.take(pa.array(key % size)).cast(pa.string()), pa.array([""] * len(own), pa.string())]),
                        pa.array(np.concatenate([n, np.zeros(len(own), np.int64)])),
                        pa.array(np.concatenate([np.bincount(back, minlength=len(key)), np.zeros(len(own), np.int64)]).astype(np.int64)),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), by long division in steps of 10^3 so that no product leaves 64 bits. Null where nothing is kept."""
    left, by = count + 2, F.nullif(total + 2 * kept, F.lit(0))
    out = F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        digit = F.call_function("div", left, by)
        out, left = out * 1000 + digit, left - digit * by
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(rows, groups), both written. Rows: lang, source, term, n, p and the language's q, for each kept term of a group. Groups: lang, source, kept (V), total (N), base (p of count 0)."""
    table = written(term_table(docs))
    by_lang = table.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_documents).drop("docs")
    by_lang = written(by_lang)
    rows = written(table.join(by_lang, ["lang", "term"]))
    langs = by_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = table.filter("term = ''").select("lang", "source").join(langs, "lang", "left")
    groups = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("kept", "lang_total", "total")])
    groups = written(groups.withColumn("base", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("kept")), F.lit(1).cast("long"))))
    full = rows.join(groups, ["lang", "source"])
    full = full.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return written(full), groups


def pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of f over all kept terms."""
    own = groups.select("lang", "source", "base", "kept")
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    # terms of one source against the other's baseline: terms with equal counts are one row
    counts = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = counts.join(own.drop("kept"), ["lang", "source"]).join(other, "lang").filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (gap(F.col("p"), F.col("item_base")) - gap(F.col("base"), F.col("item_base")))).alias("value"))
    mirrored = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    base = own.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("kept") * gap(F.col("base"), F.col("item_base"))).alias("value"))
    # terms of both
    one = rows.select("lang", "term", "source", "p").join(own.drop("kept"), ["lang", "source"])
    two = one.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("base").alias("item_base"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "item_p", "base", "item_base"))
    both = one.join(two, ["lang", "term"]).filter("source < item")
    both = both.groupBy("lang", "source", "item").agg(F.sum(gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).alias("value"))
    other_way = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.unionByName(alone).unionByName(mirrored).unionByName(both).unionByName(other_way)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _narrowed(hist: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """For each group of ``hist`` (keys, want, prefix, digit, times): the digit at which the running count reaches ``want``, what is wanted from it and its rows; the last digit if none does."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = hist.withColumn("upto", F.sum("times").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("times").over(Window.partitionBy(*keys)))
    return runs.filter((F.col("upto") - F.col("times") < F.col("want")) & ((F.col("upto") >= F.col("want")) | (F.col("upto") == F.col("all"))))


def highest(df: DataFrame, keys: list[str], value: str, item: str, k: int, few: int = FEW) -> DataFrame:
    """The rows of ``df`` with the k highest ``value`` (long, 0 or more) of each group, ties by ascending bytes of ``item`` (unique in a group), and their ``rank``.

    ``df`` is read once a round: give a written table. Each round keeps one row a group.
    """
    top = df.agg(F.max(value)).first()[0]
    shifts = list(range(0, max(1, int(top or 0).bit_length()), DIGIT_BITS))[::-1]
    v, state = F.col(value), None
    for shift in shifts:
        live = df.withColumns({"want": F.lit(k).cast("long"), "prefix": F.lit(0).cast("long")}) if state is None else df.join(state, keys).filter(F.shiftright(v, shift + DIGIT_BITS) == F.col("prefix"))
        hist = live.groupBy(*keys, "want", "prefix", F.shiftright(v, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).alias("digit")).agg(F.count("*").alias("times"))
        at = _narrowed(hist, keys, F.col("digit").desc())
        state = written(at.select(*keys, (F.col("want") - F.col("upto") + F.col("times")).alias("want"), F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit")).alias("prefix"), "times"))
    # the k-th value of each group is its prefix now; of rows with that value, ``want`` stay: first by bytes
    raw, limit = F.col(item).cast("binary"), state.withColumnRenamed("prefix", "least").withColumn("head", F.lit(b"")).withColumn("deep", F.lit(0))
    limit = written(limit)
    depth = 0
    open_ = (F.col("times") > F.col("want")) & (F.col("times") > few)
    while not limit.filter(open_).isEmpty():
        tied = df.join(limit.filter(open_), keys).filter((v == F.col("least")) & (F.substring(raw, 1, depth) == F.col("head")))
        hist = tied.groupBy(*keys, "want", "least", "head", F.substring(raw, depth + 1, DIGIT_BYTES).alias("digit")).agg(F.count("*").alias("times"))
        at = _narrowed(hist, keys, F.col("digit").asc()).select(*keys, (F.col("want") - F.col("upto") + F.col("times")).alias("want"), "times", "least", F.concat("head", "digit").alias("head"), F.lit(depth + DIGIT_BYTES).alias("deep"))
        limit = written(limit.filter(~open_).unionByName(at.select(*limit.columns)))
        depth += DIGIT_BYTES
    # ties beyond the head are out; those up to it are few
    start = F.expr(f"substring(cast(`{item}` as binary), 1, deep)")
    left = df.join(limit.select(*keys, "least", "head", "deep"), keys).filter((v > F.col("least")) | ((v == F.col("least")) & (start <= F.col("head"))))
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(v.desc(), F.col(item).asc())))
    return ranked.filter(F.col("rank") <= k).select(*df.columns, "rank")


def audit(docs: DataFrame, k: int = 10, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: each source against every other of its language, and its k most telling terms."""
    rows, groups = kept_terms(docs, min_documents)
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    against = pairs(rows, groups).withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    telling = written(rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")))
    terms = highest(telling, ["lang", "source"], "value", "item", k).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return against.select(*columns).unionByName(terms.select(*columns))
