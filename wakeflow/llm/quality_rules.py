"""Quality rules by cross-document line frequency, in native DataFrame functions only.

Every line is normalised and hashed with its host; for each host, the distinct
documents that hold the line are counted, where documents of the same text count
as one. Lines in more documents than the limit are removed, and a document that
keeps too few of its characters is rejected. Base rules on words stand beside it.

Defined cases: a null text has no words and fails the base rules; a null source is
a host of its own; rows that repeat a doc_id are judged one by one, equal rows get
equal results; an empty table gives an empty result; other columns are ignored by
:func:`judge` and kept by :func:`keep_good`, which takes the frequent lines out of the
texts. No text is too long: arrays of a row are as long as its text.

What is removed and left is measured in word characters.

Scale: two shuffles of (host and line hash, text hash) with partial aggregation,
one of the line rows for the join back, none of texts. A hot line is one row per
map task after the partial aggregation; the join back is left to AQE, which
splits its skewed side and broadcasts the limits only if they are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeflow.llm.common import free


@dataclass(frozen=True)
class QualityLimits:
    #: a line is boilerplate in more distinct documents of a host than both
    line_documents: int = 20
    line_share: float = 0.01
    #: a document that keeps fewer characters, or a smaller share, is depleted
    min_chars: int = 40
    min_share: float = 0.3
    #: base rules
    base_words: int = 10
    base_repeat_percent: int = 20


def text_words(text: Column) -> Column:
    """The words of a text: other white space becomes a blank first, for the fast split by one character."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and the base counts of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(
        "doc_id", "source", F.xxhash64(text).alias("text_hash"), text_words(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    one = one.select(
        "doc_id", "source", "text_hash", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"), "w",
    )
    windows = F.transform("hashes", lambda h, i: F.xxhash64(h, *[F.get(F.col("hashes"), i + k) for k in range(1, 5)]))
    one = one.withColumn("windows", F.slice(windows, F.lit(1), F.greatest(F.col("n_words") - 4, F.lit(0)).cast("int"))).drop("hashes")
    # Most texts repeat no window. In the others, window hashes give their lowest
    # bits to the position, so that one sort of numbers puts windows that may be equal
    # side by side; of these, which are few, the words are compared.
    bits = F.length(F.bin("n_words")).cast("int")
    packed = F.transform("windows", lambda h, i: F.call_function("shiftleft", F.call_function("shiftright", h, F.col("bits")), F.col("bits")).bitwiseOR(i.cast("long")))
    one = one.withColumn("bits", bits).withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(packed))).drop("windows")
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    same = lambda x, j: F.coalesce(high(F.get(F.col("sorted"), j)) == high(x), F.lit(False))
    again = F.filter("sorted", lambda x, j: same(x, j + 1) | F.when(j > 0, same(x, j - 1)).otherwise(False))
    position = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)
    named = F.transform(F.transform(again, position), lambda p: F.struct(F.array_join(F.slice("w", p.cast("int") + 1, F.lit(5)), " ").alias("words"), p.alias("p")))
    one = one.withColumn("named", F.sort_array(named)).drop("sorted", "w")
    words = lambda j: F.get(F.col("named"), j)["words"]
    equal = F.filter("named", lambda x, j: F.coalesce(words(j + 1) == x["words"], F.lit(False)) | F.when(j > 0, words(j - 1) == x["words"]).otherwise(False))
    one = one.withColumn("again", F.sort_array(F.transform(equal, lambda x: x["p"]))).drop("named")
    covered = F.aggregate(F.transform("again", lambda p, j: F.least(F.lit(5).cast("long"), F.coalesce(F.get(F.col("again"), j + 1) - p, F.lit(5).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    return one.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("again", "bits")


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), line)


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line of a row that is not blank: its key (of host and normalised line) and its word characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", "source", F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("as_is"), F.split(F.lower(text), "\n").alias("low"))
    lines = F.transform("low", lambda x, i: F.struct(F.trim(x).alias("line"), F.length(F.translate(F.get(F.col("as_is"), i), " \t\n\x0b\x0c\r", "")).cast("long").alias("chars")))
    one = one.select("doc_id", "source", "text_hash", F.explode(F.filter(lines, lambda x: x["line"] != "")).alias("l"))
    return one.select("doc_id", "source", "text_hash", _line_key(F.col("l.line")).alias("line_key"), F.col("l.chars").alias("line_chars"))


def judge(docs: DataFrame, limits: QualityLimits | None = None) -> DataFrame:
    """doc_id, text_hash, base counts, removed_chars, base_failed and kept: one row per row of ``docs`` (doc_id, text, source)."""
    columns = ["doc_id", "text_hash", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars"]
    return _judged(docs, limits or QualityLimits()).select(*columns, "base_failed", "kept", F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("copy")).drop("copy")


def _judged(docs: DataFrame, limits: QualityLimits) -> DataFrame:
    """The columns of :func:`judge` and the keys of the frequent lines: one row per doc_id, text and source, with its number of rows."""
    docs = docs.select("doc_id", "text", "source")
    base, lines = _base(docs), _lines(docs)
    hosts = docs.select("source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).groupBy("source").agg(F.count_distinct("text_hash").alias("host_documents"))
    counted = lines.groupBy("line_key", "source").agg(F.count_distinct("text_hash").alias("line_documents")).filter(F.col("line_documents") > limits.line_documents)
    frequent = (
        counted.join(hosts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host")))
        .filter(F.col("line_documents") > F.lit(limits.line_share) * F.col("host_documents"))
        .select("line_key")
    )
    # rows that repeat (doc_id, text, source) are summed together, so they are counted
    removed = lines.join(frequent, "line_key").groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("source").alias("host")).agg(F.sum("line_chars").alias("removed_chars"), F.collect_set("line_key").alias("frequent"))
    rows = base.groupBy("doc_id", "text_hash", "source").agg(*[F.first(c).alias(c) for c in ("n_symbols", "n_words", "word_chars", "n_dup_lines", "n_repeat_words")], F.count("*").cast("int").alias("rows"))
    out = rows.join(removed, rows["doc_id"].eqNullSafe(removed["id"]) & (rows["text_hash"] == removed["hash"]) & rows["source"].eqNullSafe(removed["host"]), "left")
    out = out.withColumn("removed_chars", F.coalesce((F.col("removed_chars") / F.col("rows")).cast("long"), F.lit(0).cast("long")))
    failed = (F.col("n_words") < limits.base_words) | (100 * F.col("n_repeat_words") > limits.base_repeat_percent * F.col("n_words"))
    left = F.col("word_chars") - F.col("removed_chars")
    return out.withColumns({"base_failed": failed, "kept": ~failed & (left >= limits.min_chars) & (left >= limits.min_share * F.col("word_chars"))})


def keep_good(docs: DataFrame, limits: QualityLimits | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without frequent lines; n_chars, where it is a column, follows a changed text."""
    id_, key, host, cut, low = free(docs, "id", "hash", "host", "frequent", "low")
    good = _judged(docs, limits or QualityLimits()).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(key), F.col("source").alias(host), F.col("frequent").alias(cut))
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    out = docs.join(good, docs["doc_id"].eqNullSafe(F.col(id_)) & (text_hash == F.col(key)) & docs["source"].eqNullSafe(F.col(host)))
    out = out.withColumn(low, F.split(F.lower("text"), "\n"))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(cut, _line_key(F.trim(F.get(F.col(low), i)))))
    changed = {"text": F.array_join(left, "\n")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)
    plain = lambda c: F.col(f"`{c}`")
    return out.select(*[F.when(F.col(cut).isNull(), plain(c)).otherwise(changed[c]).alias(c) if c in changed else plain(c) for c in docs.columns])
