"""Line dedup by content-defined chunks and short windows of lines, in native DataFrame functions only.

Lines are hashed, and a rolling hash over two neighbouring line hashes gives every gap
between lines a value. A gap whose value is smallest among its neighbours is a chunk
boundary: it depends on the lines around it only, so boundaries survive insertions
elsewhere, and since two such gaps never touch, chunks have several lines. Beside the
chunks, a single line of at least ``long_line_words`` words counts as a chunk of its
own, and so do the shortest windows of lines over ``window_words`` words: from each line
on, and up to each line. Any passage of more words that stands twice consists of such
windows, wherever its chunk boundaries fall. What occurs more than once in the corpus is
traced to its first occurrence (lowest doc_id, then text hash and place); neighbours
that go back to neighbouring lines join into runs, and a run is compared byte by byte
with the lines it repeats; where the bytes agree, the later occurrence is removed.

Defined cases: null and empty texts have no chunks and stay as they are; a short text
of one line is never removed; blank lines belong to the chunk or window they stand in;
rows of the same doc_id and text count as one document and get the same result, rows of
the same doc_id and other texts are documents of their own; a null doc_id comes first;
an empty table gives an empty result; other columns stay unless they clash with the
names added here, which win.

Scale: one row of numbers per chunk or window is written once, and shuffled for the
counts (with partial aggregation, so a hot chunk is a row per map task) and one for the join back, which
AQE may split. Texts are shuffled by document only; repeated runs are cut out of
them for the comparison. Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.llm.common import free, written
from wakeflow.llm.quality_rules import text_words


@dataclass(frozen=True)
class ChunkLimits:
    #: fewer characters in a chunk of several lines: never removed
    min_chars: int = 30
    long_line_words: int = 50
    #: a window of lines has more words
    window_words: int = 50


def _items(docs: DataFrame, limits: ChunkLimits, windows: bool = False) -> DataFrame:
    """doc_id, hash, s, e, key: the lines [s, e) of each chunk (and window), by number, and the hash of its line hashes."""
    one = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.split("text", "\n").alias("lines")).filter(F.col("lines").isNotNull())
    one = one.withColumn("h", F.transform("lines", lambda x: F.xxhash64(x))).withColumn("n", F.size("lines"))
    one = one.withColumn("r", F.transform("h", lambda x, i: F.xxhash64(x, F.get(F.col("h"), i - 1))))
    at = lambda i: F.get(F.col("r"), i)
    lowest = lambda r, i: (i == 0) | ((i >= 2) & (i <= F.col("n") - 2) & (r < at(i - 1)) & (r <= at(i + 1)))
    one = one.withColumn("b", F.filter(F.transform("r", lambda r, i: F.when(lowest(r, i), i)), lambda i: i.isNotNull()))
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    chunks = F.filter(F.transform("b", lambda s, j: span(s, F.coalesce(F.get(F.col("b"), j + 1), F.col("n")))), lambda c: c["e"] - c["s"] >= 2)
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    long_lines = F.filter(F.transform("lines", lambda x, i: F.when(blanks(x) >= limits.long_line_words - 1, span(i, i + 1))), lambda c: c.isNotNull())
    body = lambda c: F.array_join(F.slice("lines", c["s"] + 1, c["e"] - c["s"]), "\n")
    large = lambda spans: F.filter(spans, lambda c: F.length(body(c)) >= limits.min_chars)
    spans = large(F.concat(chunks, long_lines))
    if windows:
        # the line of each word; where a line's words begin, a window opens, and where they end, one closes
        one = one.withColumn("w", F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.size(text_words(x))))))
        line_of = lambda k: F.get(F.col("w"), k)
        more = limits.window_words
        onward = F.transform("w", lambda i, k: F.when((k == 0) | (line_of(k - 1) != i), span(i, line_of(k + more) + 1)))
        back = F.transform("w", lambda i, k: F.when((k == F.size("w") - 1) | (line_of(k + 1) != i), span(line_of(k - more), i + 1)))
        short = F.filter(F.concat(onward, back), lambda c: c["s"].isNotNull() & c["e"].isNotNull())
        # more words than window_words have twice as many characters at least, with the blanks between them
        spans = F.array_distinct(F.concat(spans, short if limits.min_chars <= 2 * more + 1 else large(short)))
    keyed = F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.xxhash64(F.slice("h", c["s"] + 1, c["e"] - c["s"])).alias("key")))
    return one.select("doc_id", "hash", F.explode(keyed).alias("c")).select("doc_id", "hash", "c.*")


def find(docs: DataFrame, limits: ChunkLimits | None = None) -> DataFrame:
    """doc_id, hash and ``spans`` (array of line ranges to remove) of the documents that lose lines."""
    limits = limits or ChunkLimits()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    items = written(_items(docs, limits, windows=True))  # counted, and joined with the counts
    first = items.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "hash", "s", "e")).alias("first")).filter("times > 1")
    marked = items.join(first, "key")
    repeat = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash")) & (F.col("s") == F.col("first.s")) & (F.col("e") == F.col("first.e")))
    # spans that go back to the same lines of the same text, side by side, join into runs
    back = F.struct(F.col("first.doc_id").alias("doc"), F.col("first.hash").alias("hash"), (F.col("s") - F.col("first.s")).alias("by"))
    again = marked.filter(repeat).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(F.struct(back.alias("back"), "s", "e"))).alias("c"))
    before = lambda j: F.get(F.col("c"), j - 1)
    opens = F.transform("c", lambda x, j: F.when((j == 0) | ~(F.when(j > 0, before(j)["back"]).eqNullSafe(x["back"])) | (F.when(j > 0, before(j)["e"]) < x["s"]), j))
    again = again.withColumn("o", F.filter(opens, lambda j: j.isNotNull()))
    end = lambda j, k: F.array_max(F.transform(F.slice("c", j + 1, F.coalesce(F.get(F.col("o"), k + 1), F.size("c")) - j), lambda x: x["e"]))
    runs = F.transform("o", lambda j, k: F.struct(F.get(F.col("c"), j)["back"].alias("back"), F.get(F.col("c"), j)["s"].alias("s"), end(j, k).alias("e")))
    runs = again.select("doc_id", "hash", F.explode(runs).alias("r")).select(
        F.col("doc_id").alias("id"), F.col("hash").alias("h"), "r.s", "r.e", F.col("r.back.doc").alias("of"), F.col("r.back.hash").alias("of_hash"), (F.col("r.s") - F.col("r.back.by")).alias("of_s")
    )
    runs = runs.withColumn("key", F.xxhash64("of", F.col("of").isNull(), "of_hash", "of_s", F.col("e") - F.col("s")))
    origins = runs.select(F.col("of").alias("id"), F.col("of_hash").alias("h"), F.col("of_s").alias("s"), (F.col("of_s") + F.col("e") - F.col("s")).alias("e"), "key").distinct()
    # what to cut out of each text: runs and what they repeat
    wanted = runs.select("id", "h", "s", "e", "key", F.lit(True).alias("again")).unionByName(origins.withColumn("again", F.lit(False)))
    wanted = wanted.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e", "key", "again")).alias("cuts"))
    cut = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))).select("doc_id", "hash", F.split("text", "\n").alias("lines"), "cuts")
    body = lambda c: F.array_join(F.slice("lines", c["s"] + 1, c["e"] - c["s"]), "\n")
    cut = cut.select("doc_id", "hash", F.explode(F.transform("cuts", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["key"].alias("key"), c["again"].alias("again"), body(c).alias("body")))).alias("c")).select("doc_id", "hash", "c.*")
    firsts = cut.filter("not again").select(F.col("key").alias("k"), F.col("body").alias("first_body")).dropDuplicates(["k"])
    same = cut.filter("again").join(firsts, (F.col("key") == F.col("k")) & (F.col("body") == F.col("first_body")))
    return same.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def dedup(docs: DataFrame, limits: ChunkLimits | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated chunks removed from text, and n_lines and n_removed_lines."""
    docs = docs.drop("n_lines", "n_removed_lines")
    id_, h, cut, key, lines, rest = free(docs, "id", "h", "spans", "hash", "lines", "left")
    spans = find(docs, limits).select(F.col("doc_id").alias(id_), F.col("hash").alias(h), F.col("spans").alias(cut))
    # the hash as a column: with the columns of find() alone, both joins read one shuffle of the texts
    out = docs.withColumn(key, F.xxhash64("text"))
    out = out.join(spans, out["doc_id"].eqNullSafe(F.col(id_)) & (out[key] == F.col(h)), "left")
    out = out.withColumn(lines, F.split("text", "\n"))
    left = F.filter(lines, lambda x, i: ~F.exists(cut, lambda c: (c["s"] <= i) & (i < c["e"])))
    out = out.withColumn(rest, F.when(F.col(cut).isNull(), F.col(lines)).otherwise(left))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(rest)).cast("long")
    order = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*order, n.alias("n_lines"), gone.alias("n_removed_lines"))
