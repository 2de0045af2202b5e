"""Quality by perplexity: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model reads UTF-8 bytes, each by itself (BYTES) or in 64 classes (CLASSES), four at a time. Counts of all trusted documents
but those that set thresholds are summed by shuffles; context totals, discounts and lower orders (counts of
distinct left neighbours) come from joins of the count tables, sharded by context and
suffix. What a task needs to score a text is the table of seen four-grams, which grows
with the kinds of four-grams in the trusted texts and not with their length, and dense
tables (2**24 entries for BYTES) of back-off weights and lower-order probabilities. Each text is scored whole; a document is kept if its perplexity
is at most its language's quantile, times a slack, over all trusted documents of a share
that the model never learns from.

Defined cases: a text without bytes (null, empty) has no perplexity and is not kept;
a null language is a language of its own, one without trusted documents takes the
quantile over all of them, and if there are none, all texts are kept. Rows are scored
one by one, so repeated rows get equal results; an empty table gives an empty result.

Scale: a bitmap of SLOTS bits, broadcast, tells most documents that are not learned
from; only the others' texts are shuffled, to be joined with the trusted ids. Scores (no
texts) are checkpointed once, then joined with the labels.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.llm.common import cut
from wakeflow.llm.textbytes import chunks

ORDER = 4
#: one of so many trusted documents sets thresholds and is not learned from
HELD_OUT = 3
#: bits of the bitmap of learned ids, and of one of its rows, which Spark fixes
SLOTS, ROW = 1 << 26, 1 << 15
#: bytes that a task counts, and different codes that it holds, before it sends their counts
MOST, HELD = 1 << 30, 1 << 22


def _classes() -> np.ndarray:
    """Byte to class, 1 to 63; 0 stands before a text's first byte."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if c.islower() and b < 128:
            out[b] = 1 + b - 97
        elif c.isupper() and b < 128:
            out[b] = 27 + (b - 65) % 5
        elif 0x80 <= b < 0xC0:
            out[b] = 46 + b % 16
        elif b >= 0xC0:
            out[b] = 44 if b < 0xC4 else 45
        elif c.isdigit():
            out[b] = 32
        else:
            out[b] = 33 + {" ": 0, "\n": 1, ".": 2, ",": 3, "'": 4, "-": 5}.get(c, 6 + (c in "#*$%&|<>") + 2 * (c in "!?") + 3 * (b < 32))
    return out


CLASS = _classes()


class Alphabet(NamedTuple):
    """The symbol of each byte, the one before a text's first byte, and bits of a symbol."""

    symbols: np.ndarray
    start: int
    bits: int


#: small tables: some bytes are one
CLASSES = Alphabet(CLASS, 0, 6)
#: every byte by itself; no UTF-8 text has 255
BYTES = Alphabet(np.arange(256, dtype=np.uint8), 255, 8)


def _codes(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """For each byte the code of it and the three before it."""
    c = alphabet.symbols[data].astype(np.uint32)
    code, at = c.copy(), offsets[:-1][np.diff(offsets) > 0]
    for k in range(1, ORDER):
        c[1:] = c[:-1].copy()
        c[at] = alphabet.start
        code |= c << np.uint32(alphabet.bits * k)
    return code


def _count(alphabet: Alphabet):
    def run(batches):
        codes, counts, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                if size + len(data) > MOST or len(codes) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["code", "c"])
                    codes, counts, size = codes[:0], counts[:0], 0
                size += len(data)
                new, n = np.unique(_codes(data, offsets, alphabet), return_counts=True)
                codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["code", "c"])

    return run


def train(trusted: DataFrame, alphabet: Alphabet = CLASSES) -> dict:
    """The model of the texts of ``trusted``: for each order the seen codes, sorted, with their discounted part, and the seen contexts with their back-off weights."""
    seen = cut(trusted.select("text").mapInArrow(_count(alphabet), "code long, c long").groupBy("code").agg(F.sum("c").alias("c")))
    tables = {ORDER: seen}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = tables[n + 1].groupBy(F.col("code").bitwiseAND((1 << (n * alphabet.bits)) - 1).alias("code")).agg(F.count("*").alias("c"))
    model = {"alphabet": alphabet}
    for n in range(1, ORDER + 1):
        of = tables[n].groupBy(F.least("c", F.lit(5)).alias("c")).count().collect()  # five rows at most
        k = {r["c"]: r["count"] for r in of}
        n1, n2, n3, n4 = (k.get(i, 0) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [y, *(max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) if a else i * 0.5 for i, a, b in ((2, n2, n3), (3, n3, n4)))]
        d[0] = max(0.05, min(0.95, 1 - 2 * y * n2 / n1 if n1 else 0.5))
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        table = tables[n].withColumn("context", F.shiftright("code", alphabet.bits))
        contexts = table.groupBy("context").agg(F.sum("c").alias("all"), (F.sum(off) / F.sum("c")).alias("back"))
        joined = table.join(contexts, "context").select("code", ((F.col("c") - off) / F.col("all")).alias("part"))
        got, ctx = joined.toArrow(), contexts.select("context", "back").toArrow()  # kinds of n-grams
        code, context = got["code"].to_numpy(), ctx["context"].to_numpy()
        order, at = np.argsort(code), np.argsort(context)
        model |= {f"code{n}": code[order].astype(np.uint32), f"part{n}": got["part"].to_numpy()[order].astype(np.float32), f"context{n}": context[at].astype(np.uint32), f"back{n}": ctx["back"].to_numpy()[at].astype(np.float32)}
    return model


def _backs(model: dict, n: int) -> np.ndarray:
    """Back-off weight of each context of order ``n``; 1 for those not seen."""
    back = np.ones(1 << ((n - 1) * model["alphabet"].bits), np.float32)
    back[model[f"context{n}"]] = model[f"back{n}"]
    return back


_ready: dict[int, tuple] = {}


def log_tables(model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Natural logs: seen codes and their probabilities; of any other the weight by context and the lower-order probability by suffix. Made once in each worker."""
    tables = _ready.get(id(model))
    if tables is None:
        bits = model["alphabet"].bits
        size = 1 << bits
        lower = np.full(size, 1 / size, np.float32)
        for n in range(1, ORDER):
            lower = (_backs(model, n).reshape(-1, max(1, len(lower) // size) if n > 1 else 1, 1) * lower.reshape(1, -1, size)).ravel()
            lower[model[f"code{n}"]] += model[f"part{n}"]
        back, code = _backs(model, ORDER), model[f"code{ORDER}"]
        whole = model[f"part{ORDER}"] + back[code >> np.uint32(bits)] * lower[code & np.uint32((1 << (ORDER - 1) * bits) - 1)]
        for x in (whole, back, lower):
            np.log(np.maximum(x, np.float32(1e-9), out=x), out=x)
        tables = code, whole, back, lower
        _ready.clear()
        _ready[id(model)] = tables
    return tables


def log_table(model: dict) -> np.ndarray:
    """Natural log probability by code, of a small alphabet."""
    bits = model["alphabet"].bits
    return log_probability(np.arange(1 << ORDER * bits, dtype=np.uint32), log_tables(model), bits)


def log_probability(codes: np.ndarray, tables: tuple, bits: int) -> np.ndarray:
    seen, whole, back, lower = tables
    kinds, of = np.unique(codes, return_inverse=True)
    out = back[kinds >> np.uint32(bits)] + lower[kinds & np.uint32((1 << (ORDER - 1) * bits) - 1)]
    if len(seen):
        at = np.minimum(np.searchsorted(seen, kinds), len(seen) - 1)
        out = np.where(seen[at] == kinds, whole[at], out)
    return out[of]


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang, n_bytes and nll (natural log) of each whole text; ``model`` is a broadcast of :func:`train`'s."""

    def run(batches):
        alphabet, tables = model.value["alphabet"], log_tables(model.value)
        for batch in batches:
            nll = [np.zeros(0)]
            size = [np.zeros(0, np.int64)]
            for _, _, data, offsets in chunks(batch.column("text")):
                total = np.concatenate([[0.0], np.cumsum(log_probability(_codes(data, offsets, alphabet), tables, alphabet.bits), dtype=np.float64)])
                nll.append(total[offsets[:-1]] - total[offsets[1:]])
                size.append(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(np.concatenate(size)), pa.array(np.concatenate(nll))], ["doc_id", "lang", "n_bytes", "nll"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, lang string, n_bytes long, nll double")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the rows of ``docs`` whose doc_id is among ``ids`` (id)."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(slot("id")).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot("id"))).alias("bits")).collect()  # SLOTS bits at most
    bitmap = np.zeros(SLOTS // 8, np.uint8)
    for r in rows:
        bitmap[(r["row"] - 1) * ROW // 8 :][: ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def maybe(batches):
        for batch in batches:
            at = batch.column("slot").to_numpy() - 1
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    doc_id = F.col("doc_id").cast("long")
    some = docs.filter(doc_id.isNotNull()).select(doc_id.alias("doc_id"), slot(doc_id).alias("slot"), "text").mapInArrow(maybe, "doc_id long, slot long, text string")
    return some.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("text")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05, prior_bytes: int = 40, alphabet: Alphabet = CLASSES) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte, shrunk by ``prior_bytes``), threshold and kept for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "lang", "text")
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    aside = F.pmod(F.xxhash64(F.lit(HELD_OUT), "id"), F.lit(HELD_OUT)) == 0
    learned = _of(docs, trusted.filter(~aside))
    model = train(learned) if alphabet is CLASSES else train(learned, alphabet)
    empty = not len(model[f"code{ORDER}"])
    scored = cut(score(docs, spark.sparkContext.broadcast(model)))
    judges = trusted.filter(aside)
    marked = scored.join(judges, scored["doc_id"] == judges["id"])
    mean = marked.agg((F.sum("nll") / F.sum("n_bytes")).alias("m")).first()["m"] or 0.0
    value = F.when(F.col("n_bytes") > 0, F.exp((F.col("nll") + prior_bytes * F.lit(mean)) / (F.col("n_bytes") + prior_bytes)))
    limit = F.percentile_approx(value, quantile, 10000) * slack
    by_lang = marked.groupBy("lang").agg(limit.alias("threshold")).withColumnRenamed("lang", "of")
    overall = marked.agg(limit.alias("t")).first()["t"]
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("perplexity", value)
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    kept = (F.col("n_bytes") > 0) & (F.lit(empty) | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", kept.alias("kept"))
