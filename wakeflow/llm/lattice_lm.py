"""Document likelihood by a subword lattice over an existing vocabulary.

A public tokenizer's vocabulary gives its pieces unigram scores (by rank, as its
words follow Zipf's law). A word with its leading blank is a lattice of all its
segmentations into pieces; the forward recursion in log space returns its marginal
probability. A token's probability mixes what the corpus teaches of whole words with
the lattice: c / (N + V + 1) + (V + 1) / (N + V + 1) * lattice(word), with c the
token's count, N all and V the distinct tokens of the training documents. The
document's score is the sum of its tokens' log10 probabilities.

Defined cases: null and empty texts have the end token only; texts without training
data get c = N = V = 0; rows that repeat a doc_id are scored one by one; an empty table
gives an empty result; other columns are ignored. Words of any length are scored whole.

Scale: counts are aggregated per chunk, task and cluster, keyed by 64-bit hashes. The
HOT most frequent words (bounded) are broadcast with their counts; every other word of
a document is joined with the count table, so what is shuffled is the corpus's rare
words, and it grows with the corpus. Row sums come back by row number, never texts.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.llm import textbytes as tb
from wakeflow.llm.common import cut, remainder

HOT = 400_000
#: no piece is left out for its length
LONGEST_PIECE = float("inf")
#: longer pieces are looked up where their first bytes, as many as this, begin one
HEAD = 8
CHUNK = 2 << 20
#: words of about so many bytes go through the lattice at once, the longest first
SLAB = 1 << 17


def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the pieces, their log scores, their lengths and the sorted hashes of the first HEAD bytes of longer ones; single bytes are always among them. ``path`` is a vocabulary file of a public tokenizer, in the format of ranks (base64 piece, rank), read by the driver."""
    if not Path(path).exists():
        raise FileNotFoundError(f"{path}: no vocabulary file")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    for b in range(256):
        ranks.setdefault(bytes([b]), len(ranks))
    pieces = list(ranks)
    weight = 1.0 / (np.array([ranks[p] for p in pieces]) + 3.0)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    starts, prefix = np.concatenate([[0], ends[:-1]]), tb.prefix_hash(data)
    hashes = tb.slice_hash(prefix, starts, ends)
    order, long = np.argsort(hashes), starts[ends - starts > HEAD]
    return hashes[order], np.log(weight / weight.sum())[order], np.unique(ends - starts), np.unique(tb.slice_hash(prefix, long, long + HEAD))


def lattice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab) -> np.ndarray:
    """Log marginal probability over all segmentations of a blank and each word [start, end)."""
    order = np.argsort(starts - ends, kind="stable")  # long words first, so that only their slabs take many steps
    slab = np.cumsum(ends[order] - starts[order] + 1) // SLAB
    out = np.empty(len(order))
    for part in np.split(order, np.flatnonzero(np.diff(slab)) + 1):
        out[part] = _slab(data, starts[part], ends[part], vocab)
    return out


def _slab(data: np.ndarray, begin: np.ndarray, ends: np.ndarray, vocab) -> np.ndarray:
    """:func:`lattice` of words sorted by length, the longest first: those that reach a step are a prefix."""
    hashes, scores, lengths, heads = vocab
    size = ends - begin + 1
    base = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(size)), size)
    inner = np.arange(base[-1]) - base[word]
    text = np.where(inner == 0, 32, data[np.maximum(begin[word] + inner - 1, 0)]).astype(np.uint8) if len(data) else np.full(base[-1], 32, np.uint8)
    prefix = tb.prefix_hash(text)
    seen = np.zeros(1 << 21, bool)
    seen[(hashes >> np.uint64(43)).astype(np.int64)] = True
    longest = int(size.max()) if len(size) else 0
    alpha = np.full(base[-1] + len(size), -np.inf)  # one more place per word: before its first byte
    place = base[:-1] + np.arange(len(size))
    alpha[place] = 0.0
    edges, open_at = [], None
    for length in lengths[lengths <= longest].tolist():
        if length > HEAD and open_at is None:  # the few places where a longer piece may begin
            open_at = np.flatnonzero(inner + HEAD < size[word])
            h = tb.slice_hash(prefix, open_at, open_at + HEAD)
            open_at = open_at[heads[np.minimum(np.searchsorted(heads, h), len(heads) - 1)] == h]
        if length > HEAD:
            at = open_at = open_at[inner[open_at] + length <= size[word[open_at]]]
        else:
            at = np.flatnonzero(inner + length <= size[word])
        h = tb.slice_hash(prefix, at, at + length)
        maybe = seen[(h >> np.uint64(43)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        ok = hashes[i] == h
        at = at[ok]
        edges.append((inner[at] + length, place[word[at]] + inner[at], np.full(len(at), length), scores[i[ok]]))
    to, source, length, score = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else [np.zeros(0, np.int64)] * 4
    by = np.lexsort((length, to))
    to, source, length, score = to[by], source[by], length[by], score[by]
    # edges of one length to one place of their words go together, places in order
    step = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (length[1:] != length[:-1]), [True]])) if len(to) else []
    for a, b in zip(step[:-1], step[1:], strict=True):
        target = source[a:b] + length[a]
        alpha[target] = np.logaddexp(alpha[target], alpha[source[a:b]] + score[a:b])
    return alpha[place + size]


def _tokens(batch_text, size=CHUNK):
    for lo, hi, data, offsets in tb.chunks(batch_text, size):
        data = tb.LOWER[data]
        starts, ends, first = tb.words(data, offsets)
        uniq, at, inverse = np.unique(tb.slice_hash(tb.prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        yield lo, hi, data, starts[at], ends[at], uniq, inverse, first


def counts(docs: DataFrame) -> DataFrame:
    """hash, c: how often each word stands in the rows of ``docs``."""

    def run(batches):
        for batch in batches:
            for _, _, _, _, _, uniq, inverse, _ in _tokens(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(uniq)).astype(np.int64))], ["hash", "c"])

    return docs.select("text").mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, training: DataFrame, path: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``, learned from the rows of ``training``."""
    spark = docs.sparkSession
    table = cut(counts(training))
    total = table.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_end = training.count()
    n, v = int(total["n"] or 0) + n_end, int(total["v"]) + (1 if n_end else 0)
    # the hot words' least count: by a histogram of counts of a fixed number of buckets
    level = F.floor(F.log2("c") * 8).cast("int")
    histogram = sorted(((r["level"], r["count"]) for r in table.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, words = None, 0
    for at, k in histogram:
        if words + k > hot:
            break
        least, words = at, words + k
    found = table.filter(level >= least).toPandas() if least is not None else None  # at most ``hot`` rows
    keys, values = (found["hash"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.float64)) if found is not None else (np.zeros(0, np.uint64), np.zeros(0))
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], values[order], vocabulary(path)))
    den, mass = n + 0.1 * (v + 1), float(n + v + 1)

    def run(batches):
        keys, values, vocab = shared.value
        task, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, starts, ends, uniq, inverse, first in _tokens(batch.column("text")):
                lat = lattice(data, starts, ends, vocab)
                at = np.minimum(np.searchsorted(keys, uniq), max(0, len(keys) - 1))
                is_hot = keys[at] == uniq if len(keys) else np.zeros(len(uniq), bool)
                c = np.where(is_hot, values[at], 0.0) if len(keys) else np.zeros(len(uniq))
                base = np.where(is_hot, np.log10((c + 0.1) / den), 0.0)
                with np.errstate(divide="ignore"):  # log 0 of a word without counts
                    own = np.where(is_hot, np.logaddexp(np.log(c / mass), np.log((v + 1) / mass) + lat) / np.log(10), 0.0)
                size, n_docs = np.diff(first), hi - lo
                end_base, end_own = np.log10((n_end + 0.1) / den), np.log10((n_end + (0 if n_end else 1)) / mass)
                rid = task + row + np.arange(n_docs)
                row += n_docs
                whole = [
                    pa.array(rid), pa.array(tb.mix64(rid.astype(np.uint64)).view(np.int64)), pa.nulls(n_docs, pa.int32()), pa.nulls(n_docs, pa.float64()), ids.slice(lo, n_docs).cast(pa.int64()), pa.array((size + 1).astype(np.int64)),
                    pa.array(tb.sum_by(first, is_hot[inverse].astype(np.int64)) + (1 if n_end else 0)),
                    pa.array(tb.sum_by(first, base[inverse]) + end_base), pa.array(tb.sum_by(first, own[inverse]) + end_own),
                ]
                rare = np.flatnonzero(~is_hot[inverse])
                key, tf = np.unique(tb.rows_of(first)[rare] * len(uniq) + inverse[rare], return_counts=True) if len(rare) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                doc, word = (key // len(uniq), key % len(uniq)) if len(rare) else (key, key)
                k = len(key)
                single = [pa.array(rid[doc]), pa.array(uniq[word].view(np.int64)), pa.array(tf.astype(np.int32)), pa.array(lat[word]), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]]
                names = ["rid", "hash", "tf", "lat", "doc_id", "n_tokens", "known", "base", "own"]
                yield pa.RecordBatch.from_arrays(whole, names)
                yield pa.RecordBatch.from_arrays(single, names)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "rid long, hash long, tf int, lat double, doc_id long, n_tokens long, known long, base double, own double")
    # a document's own row has the hash of its row number: it meets no word's count, and its sums count whatever it meets
    joined = rows.join(table, "hash", "left")
    c, tf = F.coalesce("c", F.lit(0)), F.col("tf")
    # both shares in log space: far below the least double, a lattice still tells long words apart
    seen, lat = F.when(c > 0, F.log(c / F.lit(mass))), F.col("lat") + F.lit(float(np.log((v + 1) / mass)))
    mixed = F.when(c > 0, F.greatest(seen, lat) + F.log1p(F.exp(-F.abs(seen - lat)))).otherwise(lat)
    add = [
        F.when(tf.isNull(), F.col("known")).otherwise(F.when(c > 0, tf).otherwise(0)).alias("known"),
        F.when(tf.isNull(), F.col("base")).otherwise(tf * F.log10((c + F.lit(0.1)) / F.lit(den))).alias("base"),
        F.when(tf.isNull(), F.col("own")).otherwise(tf * mixed / F.lit(float(np.log(10)))).alias("own"),
    ]
    out = joined.select("rid", "doc_id", "n_tokens", *add).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("own").alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def score_held_out(docs: DataFrame, path: str) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 10 is not 0, score all."""
    rest = remainder(F.col("doc_id"), 10)
    out = score(docs, docs.filter(rest != 0), path)
    return out.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
