"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash beside the mean embedding of its character
n-grams and prefixes. Two gated recurrent layers read a window of WINDOW words in
both directions; attention pools their states into one logit. The windows of a text
overlap by half and cover all of it; the document's score is its highest window's.
Training (backpropagation through time, Adam) takes a bounded sample of labelled
documents; a toxic document teaches only by its windows that already score highest,
since the label says that some window is toxic, not which. The first component of an embedding starts from the evidence of the sample, how far the
share of toxic documents that have the word or n-gram lies from that of the others, so
that few toxic documents suffice. Scores become probabilities by a scale and shift
fitted to the scores of documents that FOLDS networks have not seen, and shifted from
the label shares of the sample to those of all labelled documents.

Defined cases: a text without words (null, empty) scores 0; without labelled rows of
both kinds the network is not trained and all scores are 0; rows whose label is null
are not learned from; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.

Scale: one pass over the texts in Arrow batches and no shuffle of texts. The sample is
bounded by ``per_class`` ids and ``longest`` characters; the broadcast model has a fixed
size. Memory follows the chunk: word projections and states of one chunk's windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.llm import textbytes as tb
from wakeflow.llm.common import remainder

WINDOW, STRIDE = 32, 16
SLOTS, DIM, HIDDEN, ATTEND = 1 << 13, 6, 8, 8
FOLDS = 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_inputs(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Slot of each word, and slots of its character features with each word's first."""
    slot = lambda h, kind: (tb.mix64(h ^ np.uint64(kind)) >> np.uint64(64 - 13)).astype(np.int32)
    words = slot(tb.slice_hash(prefix, starts, ends), 0)
    n, length = len(starts), ends - starts
    ids, owner = [], []
    for k in (2, 3, 4):
        ids.append(slot(tb.slice_hash(prefix, starts, np.minimum(starts + k, ends)), k))
        owner.append(np.arange(n))
    for k in (3, 4):
        count = np.maximum(length - k + 1, 0)
        word = np.repeat(np.arange(n), count)
        at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + starts[word]
        ids.append(slot(tb.slice_hash(prefix, at, at + k), 10 + k))
        owner.append(word)
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return words, ids[order], np.searchsorted(owner[order], np.arange(n + 1))


def embed(m: dict, words, ids, first) -> np.ndarray:
    if not len(words):
        return np.zeros((0, 2 * DIM), np.float32)
    chars = np.add.reduceat(m["chars"][ids], first[:-1], axis=0) / np.diff(first)[:, None]
    return np.concatenate([m["words"][words], chars], axis=1)


def windows_of(first: np.ndarray, stride: int = STRIDE):
    """(document, first word, number of words) of the windows that cover each document."""
    n = np.diff(first)
    per = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), per)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * stride
    return doc, first[doc] + begin, np.minimum(n[doc] - begin, WINDOW)


def forward(m: dict, x: np.ndarray, index: np.ndarray, size: np.ndarray, keep: bool = False):
    """Logits of the windows; index[w, t] is the row in x of word t. keep: all that backpropagation needs."""
    n, steps = index.shape
    states, saved = np.zeros((steps, n, 2 * HIDDEN), x.dtype), []
    for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        proj = x @ m[way + "x"] + m[way + "c"]
        u, v = m[way + "u"], m[way + "v"]
        h = np.zeros((n, HIDDEN), x.dtype)
        cols = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, 2 * HIDDEN)
        for t in order:
            g = proj[index[:, t]]
            zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ u)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ v)
            on = (t < size)[:, None]
            after = np.where(on, z * h + (1 - z) * new, h)
            if keep:
                saved.append((way, t, h, z, r, new, on))
            h = after
            states[t][:, cols] = h
    att = np.tanh(states @ m["a"] + m["ac"])
    e = np.where(np.arange(steps)[:, None] < size[None, :], att @ m["av"], -1e9)
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, states)
    logit = pooled @ m["o"] + m["oc"][0]
    return (logit, saved, states, att, w, pooled) if keep else logit


def backward(m: dict, x, index, size, cache, d_logit) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters, and of x."""
    _, saved, states, att, w, pooled = cache
    g = {k: np.zeros_like(v) for k, v in m.items() if k not in ("words", "chars", "scale")}
    g["o"], g["oc"] = pooled.T @ d_logit, np.array([d_logit.sum()])
    d_pool = d_logit[:, None] * m["o"]
    d_w = np.einsum("nh,tnh->tn", d_pool, states)
    d_states = w[:, :, None] * d_pool[None]
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    g["av"] = np.einsum("tn,tnk->k", d_e, att)
    d_att = d_e[:, :, None] * m["av"] * (1 - att**2)
    g["a"], g["ac"] = np.einsum("tnh,tnk->hk", states, d_att), d_att.sum(axis=(0, 1))
    d_states = d_states + d_att @ m["a"].T
    d_x = np.zeros_like(x)
    d_h, way_now = None, None
    d_proj = {}
    for way, t, h, z, r, new, on in reversed(saved):
        if way != way_now:
            way_now, d_h = way, np.zeros_like(h)
            d_proj[way] = np.zeros((len(x), 3 * HIDDEN), x.dtype)
        cols = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, 2 * HIDDEN)
        d_h = d_h + d_states[t][:, cols]
        live = np.where(on, d_h, 0)
        d_new = live * (1 - z) * (1 - new**2)
        d_rh = d_new @ m[way + "v"].T
        d_zr = np.concatenate([live * (h - new) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
        g[way + "u"] += h.T @ d_zr
        g[way + "v"] += (r * h).T @ d_new
        np.add.at(d_proj[way], index[:, t], np.concatenate([d_zr, d_new], axis=1))
        d_h = np.where(on, live * z + d_rh * r + d_zr @ m[way + "u"].T, d_h)
    for way, d in d_proj.items():
        g[way + "x"], g[way + "c"] = x.T @ d, d.sum(axis=0)
        d_x += d @ m[way + "x"].T
    return g, d_x


def _new_model(rng) -> dict:
    m = {"words": np.zeros((SLOTS, DIM)), "chars": rng.normal(0, 0.3, (SLOTS, DIM))}
    for way in "fb":
        m |= {way + "x": rng.normal(0, 0.3, (2 * DIM, 3 * HIDDEN)), way + "c": np.zeros(3 * HIDDEN), way + "u": rng.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)), way + "v": rng.normal(0, 0.3, (HIDDEN, HIDDEN))}
    return m | {"a": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "ac": np.zeros(ATTEND), "av": rng.normal(0, 0.3, ATTEND), "o": rng.normal(0, 0.3, 2 * HIDDEN), "oc": np.zeros(1)}


def _evidence(doc: np.ndarray, slot: np.ndarray, toxic: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """For each slot, by how many standard errors, beyond 3, the share of toxic documents of ``keep`` with it lies from that of the others; over 4 and within 2."""
    pair = np.unique(doc[keep[doc]].astype(np.int64) * SLOTS + slot[keep[doc]])
    count = [np.bincount((pair % SLOTS)[toxic[pair // SLOTS] == y], minlength=SLOTS) for y in (0, 1)]
    n0, n1 = (max(1, int((keep & (toxic == y)).sum())) for y in (0, 1))
    p = (count[0] + count[1]) / (n0 + n1)
    z = (count[1] / n1 - count[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    return np.clip(np.sign(z) * np.maximum(np.abs(z) - 3, 0) / 4, -2, 2)


def train(texts: list[str], toxic: list[int], totals: tuple[int, int] | None = None, epochs: int = 8, batch: int = 256, seed: int = 3) -> dict | None:
    """The network, learned from a sample of documents; None without both labels.

    Its scale turns a document's highest logit into a probability: so that documents that
    were not learned from, in one of FOLDS networks each, are toxic as often as it says.
    ``totals``: how many documents of labels 0 and 1 the sample stands for.
    """
    data, offsets = tb.column_bytes(pa.array(texts, pa.string()))
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, offsets)
    doc, begin, size = windows_of(first, WINDOW)
    rng, toxic = np.random.default_rng(seed), np.asarray(toxic, np.int64)
    label = toxic[doc] if len(doc) else np.zeros(0)
    if not (label == 1).any() or not (label == 0).any():
        return None
    prefix = tb.prefix_hash(data)
    _, at, inverse, seen = np.unique(tb.slice_hash(prefix, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    words, ids, word_first = word_inputs(data, prefix, starts[at], ends[at])
    index = inverse[np.minimum(begin[:, None] + np.arange(WINDOW), len(inverse) - 1)]
    # words too rare to learn from have no embedding of their own; their characters speak for them
    common = np.bincount(words, seen, SLOTS) >= 5
    known = np.bincount(ids, minlength=SLOTS) > 0
    word_doc = tb.rows_of(first)
    uses = np.unique(word_doc * len(at) + inverse)  # a word of a document once
    use_doc, use_word = uses // len(at), uses % len(at)
    per = np.diff(word_first)[use_word]
    char_doc = np.repeat(use_doc, per)
    char_slot = ids[np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(word_first[use_word], per)]

    def fit(keep: np.ndarray) -> dict:
        m = {k: v.astype(np.float32) for k, v in _new_model(rng).items()}
        m["words"][:, 0] = _evidence(use_doc, words[use_word], toxic, keep) * common
        m["chars"][:, 0] = _evidence(char_doc, char_slot, toxic, keep)
        m["chars"][~known] = 0
        moment, square, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
        own = keep[doc]
        use, rows = own.copy(), min(batch, max(16, int(own.sum()) // 40))  # small samples take as many steps
        for epoch in range(epochs):
            if epoch != 1:  # of toxic documents, only the windows near their best: at first by evidence
                x = embed(m, words, ids, word_first)
                score = _logits(m, x, index, size) if epoch else np.where(np.arange(WINDOW) < size[:, None], 2 * np.maximum(x[index, 0], x[index, DIM]), -9).max(axis=1)
                best = np.full(len(texts), -np.inf)
                np.maximum.at(best, doc, score)
                use = own & ((label == 0) | (score >= best[doc] - 1))
            weight = np.where(label == 1, 0.4 / max(1, (use & (label == 1)).sum()), 0.6 / max(1, (own & (label == 0)).sum())) * use.sum()
            order = rng.permutation(np.flatnonzero(use))
            for i in range(0, len(order), rows):
                some = order[i : i + rows]
                local, place = np.unique(index[some], return_inverse=True)
                place = place.reshape(len(some), WINDOW)
                count = word_first[local + 1] - word_first[local]
                lf = np.concatenate([[0], np.cumsum(count)])
                f = np.arange(lf[-1]) - np.repeat(lf[:-1], count) + np.repeat(word_first[local], count)
                x = embed(m, words[local], ids[f], lf).astype(np.float32)
                cache = forward(m, x, place, size[some], keep=True)
                d = ((_sigmoid(cache[0]) - label[some]) * weight[some] / len(some)).astype(np.float32)
                g, d_x = backward(m, x, place, size[some], cache, d)
                share = d_x[:, DIM:] / count[:, None]
                lo = np.repeat(np.arange(len(local)), count)
                g["words"] = np.stack([np.bincount(words[local], d_x[:, j], SLOTS) for j in range(DIM)], axis=1) * common[:, None]
                g["chars"] = np.stack([np.bincount(ids[f], share[lo, j], SLOTS) for j in range(DIM)], axis=1)
                step += 1
                for k, v in m.items():
                    grad = (g[k] + 1e-5 * v).astype(np.float32)
                    moment[k] = 0.9 * moment[k] + 0.1 * grad
                    square[k] = 0.99 * square[k] + 0.01 * grad**2
                    v -= 0.01 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        m["chars"][~known] = 0
        m["words"][~common] = 0
        return m

    # highest logits of documents by networks that have not seen them, over windows as they are scored
    all_doc, all_begin, all_size = windows_of(first)
    all_index = inverse[np.minimum(all_begin[:, None] + np.arange(WINDOW), len(inverse) - 1)]
    fold = np.empty(len(texts), np.int64)
    for y in (0, 1):  # each fold has its share of either label
        own = rng.permutation(np.flatnonzero(toxic == y))
        fold[own] = np.arange(len(own)) % FOLDS
    z = np.full(len(texts), -np.inf)
    for k in range(FOLDS):
        if len(np.unique(label[fold[doc] != k])) < 2:
            continue
        m = fit(fold != k)
        some = np.flatnonzero(fold[all_doc] == k)
        np.maximum.at(z, all_doc[some], _logits(m, embed(m, words, ids, word_first), all_index[some], all_size[some]))
    on = np.isfinite(z)
    z, y = z[on], toxic[on]
    a, b = 1.0, 0.0
    if (y == 1).any() and (y == 0).any():
        for _ in range(2000):
            e = _sigmoid(a * z + b) - y
            a, b = max(0.05, a - 0.1 * ((e * z).mean() / max(1.0, (z * z).mean()) + 1e-3 * (a - 1))), b - 0.1 * e.mean()
    if totals and min(totals) > 0 and len(np.unique(y)) == 2:  # the shares of the sample are not those of the documents
        b += np.log(totals[1] / totals[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return fit(np.ones(len(texts), bool)) | {"scale": np.array([a, b], np.float32)}


def _logits(m: dict, x: np.ndarray, index: np.ndarray, size: np.ndarray, part: int = 8192) -> np.ndarray:
    x = x.astype(np.float32)
    return np.concatenate([np.zeros(0, np.float32), *[forward(m, x, index[i : i + part], size[i : i + part]) for i in range(0, len(size), part)]])


def sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> tuple[list[str], list[int], tuple[int, int]]:
    """Texts and labels: at most per_class toxic documents and twice as many others, one text each (of rows that repeat an id the first by code points), none over ``longest`` characters; and how many documents have label 0 and 1."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(remainder(F.col("doc_id"), 5) != 0)
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    pick = None
    for label in (0, 1):
        own = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class * (2 - label))
        pick = own if pick is None else pick.unionByName(own)
    pick = pick.withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, longest)).join(F.broadcast(pick), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # a row an id
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows)
    return [r[1] for r in rows], [r[2] for r in rows], (count.get(0, 0), count.get(1, 0))


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, n_windows and score of every row; ``model`` is a broadcast of :func:`train`'s."""

    def run(batches):
        m = model.value
        for batch in batches:
            score, count = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in tb.chunks(batch.column("text")):
                data = tb.LOWER[data]
                starts, ends, first = tb.words(data, offsets)
                doc, begin, size = windows_of(first)
                best = np.full(len(offsets) - 1, -np.inf)
                if m is not None and len(doc):
                    prefix = tb.prefix_hash(data)
                    _, at, inverse = np.unique(tb.slice_hash(prefix, starts, ends), return_index=True, return_inverse=True)
                    x = embed(m, *word_inputs(data, prefix, starts[at], ends[at])).astype(np.float32)
                    for i in range(0, len(doc), 8192):
                        index = inverse[np.minimum(begin[i : i + 8192, None] + np.arange(WINDOW), len(inverse) - 1)]
                        np.maximum.at(best, doc[i : i + 8192], forward(m, x, index, size[i : i + 8192]))
                some = np.isfinite(best)
                score.append(np.where(some, _sigmoid(m["scale"][0] * np.where(some, best, 0) + m["scale"][1]), 0.0) if m is not None else np.zeros(len(best)))
                count.append(np.bincount(doc, minlength=len(best)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(count).astype(np.int64)), pa.array(np.concatenate(score).clip(0, 1))], ["doc_id", "n_windows", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_windows long, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 700, longest: int = 4000) -> DataFrame:
    """Learn from labelled documents whose crc32(doc_id) mod 5 is not 0, then score all."""
    model = train(*sample(docs, labels, per_class, longest))
    out = predict(docs, docs.sparkSession.sparkContext.broadcast(model))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_windows")
