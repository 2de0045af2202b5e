"""Language identification of words in code-switched text by a linear-chain CRF.

Each word is a node whose states are the learned languages. Its emission is a sum of
learned weights of affix, character n-gram and lexicon (whole word) features, hashed
into one table; transitions between languages are learned with them. Training runs
forward-backward over a bounded sample of labelled documents, spliced into sequences
that switch languages, so that the transitions see switches. Every whole text is
labelled by exact forward-backward: blocks of words are reduced to transfer matrices
side by side, joined along each document, and expanded again.

Defined cases: null text, or text without a letter, gives ``und`` with score 0; so
does every text if nothing can be learned. A null lang is never learned from.
Languages tie by name. Repeated rows get equal results; an empty table an empty one.

Scale: one pass over the texts in Arrow batches, no shuffle of texts; the model is
broadcast and has FEATURES x languages weights, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.llm import textbytes as tb
from wakeflow.llm.common import remainder

FEATURES = 1 << 17
BLOCK = 32


def features(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words [start, end), and each word's first in them (one more at the end)."""
    n, length = len(starts), ends - starts
    kinds = [tb.slice_hash(prefix, starts, ends) ^ np.uint64(1)]  # lexicon
    owner = [np.arange(n)]
    for k in (1, 2, 3):
        kinds += [tb.slice_hash(prefix, starts, np.minimum(starts + k, ends)) ^ np.uint64(1 + k), tb.slice_hash(prefix, np.maximum(ends - k, starts), ends) ^ np.uint64(4 + k)]
        owner += [np.arange(n)] * 2
    for k in (2, 3):  # n-grams
        count = np.maximum(length - k + 1, 0)
        word = np.repeat(np.arange(n), count)
        at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + starts[word]
        kinds.append(tb.slice_hash(prefix, at, at + k) ^ np.uint64(8 + k))
        owner.append(word)
    ids = (tb.mix64(np.concatenate(kinds)) >> np.uint64(64 - 17)).astype(np.int32)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(n + 1))


def emissions(weights: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    if len(first) < 2:
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[ids], first[:-1], axis=0)  # every word has features


def posteriors(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of each word's states, sequences [first[i], first[i+1]), by forward-backward in blocks."""
    n, k = emission.shape
    out = np.zeros((n, k), np.float32)
    if not n:
        return out
    length = np.diff(first)
    per = -(-length // BLOCK)  # blocks of each sequence
    block_first = np.concatenate([[0], np.cumsum(per)])
    seq = np.repeat(np.arange(len(length)), per)
    place = np.arange(len(seq)) - block_first[seq]  # block number in its sequence
    begin = first[seq] + place * BLOCK
    size = np.minimum(first[seq + 1] - begin, BLOCK)
    e = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float32)
    a, s = np.exp(transition).astype(np.float32), np.exp(start - start.max()).astype(np.float32)
    nb, eye = len(seq), np.eye(k, dtype=np.float32)
    # transfer matrices of whole blocks
    whole = np.broadcast_to(eye, (nb, k, k)).copy()
    opens = place == 0
    by_size = np.argsort(-size, kind="stable")
    active_at = [int(np.searchsorted(-size[by_size], -t, "left")) for t in range(BLOCK)]
    for t in range(BLOCK):
        on = by_size[: active_at[t]]
        if not len(on):
            break
        m = (whole[on].reshape(-1, k) @ a).reshape(-1, k, k)
        if t == 0:
            m[opens[on]] = s
        m *= e[begin[on] + t][:, None, :]
        whole[on] = m / m.sum(axis=(1, 2), keepdims=True)
    # messages at block edges, along each sequence
    ahead, behind = np.full((nb, k), 1 / k, np.float32), np.ones((nb, k), np.float32)
    longest = int(per.max())
    for j in range(1, longest):
        b = block_first[:-1][per > j] + j
        v = np.einsum("nk,nkl->nl", ahead[b - 1], whole[b - 1])
        ahead[b] = v / v.sum(axis=1, keepdims=True)
    for j in range(2, longest + 1):
        has = per >= j
        b = block_first[1:][has] - j
        v = np.einsum("nkl,nl->nk", whole[b + 1], behind[b + 1])
        behind[b] = v / v.sum(axis=1, keepdims=True)
    # words inside the blocks
    f = ahead
    for t in range(BLOCK):
        on = by_size[: active_at[t]]
        if not len(on):
            break
        v = f[on] @ a
        if t == 0:
            v[opens[on]] = s
        v *= e[begin[on] + t]
        f[on] = v = v / v.sum(axis=1, keepdims=True)
        out[begin[on] + t] = v
    g = behind
    for t in range(BLOCK - 1, -1, -1):
        on = by_size[: active_at[t]]
        if not len(on):
            continue
        at = begin[on] + t
        v = out[at] * g[on]
        out[at] = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-30)
        v = (g[on] * e[at]) @ a.T
        g[on] = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-30)
    return out


def _training_rows(docs: DataFrame, per_lang: int, longest: int) -> list[tuple[str, str]]:
    """About per_lang texts of each language, none over ``longest`` characters: a sample bounded by these."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text").between(1, longest)))
    found = rows.groupBy("lang").count().collect()  # one row per language
    if not found:
        return []
    rate = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))])
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30)
    return sorted((r["lang"], r["text"]) for r in rows.filter(draw).select("lang", "text").limit(2 * per_lang * len(found)).collect())


def train(docs: DataFrame, per_lang: int = 150, longest: int = 4000, rounds: int = 40, seed: int = 11):
    """Languages, feature weights, transitions and start weights, learned from a bounded sample of labelled rows: about ``per_lang`` texts of a language, of which at most 40 * ``per_lang`` spans of 4 to 23 words, over all languages, are learned from."""
    sample = _training_rows(docs, per_lang, longest)
    langs = sorted({x for x, _ in sample})
    k = len(langs)
    if not k:
        return langs, np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0)
    data, offsets = tb.column_bytes(pa.array([t for _, t in sample]))
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, offsets)
    prefix = tb.prefix_hash(data)
    label = np.repeat([langs.index(x) for x, _ in sample], np.diff(first))
    # sequences: spans of one text, each followed by spans of others
    rng = np.random.default_rng(seed)
    spans = []
    for i in range(len(sample)):
        at = first[i]
        while at < first[i + 1]:
            n = int(rng.integers(4, 24))
            spans.append((at, min(at + n, first[i + 1])))
            at += n
    if not spans:
        return [], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0)
    order = rng.permutation(len(spans))[: 40 * per_lang]
    # short runs of neighbours in this order make one sequence; half of the spans stand with others of their language
    half = sorted(order[: len(order) // 2], key=lambda i: label[spans[i][0]])
    spans = [spans[i] for i in [*half, *order[len(order) // 2 :]]]
    token = np.concatenate([np.arange(*x) for x in spans])
    edge = np.cumsum([0] + [b - a for a, b in spans])
    seq = np.concatenate([edge[:-1][::3], [edge[-1]]])
    _, at, inverse = np.unique(tb.slice_hash(prefix, starts[token], ends[token]), return_index=True, return_inverse=True)
    ids, word_first = features(data, prefix, starts[token][at], ends[token][at])
    gold, n = label[token], len(token)
    w, tr, st = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.zeros_like(x) for x in (w, tr, st)]
    opens = np.zeros(n, bool)
    opens[seq[:-1]] = True
    inside = np.flatnonzero(~opens)
    count = np.zeros((k, k))
    np.add.at(count, (gold[inside - 1], gold[inside]), 1)
    for _ in range(rounds):
        em = emissions(w, ids, word_first)[inverse]
        p = posteriors(em.astype(np.float32), seq, tr, st).astype(np.float64)
        # pair marginals from neighbours' marginals and potentials
        near = np.exp(tr)[None] * p[inside - 1][:, :, None] * p[inside][:, None, :]
        near /= near.sum(axis=(1, 2), keepdims=True)
        err = p.copy()
        err[np.arange(n), gold] -= 1
        by_word = np.zeros((len(at), k))
        np.add.at(by_word, inverse, err)
        owner = np.repeat(np.arange(len(at)), np.diff(word_first))
        grads = [np.stack([np.bincount(ids, by_word[owner, j], FEATURES) for j in range(k)], axis=1) / n + 1e-6 * w, (near.sum(axis=0) - count) / n + 1e-4 * tr, err[opens].sum(axis=0) / n]
        for x, g, acc in zip((w, tr, st), grads, sums, strict=True):
            acc += g * g
            x -= 0.5 * g / np.sqrt(acc + 1e-12)
    return langs, w.astype(np.float32), tr.clip(-6, 6), st


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document has a letter; only those without an ASCII letter are decoded."""
    low = tb.LOWER[data]
    found = tb.sum_by(offsets, ((low >= 97) & (low <= 122)).astype(np.int64)) > 0
    high = tb.sum_by(offsets, (data >= 128).astype(np.int64)) > 0
    for i in np.flatnonzero(~found & high):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score, n_words and words_by_lang (share of each language) of every row; ``model`` is a broadcast of :func:`train`'s."""

    def run(batches):
        langs, w, tr, st = model.value
        k = len(langs)
        for batch in batches:
            pred, score, size, share = [], [], [], []
            for _, _, data, offsets in tb.chunks(batch.column("text"), 2 * tb.CHUNK_BYTES):
                letters = has_letter(data, offsets)
                low = tb.LOWER[data]
                starts, ends, first = tb.words(low, offsets)
                prefix = tb.prefix_hash(low)
                _, at, inverse = np.unique(tb.slice_hash(prefix, starts, ends), return_index=True, return_inverse=True)
                em = emissions(w, *features(low, prefix, starts[at], ends[at])) if k else np.zeros((len(at), 0), np.float32)
                p = posteriors(em[inverse], first, tr, st) if k else np.zeros((len(starts), 0))
                n = np.diff(first)
                total = np.stack([tb.sum_by(first, p[:, j].astype(np.float64)) for j in range(k)], axis=1) if k else np.zeros((len(n), 1))
                total /= np.maximum(n, 1)[:, None]
                best = total.argmax(axis=1)
                known = letters & (n > 0) & (k > 0)
                pred += [langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                score.append(np.where(known, np.clip(total[np.arange(len(n)), best], 0, 1), 0.0))
                size.append(n)
                share += [dict(zip(langs, map(float, row), strict=True)) if ok else {} for row, ok in zip(total, known, strict=True)]
            score, size = np.concatenate([np.zeros(0), *score]), np.concatenate([np.zeros(0, np.int64), *size])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(size.astype(np.int64)), pa.array([list(x.items()) for x in share], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "n_words", "words_by_lang"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, words_by_lang map<string,double>")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 4 is not 2, then label all of them."""
    model = train(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    spark = docs.sparkSession
    out = predict(docs, spark.sparkContext.broadcast(model))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "n_words", "words_by_lang")
