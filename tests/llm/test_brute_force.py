"""Whole queries of operators without SQL against plain Python versions of their definitions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, SYLLABLES, WORDS, _components
from wakeflow.llm import kneser_ney, langid_crf, line_dedup, mixing, toxicity_gru
from wakeflow.llm import textbytes as tb

RNG = random.Random(23)


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4)))


def line(n=12):
    return " ".join(word() for _ in range(n))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*values):
    """Spark's xxhash64 of strings and longs; nulls change nothing."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return signed(seed)


def plain_line_dedup(rows, min_chars=30, long_words=50, window=50):
    """(doc_id, text) to text, by the definitions of the module: chunks, long lines and windows, first occurrences, runs, bytes."""
    texts = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hash_of(r[1])))
    items = defaultdict(list)
    lines = {r: r[1].split("\n") for r in texts}
    for r in texts:
        own, n = lines[r], len(lines[r])
        h = [hash_of(x) for x in own]
        g = [hash_of(h[i], h[i - 1] if i else None) for i in range(n)]
        bounds = [i for i in range(n) if i == 0 or (2 <= i <= n - 2 and g[i] < g[i - 1] and g[i] <= g[i + 1])]
        spans = [(s, e) for s, e in zip(bounds, [*bounds[1:], n], strict=True) if e - s >= 2]
        spans += [(i, i + 1) for i, x in enumerate(own) if x.count(" ") >= long_words - 1]
        spans = [x for x in spans if len("\n".join(own[x[0] : x[1]])) >= min_chars]
        count = [len(WORDS.findall(x)) for x in own]
        for s in range(n):  # the shortest window of more words, from each line on and up to each line, that begins and ends with words
            if count[s]:
                e = next((e for e in range(s + 1, n + 1) if sum(count[s:e]) > window), None)
                spans += [(s, e)] if e else []
                b = next((b for b in range(s, -1, -1) if sum(count[b : s + 1]) > window), None)
                spans += [(b, s + 1)] if b is not None else []
        for s, e in set(spans):
            items[tuple(h[s:e])].append((r, s, e))
    back = defaultdict(set)
    for found in items.values():
        first = min(found, key=lambda x: (texts.index(x[0]), x[1], x[2]))
        for r, s, e in found:
            if (r, s, e) != first:
                back[r].add((first[0], s - first[1], s, e))
    out = {r: r[1] for r in rows}
    for r, spans in back.items():
        gone, runs = set(), []
        for of in {(x[0], x[1]) for x in spans}:
            for s, e in sorted((s, e) for a, b, s, e in spans if (a, b) == of):
                if runs and runs[-1][0] == of and runs[-1][2] >= s:
                    runs[-1][2] = max(runs[-1][2], e)
                else:
                    runs.append([of, s, e])
        for (first, by), s, e in runs:
            if lines[r][s:e] == lines[first][s - by : e - by]:
                gone |= set(range(s, e))
        out[r] = "\n".join(x for i, x in enumerate(lines[r]) if i not in gone)
    return out


def line_corpus():
    shared, short = [line() for _ in range(12)], [line(14) for _ in range(4)]
    rows = []
    for i in range(40):
        own = [line(RNG.randint(0, 20)) for _ in range(RNG.randint(1, 12))]
        at = RNG.randint(0, len(own))
        if i % 3 == 0:
            own[at:at] = shared[RNG.randint(0, 4) : RNG.randint(6, 12)]
        if i % 4 == 0:
            own[at:at] = short
        rows.append((i, "\n".join(own)))
    long = line(70)
    rows += [(100, f"{long}\n{line()}"), (101, f"{line()}\n{long}"), (5, rows[6][1]), (None, rows[8][1]), (None, None), (102, ""), (103, "x"), (104, rows[9][1]), (104, rows[9][1])]
    return rows


def test_line_dedup(spark):
    rows = line_corpus()
    want = plain_line_dedup(rows)
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], want[r]) for r in rows)
    assert sum(want[r] != r[1] for r in rows) > 15


def test_language(spark):
    """Predictions and scores of the query from its own model, word by word."""
    vocab = {"en": ["the", "and", "house", "green", "of"], "de": ["der", "und", "haus", "grün", "von"], "fr": ["le", "et", "maison", "vert", "de"]}
    rows = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3]
        w = [RNG.choice(vocab[lang if RNG.random() < 0.8 else RNG.choice(list(vocab))]) for _ in range(RNG.choice([1, 2, 31, 33, 70]))]
        rows.append((i, " ".join(w), lang if i % 5 else None, "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    langs, w, tr, st = langid_crf.train(docs.filter(langid_crf.remainder(F.col("doc_id"), 4) != 2))
    emission = {}
    for x in {x for r in rows for x in r[1].split()}:
        data = np.frombuffer(x.encode(), np.uint8)
        ids, _ = langid_crf.features(data, tb.prefix_hash(data), np.array([0]), np.array([len(data)]))
        emission[x] = w[ids].astype(float).sum(axis=0)
    for r in langid_crf.identify(docs).collect():
        e = [emission[x] for x in rows[r["doc_id"]][1].split()]
        f, g = [np.exp(st + e[0])], [np.ones(len(langs))]
        for x in e[1:]:
            f.append((f[-1] @ np.exp(tr)) * np.exp(x))
            f[-1] /= f[-1].sum()
        for x in e[:0:-1]:
            g.append(np.exp(tr) @ (np.exp(x) * g[-1]))
            g[-1] /= g[-1].sum()
        p = np.array(f) * np.array(g[::-1])
        mean = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
        assert r["lang_pred"] == langs[int(mean.argmax())] and r["score"] == pytest.approx(mean.max(), abs=1e-3)


def test_toxicity(spark):
    """Scores of the query from its own network, window by window and step by step."""
    rows, marks = [], []
    for i in range(90):
        w = [word() for _ in range(RNG.choice([1, 20, 32, 33, 100]))]
        if i % 3 == 0:
            w[RNG.randrange(len(w))] = "scum"
        rows.append((i, " ".join(w), "en", "s", 0))
        marks.append((i, 1, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    m = toxicity_gru.train(*toxicity_gru.sample(docs, labels, 700, 4000))
    sig = lambda x: 1 / (1 + np.exp(-x))

    def embedding(x):
        data = np.frombuffer(x.encode(), np.uint8)
        words, ids, _ = toxicity_gru.word_inputs(data, tb.prefix_hash(data), np.array([0]), np.array([len(data)]))
        return np.concatenate([m["words"][words[0]], m["chars"][ids].mean(axis=0)])

    def logit(xs):
        states = {}
        for way, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            h = np.zeros(toxicity_gru.HIDDEN)
            for t in order:
                g = xs[t] @ m[way + "x"] + m[way + "c"]
                z, r = np.split(sig(g[: 2 * toxicity_gru.HIDDEN] + h @ m[way + "u"]), 2)
                h = z * h + (1 - z) * np.tanh(g[2 * toxicity_gru.HIDDEN :] + (r * h) @ m[way + "v"])
                states[way, t] = h
        s = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(xs))])
        a = np.tanh(s @ m["a"] + m["ac"]) @ m["av"]
        a = np.exp(a - a.max())
        return (a / a.sum()) @ s @ m["o"] + m["oc"][0]

    for r in toxicity_gru.classify(docs, labels).collect():
        x = [embedding(w) for w in rows[r["doc_id"]][1].split()]
        starts = [0, *range(toxicity_gru.STRIDE, len(x) - toxicity_gru.STRIDE, toxicity_gru.STRIDE)] if len(x) > toxicity_gru.WINDOW else [0]
        best = max(logit(x[i : i + toxicity_gru.WINDOW]) for i in starts)
        assert r["score"] == pytest.approx(sig(m["scale"][0] * best + m["scale"][1]), abs=1e-4)


def test_quality_classifier_learns_from_all(spark, monkeypatch):
    """The model has every trusted document of the learned share, and no other."""
    n, learned, real = 15_000, [], kneser_ney.train
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 < 9).cast("int").alias("quality"))
    monkeypatch.setattr(kneser_ney, "train", lambda texts: learned.extend(r["text"] for r in texts.collect()) or real(texts))
    monkeypatch.setattr(kneser_ney, "MOST", 4096)  # counts are sent on and summed
    kneser_ney.classify(docs, labels)
    want = [i for i in range(n) if i % 10 < 9 and hash_of_int(kneser_ney.HELD_OUT, i) % kneser_ney.HELD_OUT]
    assert len(want) > 8000 and sorted(learned) == sorted(f"text {i}" for i in want)


def test_quality_classifier(spark):
    """Perplexities, thresholds and verdicts of the query from dictionaries of n-grams."""
    rows = [(i, line(RNG.randint(1, 40)) + RNG.choice(["", ".", " É 12"]), "en" if i % 2 else "fr", "s", 0) for i in range(80)]
    rows += [(200, None, "en", "s", 0), (201, "", None, "s", 0), (202, "QX#" * 50, None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    trusted = [i for i in range(80) if i % 3]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    aside = {i for i in trusted if hash_of_int(kneser_ney.HELD_OUT, i) % kneser_ney.HELD_OUT == 0}
    codes = {r[0]: [int(kneser_ney.CLASS[b]) for b in (r[1] or "").encode()] for r in rows}
    top = Counter()
    for i in set(trusted) - aside:
        c = [0] * 3 + codes[i]
        top.update(tuple(c[j : j + 4]) for j in range(len(codes[i])))
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = Counter(k[1:] for k in counts[n + 1])
    off, total, back = {}, {}, {}
    for n, table in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in table.values()) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        d = [max(0.05, min(0.95, 1 - 2 * y * n2 / n1)), *(max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) if a else i * 0.5 for i, a, b in ((2, n2, n3), (3, n3, n4)))]
        off[n] = lambda v, d=d: d[min(v, 3) - 1]
        total[n], back[n] = Counter(), Counter()
        for k, v in table.items():
            total[n][k[:-1]] += v
            back[n][k[:-1]] += off[n](v)

    def p(k):
        n = len(k)
        if not n:
            return 1 / 64
        if not total[n][k[:-1]]:
            return p(k[1:])
        v = counts[n][k]
        return ((v - off[n](v)) if v else 0) / total[n][k[:-1]] + back[n][k[:-1]] / total[n][k[:-1]] * p(k[1:])

    nll = {}
    for i, c in codes.items():
        padded = [0] * 3 + c
        nll[i] = -sum(math.log(max(1e-9, p(tuple(padded[j : j + 4])))) for j in range(len(c)))
    size = {i: len(c) for i, c in codes.items()}
    mean = sum(nll[i] for i in aside) / sum(size[i] for i in aside)
    value = {i: math.exp((nll[i] + 40 * mean) / (size[i] + 40)) for i in codes if size[i]}
    worst = {x: max(value[i] for i in aside if x is None or rows[i][2] == x) * 1.05 for x in ("en", "fr", None)}
    for r in kneser_ney.classify(docs, labels).collect():
        i = r["doc_id"]
        if not size[i]:
            assert r["perplexity"] is None and not r["kept"]
            continue
        assert r["perplexity"] == pytest.approx(value[i], rel=1e-3) and r["threshold"] == pytest.approx(worst[r["lang"]], rel=1e-3)
        assert r["kept"] == (r["perplexity"] <= r["threshold"])
    assert len(aside) > 10


def hash_of_int(n, x):
    """Spark's xxhash64 of an int and a long."""
    seed = xxhash.xxh64_intdigest((n & (1 << 32) - 1).to_bytes(4, "little"), 42)
    return signed(xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed))


def test_pipeline(spark, tmp_path, monkeypatch):
    """run() against plain versions of its stages, one after the other; the mix by what the tree deals."""
    common = "Subscribe to our letter"
    rows = [(i, f"{t}\n{common}" if i % 2 else t, "en", f"s{i % 3}", 0) for i, t in line_corpus() if i is not None and t is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(300 + i, f"{line(20)}\n{common}", "en", "s1", 0) for i in range(30)]
    base = line(80).split(" ")
    for i in range(6):
        w = list(base)
        w[10 + i] = "changed"
        rows.append((400 + i, " ".join(w), "en", "s2", 0))
    item = line(14)
    rows += [(500, f"{line(15)} {item.upper()} {line(15)}", "en", "s0", 0), (501, f"{line(15)} {item[:40]}# {item[42:]}", "en", "s0", 0), (502, "a b c d e f g " * 20, "en", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # quality rules: frequent lines of a source go, then words, repeats and what is left
    docs = []
    hold, hosts = Counter(), Counter()
    for s, t in {(r[3], r[1]) for r in rows}:
        hosts[s] += 1
        hold.update((s, x) for x in {x.lower().strip(" ") for x in t.split("\n")} - {""})
    for d, t, _, s, _ in rows:
        w = WORDS.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        kept = [x for x in t.split("\n") if not (hold[s, x.lower().strip(" ")] > 20 and hold[s, x.lower().strip(" ")] > 0.01 * hosts[s])]
        chars, left = sum(map(len, w)), sum(len(x) for k in kept for x in WORDS.findall(k))
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w) and left >= 40 and left >= 0.3 * chars:
            docs.append((d, "\n".join(kept), s))
    assert 0 < len(rows) - len(docs) and any(common in r[1] for r in rows) and not any(common in t for _, t, s in docs if s == "s1")
    # line dedup
    short = plain_line_dedup([(d, t) for d, t, _ in docs])
    docs = [(d, short[d, t], s) for d, t, s in docs if short[d, t] == t or short[d, t].replace("\n", "").replace("\t", "").strip(" ")]
    # one document of each component of five-word shingles
    names = _components([(d, t) for d, t, _ in docs], 5, 80)
    alone = {d for d, n, c in names if d == c or not n}
    docs = [x for x in docs if x[0] in alone]
    assert sum(400 <= x[0] < 406 for x in docs) == 1

    def best(a, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    plain = lambda t: re.sub("[\t-\r]", " ", t.lower())
    docs = [x for x in docs if best(plain(item), plain(x[1])) > len(item) // 10]
    assert not {500, 501} & {x[0] for x in docs}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {d: t for d, t, _ in docs}
    assert {(r["doc_id"], r["text"]) for r in out} <= set(whole.items())
    taken, size = Counter(r["doc_id"] for r in out), {d: len(WORDS.findall(t)) for d, t, _ in docs}
    sources = sorted({s for _, _, s in docs})
    sizes = [sum(size[d] for d, _, s in docs if s == x) for x in sources]
    for x, goal in zip(sources, mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sources))]), strict=True):
        got = sum(taken[d] * size[d] for d, _, s in docs if s == x)
        assert abs(got - goal) <= max(size[d] for d, _, s in docs if s == x) and all(taken[d] <= 3 for d in size)
    assert len(out) > 20
