"""Exact dedup, divergence audit and lexical search against plain Python, on tables with odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA
from wakeflow.llm import common, divergence, exact_dedup, jaccard_join, lexical_search

RNG = random.Random(31)
WORDS = [f"{a}{b}{c}" for a in ("ba", "Ke", "lï", "mo") for b in ("nu", "ra") for c in ("se", "ti", "日本", "x")]
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "", " 7", "!", "É"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, sentence(RNG.randint(0, 40)), ("en", "fr")[i % 2], f"s{i % 5}", 0) for i in range(120)]
    hot = sentence(9)
    out += [(200 + i, hot.replace(" ", RNG.choice([" ", "  ", "\t\n", "\x0b"])), "en", "s0", 0) for i in range(70)]
    out += [(5, out[5][1], "fr", "s0", 0), (200, hot, None, None, 0), (None, hot, "en", "s9", 0), (None, "no id", "xx", "lonely", 0), (None, "no id", "xx", "lonely", 0)]
    out += [(300, None, None, None, 0), (301, "", "de", "s1", 0), (302, "  \t ", "de", "s2", 0), (303, " ", "de", "s2", 0), (304, sentence(4000), "en", None, 0), (305, "123 --- 456", "de", "s1", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"digest": F.lit("clash"), "row": F.lit(1), "n": F.lit(2), "term": F.lit("clash")})


@pytest.mark.parametrize("heavy", [512, 1])
def test_exact_dedup(docs, rows, heavy, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want, stay = Counter(), Counter()
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            want[i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
        stay[ids[0], t] += 1
    got = exact_dedup.mark(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], norm(r["text"])) for r in kept.collect()) == stay


def test_heavy_digests_are_found_and_never_shuffled_as_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(6)
    keys, heavy, light = exact_dedup.split(docs)
    assert [r["n"] for r in heavy.collect()] == [1334] and light.count() == 2666
    assert heavy.select("first.id").first()[0] == 0 and exact_dedup.mark(docs).filter("kept").count() == 2667


def plain_audit(rows, least, k):
    group, df, names = defaultdict(Counter), Counter(), set()
    for _, text, lang, source, _ in rows:
        terms = LETTERS.findall((text or "").translate(UPPER))
        names.add((lang or "", source or ""))
        group[lang or "", source or ""].update(terms)
        df.update({(lang or "", t) for t in terms})
    out = set()
    for lang in {x for x, _ in names}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        own = {s: {t: group[lang, s][t] for t in kept} for x, s in names if x == lang}
        share = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        p = {s: share(c) for s, c in own.items()}
        q = share({t: sum(c[t] for c in own.values()) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", x[2], -x[0], i + 1) for i, x in enumerate(pair)} | {(lang, s, "term", x[2], -x[0], i + 1) for i, x in enumerate(term[:k])}
    return out


@pytest.mark.parametrize(("least", "k"), [(10, 10), (1000, 10)])
def test_audit(docs, rows, least, k):
    got = divergence.audit(docs, k, least).collect()
    want = plain_audit(rows, least, k)
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert ("de", "s1", "pair", "s2", 0, 1) in want and not any(r[0] == "xx" for r in want)


@pytest.mark.parametrize("few", [0, 3])
def test_highest_by_bits_and_bytes(spark, few):
    """Wide values, values shared by many items, long common prefixes, groups of fewer rows than k."""
    rows = [("a", RNG.choice([0, 1, 1 << 40, (1 << 40) + 1, 5000]), "é" * 9 + f"{i:03d}"[:: RNG.choice([1, 1])]) for i in range(300)]
    rows += [("b", 7, "x" * n) for n in range(1, 40)] + [("c", 3, "only"), ("d", RNG.randrange(1 << 62), "y"), ("d", 0, "z")]
    df = spark.createDataFrame(rows, "g string, v long, t string")
    want = set()
    for g in "abcd":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))
        want |= {(*r, i + 1) for i, r in enumerate(own[:12])}
    got = [tuple(r) for r in divergence.highest(df, ["g"], "v", "t", 12, few).collect()]
    assert set(got) == want and len(got) == len(want)


def test_shares_stay_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (10**14, 10**14, 5), (123_456_789_012, 987_654_321_098_765, 10**9), (5, 7, 3)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 2) // (r["n"] + 2 * r["v"]) for r in df.collect())


def plain_search(rows, items, k):
    docs = [(r[0], Counter(ALNUM.findall((r[1] or "").translate(UPPER)))) for r in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(ALNUM.findall((t or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            scored += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("shard", [1 << 25, 1500])
def test_search(spark, docs, rows, shard, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 7)
    items = [(i, sentence(RNG.randint(1, 12))) for i in range(12)] + [(3, "another row 日本"), (50, None), (51, ""), (52, "zzz unknown"), (None, "nubase 7"), (53, "7 7 É!")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    index = lexical_search.build(docs, shard)
    for k, slab in ((50, 1 << 20), (5, 100)):
        got = lexical_search.search(index, table, k, slab)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and Counter(map(tuple, got.collect())) == plain_search(rows, items, k)
    assert index.filter("term = ''").count() > (3 if shard < 10_000 else 0)


def test_packed_numbers_and_runs():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, (1 << 62) + 5])
    assert (lexical_search.unpack(lexical_search.pack(values)[0].tobytes()) == values).all() and not len(lexical_search.unpack(b""))
    rng = np.random.default_rng(3)
    cursors = [(np.sort(rng.choice(5000, n, False)), rng.integers(0, 4, n)) for n in (1, 40, 900, 3000, 5000)]
    total = np.zeros(5000, np.int64)
    for at, adds in cursors:
        total[at] += adds
    want = sorted(((int(s), -d) for d, s in enumerate(total) if s), reverse=True)
    for k, run in ((50, 64), (6000, 1000), (1, 7)):
        assert lexical_search.best_of(cursors, k, run) == [(s, -d) for s, d in want[:k]]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert exact_dedup.mark(none).count() == 0 and exact_dedup.dedup(none).count() == 0 and divergence.audit(none).count() == 0
    assert lexical_search.search(lexical_search.build(none), items).count() == 0
    assert lexical_search.search(lexical_search.build(docs), items.limit(0)).count() == 0


def test_postings_leave_the_disk_before_texts_are_shuffled(spark, monkeypatch):
    """Only what the sieve found is kept; its shuffle is gone when the clumps' texts are dealt."""
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(300 + i % 2))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = blocks.getAllFiles()
        return sum(f.length() for f in map(files.apply, range(files.size())) if "shuffle" in f.getName())

    sieve, links, seen = jaccard_join.cut, jaccard_join._links, {}

    def after(df):
        out = sieve(df)
        if "weak" in out.columns:
            seen["postings"] = held()
        return out

    def before(*args):
        end = time.time() + 5
        while held() > seen["postings"] // 2 and time.time() < end:  # files are deleted in the background
            time.sleep(0.1)
        seen["texts"] = held()
        return links(*args)

    common.release(spark)
    time.sleep(2)
    monkeypatch.setattr(jaccard_join, "cut", after)
    monkeypatch.setattr(jaccard_join, "_links", before)
    got = jaccard_join.join(docs).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got) and len(got) == 400
    assert seen["texts"] <= seen["postings"] // 2


def test_large_texts_that_meet_in_a_phrase_are_not_tied(spark):
    """A chain of unlike texts, each with a phrase of the one before and one of the next: one clump of all before, compared pair by pair."""
    phrase = lambda i: " ".join(f"p{i}x{j}" for j in range(15))
    rows = [(i, " ".join([phrase(i), *(f"w{i}x{j}" for j in range(600)), phrase(i + 1)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    postings = jaccard_join._postings(docs, 5, 80, none, {}).repartition("token", "part").sortWithinPartitions("token", "part", "n", "grp", "cls")
    assert postings.mapInArrow(jaccard_join._sieve(80), "a long, b long, weak boolean").distinct().count() < 15


def test_large_sets_about_the_threshold(spark):
    """Texts of sizes where sets begin to be met by neighbours, edited up to and beyond the threshold, against all pairs."""
    rng, texts = random.Random(3), []
    for size in (300, 340, 380, 420, 520, 700):
        base = [f"a{size}x{i}" for i in range(size)]
        for share in (0, 0.05, 0.1, 0.11, 0.115, 0.12, 0.2):
            n = round(share * size)
            swapped = {i: f"b{rng.random()}" for i in rng.sample(range(size), n)}
            texts += [[swapped.get(i, w) for i, w in enumerate(base)], base[2 * n :], base + [f"c{rng.random()}" for _ in range(2 * n)]]
    sets = [set(t) for t in texts]
    links = [sum(100 * len(a & b) >= 80 * len(a | b) for b in {frozenset(s) for s in sets} if b != a) for a in sets]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.join(docs, 1, 80).collect()}
    assert [got[i] for i in range(len(texts))] == links and max(links) > 5
