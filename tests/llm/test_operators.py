"""The ten operators and the pipeline on small tables with odd rows, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wakeflow.llm import decontaminate, jaccard_join, kneser_ney, langid_crf, lattice_lm, line_dedup, mixing, quality_rules, substring_dedup, toxicity_gru
from wakeflow.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
SYLLABLES = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "xu"]


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4)))


def line(n=12):
    return " ".join(word() for _ in range(n))


def passage(lines=6):
    return "\n".join(line() for _ in range(lines))


@pytest.fixture(scope="session")
def texts():
    shared = passage(10)
    out = [passage() for _ in range(24)]
    out += [out[0], out[0], f"{line()}\n{shared}\n{line()}", f"{line()}\n{line()}\n{shared}", None, "", "   \n", "x", line(2000)]
    words = out[1].split(" ")
    words[3] = "changed"
    out += [" ".join(words), "a b c " * 40, "!!! ???"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, "s0", 0), (None, texts[4], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


def test_substrings(docs, none):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    least = 100
    seen = Counter(t[i : i + least] for _, t in rows for i in range(len(t) - least + 1))
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        want.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, least).collect()]
    assert Counter(got) == Counter(want) and sum(w[2] for w in want) > 1000
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substrings_of_hot_anchors_and_structured_texts(spark, monkeypatch):
    """At the real length, over several files: variants of one passage, copies, periodic and Thue-Morse texts, with anchors split and counted apart."""
    rng = random.Random(11)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    base, morse = own(200), "0"
    while len(morse) < 4096:
        morse += morse.translate({48: 49, 49: 48})
    rows = []
    for _ in range(120):
        w = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(200)] = own(1)
        cut = rng.randrange(120)
        rows.append(f"{own(20)} {' '.join(w[cut : cut + rng.randint(20, 200)])} {own(20)}")
    rows += [rows[0]] * 40 + [morse, morse[2048:] + own(50), morse.translate({48: 49, 49: 48})[:1500], "ab" * 700, "x" * 399, "y" * 401, own(90), None]
    texts = [(t or "").encode() for t in rows]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(9)
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    short = Counter(t[i : i + 300] for t in texts for i in range(len(t) - 299))
    want, most = set(), {}
    for d, t in enumerate(texts):
        gone, shared = bytearray(len(t)), bytearray(len(t))
        for n, count, mark in ((400, seen, gone), (300, short, shared)):
            for i in range(len(t) - n + 1):
                if count[t[i : i + n]] > 1:
                    mark[i : i + n] = b"\1" * n
        want.add((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
        most[d] = sum(shared)
    for limits in ({}, {"HOT": 2, "SHARD": 2000}, {"HOT": 10**6}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(substring_dedup, name, value)
            out = substring_dedup.remove_repeats(docs, hint=300).collect()
        assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == want and len(out) == len(rows)
        bad=[(r["doc_id"],r["n_bytes"],r["n_removed"],r["n_shared"],most[r["doc_id"]]) for r in out if not r["n_removed"] <= r["n_shared"] <= most[r["doc_id"]]]
        assert not bad, bad
    assert sum(r["n_shared"] > r["n_removed"] for r in out) > 5



def test_passages_of_other_documents(spark, monkeypatch):
    """51 words that stand in another document count, however short and whatever parts them; repeats within a document and 50 words do not."""
    rng = random.Random(17)
    own = lambda n, size=9: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, size))) for _ in range(n)]
    tiny, short, base, loop = own(51, 2), own(51, 4), own(150), own(7)
    rows = [own(70) + tiny + own(9), tiny, own(3) + tiny[:50] + own(60), own(90) + short, short + own(200), own(30) * 4, "ab " * 300, (own(30) + short + own(20)) * 2]
    rows += [own(20) + loop * 20, loop * 9, loop * 9 + own(1), loop * 40 + own(5) + tiny, tiny[:40], tiny[:40], own(60, 1), []]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = own(1)[0]
        cut = rng.randrange(80)
        rows.append(own(12) + w[cut : cut + rng.randint(20, 150)] + own(12))
    rows += [rows[-1]] * 3
    texts = [r if isinstance(r, str) else "".join(x + rng.choice(" " * 6 + "\n\t") + " " * rng.randint(0, 1) for x in r) for r in rows]
    texts += [texts[0], texts[1], texts[-1]]
    found = [WORDS.findall(t) for t in texts]
    seen = Counter(x for w in found for x in {tuple(w[i : i + 51]) for i in range(len(w) - 50)})
    want = [(d, len({j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)})) for d, w in enumerate(found)]
    assert len(" ".join(short)) < 256 and sum(n > 0 for _, n in want) > 40 and sum(n == 0 for _, n in want) > 6
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string").repartition(7)
    for limits in ({}, {"HOT": 2, "SHARD": 2000}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(substring_dedup, name, value)
            got = [(r["doc_id"], r["n_passage_words"]) for r in substring_dedup.remove_repeats(docs).collect()]
        assert sorted(got) == [*want, (len(texts), 0)]


def test_line_dedup(spark, docs, none):
    wide = docs.withColumn("n_lines", F.lit("clash")).withColumn("other", F.lit(1))
    out = line_dedup.dedup(wide)
    assert set(out.columns) == {*docs.columns, "other", "n_lines", "n_removed_lines"}
    got = {(r["doc_id"], r["n_removed_lines"] > 0): r for r in out.collect()}
    assert out.count() == docs.count()
    assert got[0, False]["text"] is not None and got[24, True]["text"] == "" and got[25, True]["text"] == ""
    assert got[26, False] and got[27, True]["n_removed_lines"] >= 3  # the shared passage goes from its second place
    assert got[28, False]["text"] is None and got[28, False]["n_lines"] == 0 and got[29, False]["text"] == ""
    # every line of the corpus still stands somewhere
    lines = lambda df: {x for r in df.collect() for x in (r["text"] or "").split("\n")}
    assert lines(out) == lines(docs)
    assert line_dedup.dedup(none).count() == 0
    # chunks of several lines are never cut at neighbouring gaps
    spans = line_dedup._items(docs, line_dedup.ChunkLimits(min_chars=0, long_line_words=10**6)).collect()
    assert all(r["e"] - r["s"] >= 2 for r in spans)


def test_line_dedup_of_short_passages(spark):
    """Passages of 2 to 5 short lines in the middle of texts, each over 50 words in all, leave every text but the first."""
    rng = random.Random(7)
    own = lambda n: " ".join("".join(rng.choice(SYLLABLES) for _ in range(4)) for _ in range(n))
    rows, want = [], {}
    for n in range(2, 6):
        shared = [own(-(-51 // n)) for _ in range(n)]
        below = [own(50 // n) for _ in range(n)]  # at most 50 words: stays
        for _ in range(6):
            parts = [[own(9) for _ in range(rng.randint(3, 6))] for _ in range(3)]
            first = not any(shared[0] in t for _, t in rows)
            want[len(rows)] = "\n".join([*parts[0], *(shared if first else []), *parts[1], *below, *parts[2]])
            rows.append((len(rows), "\n".join([*parts[0], *shared, *parts[1], *below, *parts[2]])))
    # a text without a chunk boundary of its own keeps what is around the passage
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.ChunkLimits(min_chars=0)).collect()}
    lost = lambda i: set(rows[i][1].split("\n")) - set(got[i].split("\n"))
    assert all(set(rows[i][1].split("\n")) - set(want[i].split("\n")) <= lost(i) for i, _ in rows)
    assert all(len(" ".join(lost(i)).split(" ")) >= 51 for i, _ in rows if i % 6) and not any(lost(i) for i, _ in rows if i % 6 == 0)
    assert sum(got[i] == want[i] for i, _ in rows) >= len(rows) // 2  # a chunk inside ``below`` may go besides


def test_language(spark, none):
    rows = [(i, " ".join(RNG.choice(["the", "and", "house", "green"] if i % 2 else ["der", "und", "haus", "grün"]) for _ in range(30)), "en" if i % 2 else "de", "s", 0) for i in range(80)]
    rows += [(100, None, "en", "s", 0), (101, "123 ...", "en", "s", 0), (102, "the house", None, None, None), (None, "der haus und", None, None, 0)]
    out = langid_crf.identify(spark.createDataFrame(rows, SCHEMA))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0
    assert got[102]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and 0 <= got[i]["score"] <= 1 for i in range(80))
    assert any(got[i]["held_out"] for i in range(80)) and langid_crf.identify(none).count() == 0


def test_lattice_scores(docs, none):
    import binascii
    import math

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    count = Counter()
    for d, t in rows:
        if binascii.crc32(("" if d is None else str(d)).encode()) % 10:
            count.update([*WORDS.findall((t or "").translate(low)), None])
    n, v = sum(count.values()), len(count)
    base = sorted((d if d is not None else -1, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 6)) for d, w in ((d, WORDS.findall((t or "").translate(low))) for d, t in rows))
    for hot in (5, 400_000):
        out = lattice_lm.score(docs, docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0), VOCABULARY, hot)
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out.collect())
        assert got == base and out.first()["train_tokens"] == n
    assert lattice_lm.score_held_out(none, VOCABULARY).count() == 0


def test_lattice_of_long_words_and_pieces(spark):
    import base64
    import math

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(VOCABULARY, "rb").read().splitlines() if x)}
    z = sum(1 / (r + 3) for r in ranks.values())
    logadd = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)

    def slow(word):
        word, a = b" " + word, [0.0]
        for j in range(1, len(word) + 1):
            at = -math.inf
            for n in range(1, j + 1):
                if (r := ranks.get(word[j - n : j])) is not None:
                    at = logadd(at, a[j - n] - math.log((r + 3) * z))
            a.append(at)
        return a[-1]

    words = ["international", "relationship", "\u6f22\u5b57" * 50, "\u6f22\u5b57" * 200, "x9Qz" * 250]
    long = next((p for p in ranks if len(p) > 20 and not set(p) & set(range(9, 14)) and 32 not in p and p.isascii() and p.decode().lower() == p.decode()), None)
    words += [long.decode()] if long else []
    docs = spark.createDataFrame([*[(i, w) for i, w in enumerate(words)], (100, "a b"), (101, words[4])], "doc_id long, text string")
    for hot in (0, 400_000):
        got = {r["doc_id"]: r["score"] for r in lattice_lm.score(docs, docs.filter("doc_id >= 100"), VOCABULARY, hot).collect()}
        n, v = 5, 4  # a, b, the long word and two ends
        mass = n + v + 1
        for i, w in enumerate(words):
            own = slow(w.lower().encode()) + math.log((v + 1) / mass)
            want = (logadd(own, math.log(1 / mass)) if w == words[4] else own) / math.log(10) + math.log10(2 / mass)
            assert got[i] == pytest.approx(want, rel=1e-9), (w[:20], hot)


def test_mixing(docs, none):
    out = mixing.plan(docs).collect()
    assert len(out) == docs.count() and sum(r["size"] for r in out) > 0
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
    assert sum(b[0]["target"] for b in by.values()) == pytest.approx(sum(r["size"] for r in out))
    for rows in by.values():
        off = abs(sum(r["taken"] for r in rows) - rows[0]["target"])
        assert off <= max(r["size"] for r in rows) / 2 + 1
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, out))
    mixed = mixing.mix(docs.withColumn("mix_shard", F.lit("clash")))
    assert mixed.count() >= sum(len(r["shards"]) for r in out) - 3 and dict(mixed.dtypes)["mix_shard"] == "int"
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_takes_what_the_tree_deals(spark, docs, monkeypatch):
    """Every draw of the tree, and no other, takes its block's documents; each source comes near its target."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), None, f"s{min(4, int(rng.expovariate(1.2)))}", 0) for i in range(3000)]
    many = spark.createDataFrame(rows, SCHEMA)
    dealt = []
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    monkeypatch.setattr(mixing, "split_tree", lambda draws, shards, seed, f=mixing.split_tree: dealt.append(f(draws, shards, seed)) or dealt[-1])
    out = mixing.plan(many).collect()
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    blocks = {}
    for j, source in enumerate(sorted(by)):
        rows = by[source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 3 and rows[0]["target"] <= 3 * rows[0]["source_size"]
        # shards take from a source in the shares of their draws: blocks have about as many words
        words = [sum(r["size"] * r["shards"].count(k) for r in rows) for k in range(8)]
        draws = dealt[0][:, j]
        blocks[source] = (len(rows) // 64, draws.sum())
        assert all((w > 0) <= (d > 0) for w, d in zip(words, draws, strict=True)) and abs(sum(words) - sum(r["taken"] for r in rows)) == 0
    assert max(dealt[0].sum(axis=1)) - min(dealt[0].sum(axis=1)) <= 1
    monkeypatch.setattr(mixing, "split_tree", lambda draws, shards, seed: dealt[0] * 0)
    assert sum(r["taken"] for r in mixing.plan(many).collect()) == 0


def test_clashing_columns_pass_through(spark, docs):
    """Every helper name of a stage as a column of the input, of another type, comes back as it was."""
    names = ["id", "_id", "_h", "_hash", "_spans", "_lines", "_left", "_at", "_of", "_key", "_bare", "_nth", "_host", "_frequent", "_low", "_source", "hash", "cls", "n", "key", "size", "number", "b1", "state", "comp", "text_hash", "frequent", "kept", "rep", "node"]
    wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    bench = spark.createDataFrame([(1, "no such item")], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").withColumn("id", F.lit("own id"))
    for out in (quality_rules.keep_good(wide), line_dedup.dedup(wide), jaccard_join.one_of_each(wide), decontaminate.clean(wide, bench), mixing.mix(wide)):
        rows = out.select(*names).distinct().collect()
        assert [r.asDict() for r in rows] == [{c: f"own {c}" for c in names}]
    for out in (jaccard_join.join(wide), substring_dedup.remove_repeats(wide), mixing.plan(wide), quality_rules.judge(wide), kneser_ney.classify(wide, labels), lattice_lm.score_held_out(wide, VOCABULARY), langid_crf.identify(wide), toxicity_gru.classify(wide, labels)):
        assert out.count() == docs.count()


def test_decontamination(spark, docs, none, texts):
    item = texts[5].split("\n")[2]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "zzz"), (4, item)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect()]
    assert sorted(got) == [(5, 1, 0), (5, 4, 0)]
    assert decontaminate.clean(docs, bench).count() == docs.count() - 1
    assert decontaminate.matches(docs, bench, slab_bytes=50).count() == 2
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_matches_against_edit_distance(spark):
    """Items with 0 to k + 1 edits at both edges and in the middle of texts, and items under Q bytes."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = ["ijklmnopqrst uvwxyz"[: 5 * n] for n in (1, 3)] + [noise(n) for n in (40, 75, 120)] + ["Q", "q", "zyxw"]
    rows = []
    for item in items:
        for edits in range(len(item) // 10 + 2):
            for before, after in ((0, 60), (60, 0), (40, 40)):
                text = list(item)
                for at in rng.sample(range(len(text)), edits):
                    text[at] = rng.choice(["", "#", text[at] + "#"])
                rows.append((len(rows), noise(before) + "".join(text) + noise(after)))
    rows += [(len(rows), "ends in zyx"), (len(rows) + 1, "w begins"), (len(rows) + 2, "")]

    def best(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    want = set()
    for d, text in rows:
        for i, item in enumerate(items):
            k = len(item) // 10
            k = k if len(item) - 6 - 7 * k > 0 else 0
            if (at := best(item.lower(), text.lower())) <= k:
                want.add((d, i, at))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(got) == len(want)
    assert {x[2] for x in want} >= set(range(8)) and all(best(items[r["item_id"]].lower(), rows[r["doc_id"]][1].lower()[r["start"] : r["end"]]) == r["distance"] for r in got)


def test_oracle_is_sql():
    from wakeflow.llm.queries import ORACLE_SQL

    assert all(isinstance(x, str) for x in ORACLE_SQL.values())


def test_quality_rules(spark, docs, none):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = next((x["text"] or "" for x in docs.filter(F.col("doc_id").eqNullSafe(r["doc_id"])).collect()), "")
        w = WORDS.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        held = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(held) - len(set(held)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    common = line(20)
    many = spark.createDataFrame([(i, f"{common}\n{word()} {word()}", "en", "h", 0) for i in range(40)] + [(99, f"{common}\n{passage()}", "en", "h", 0), (100, f"{common}\n{line(10)}", "en", "g", 0)], SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(many).collect()}
    assert not any(kept[i] for i in range(40)) and kept[99] and kept[100]
    assert quality_rules.keep_good(many.withColumn("kept", F.lit("clash"))).count() == 2 and quality_rules.judge(none).count() == 0


def test_frequent_lines_leave_the_texts(spark):
    common, own = "Some Common line of Words", line(15)
    rows = [(i, f"{common}\n{line(15)}", "en", "h", 9) for i in range(30)]
    rows += [(50, f"  {common.upper()}\n\n{own}", "en", "h", 9), (51, f"{common}\n{own}", "en", "g", 9), (52, f"{common}\n{own}", "en", None, 9)]
    blanks = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8"
    rows += [(60 + i, f"{blanks}\n{' '.join(word() + str(i) + 'xyzx' + str(j) for j in range(8))[:52]}", "en", "k", 9) for i in range(25)]
    got = {r["doc_id"]: r for r in quality_rules.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["text"] == rows[i][1].split("\n")[1] and got[i]["n_chars"] == len(got[i]["text"]) for i in range(30))
    assert got[50]["text"] == f"\n{own}" and all(got[i]["text"] == f"{common}\n{own}" and got[i]["n_chars"] == 9 for i in (51, 52))
    for i in range(25):
        left = len(rows[33 + i][1].split("\n")[1].replace(" ", ""))
        assert (60 + i in got) == (left >= 40 and left >= 0.3 * (left + 34))


def _components(rows, k, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for d, t in rows:
        w = WORDS.findall((t or "").translate(low))
        sets.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (d, x) in enumerate(sets):
        for j, (e, y) in enumerate(sets[:i]):
            if (x and y and 100 * len(x & y) >= percent * len(x | y)) or (x and y and d is not None and d == e):
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            names[find(i)].append(d)
    return Counter((d, len(x), min(names[find(i)], default=None) if x else d) for i, (d, x) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, docs, none, k, percent):
    base = line(120).split(" ")
    near = []
    for i in range(30):
        w = list(base)
        for _ in range(i % 6):
            w[RNG.randrange(len(w))] = word() + "q"
        near.append((200 + i, " ".join(w), None, None, None))
    rows = docs.unionByName(spark.createDataFrame(near, SCHEMA))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(rows, k, percent).collect())
    assert got == _components([(r["doc_id"], r["text"]) for r in rows.collect()], k, percent)
    assert jaccard_join.join(none).count() == 0


def test_jaccard_join_in_parts_and_blocks(spark, docs, monkeypatch):
    """Split runs and clumps change nothing; links are counted for every class."""
    base, near = line(120).split(" "), []
    for i in range(90):
        w = list(base)
        for _ in range(i % 12):
            w[RNG.randrange(len(w))] = word() + "q"
        near.append((200 + i, " ".join(w), None, None, None))
    rows = docs.unionByName(spark.createDataFrame(near, SCHEMA))
    plain = rows.select("doc_id", "text").collect()
    for percent in (60, 90):
        want = Counter(map(tuple, jaccard_join.join(rows, 3, percent).collect()))
        assert Counter((d, n, c) for (d, n, _, _, c), k in want.items() for _ in range(k)) == _components(plain, 3, percent)
        sets = {}
        low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
        for r in plain:
            w = WORDS.findall((r["text"] or "").translate(low))
            if w:
                sets[frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)))] = None
        linked = Counter(sum(x is not y and 100 * len(x & y) >= percent * len(x | y) for y in sets) for x in sets)
        assert Counter({cls: links for (_, _, cls, links, _) in want if cls is not None}.values()) == linked
        with monkeypatch.context() as m:
            for name, value in (("RUN", 4), ("LONG", 3), ("MEMBERS", 7), ("SHARE", 1 / 50), ("TELLS", 5)):
                m.setattr(jaccard_join, name, value)
            assert Counter(map(tuple, jaccard_join.join(rows, 3, percent).collect())) == want


def test_jaccard_join_of_null_ids(spark):
    w = line(100).split(" ")
    rows = [(None, " ".join(w)), (None, " ".join(["other", *w[1:]])), (None, line(40)), (5, line(40))]
    got = sorted(r["n_links"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == [0, 0, 1, 1]


def test_toxicity(spark, none):
    bad = ["idiot", "scum", "moron"]
    rows, marks = [], []
    for i in range(240):
        w = line(60).split(" ")
        if i % 3 == 0:
            for _ in range(3):
                w[RNG.randrange(60)] = RNG.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 0))
        marks.append((i, 1, int(i % 3 == 0)))
    rows += [(900, None, None, None, None), (901, "", None, None, 0)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*marks, (902, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_gru.classify(docs, labels).collect()}
    assert got[900]["score"] == got[901]["score"] == 0 and got[900]["predicted"] == 0
    held = [i for i in range(240) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 3 == 0) for i in held) / len(held) > 0.9
    assert toxicity_gru.classify(none, labels).count() == 0 and toxicity_gru.classify(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0


def test_stages_keep_and_drop_rows_not_ids(spark):
    schema, w = "doc_id long, text string", line(100).split(" ")
    near, item = " ".join(["other", *w[1:]]), line(12)
    alone, leaked, clean = line(60), f"{line(20)} {item} {line(20)}", [line(30) for _ in range(3)]
    rows = [(None, " ".join(w)), (None, near), (None, alone), (7, alone), (8, clean[0]), (8, clean[0]), (9, clean[1]), (9, clean[2]), (None, ""), (None, None)]
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, schema)).collect())
    first = {x for x in got if x[1] in (" ".join(w), near)}
    assert len(first) == 1 and got == Counter([*first, (7, alone), (8, clean[0]), (9, clean[1]), (9, clean[2]), (None, ""), (None, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, leaked), (None, clean[0]), (3, leaked), (3, clean[1]), (None, None)]
    got = Counter((r["doc_id"], r["text"]) for r in decontaminate.clean(spark.createDataFrame(rows, schema), bench).collect())
    assert got == Counter([rows[1], rows[3], rows[4]])


def test_quality_classifier(spark, none):
    clean = [(i, line(80), "en" if i % 2 else None, "s", 0) for i in range(60)]
    junk = [(100 + i, "".join(RNG.choice("QXZ#%$!!|") for _ in range(300)), "en", "s", 0) for i in range(5)]
    docs = spark.createDataFrame([*clean, *junk, (200, None, None, None, None), (201, "", "en", "s", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(docs, labels).collect()}
    assert sum(got[i] for i in range(60)) >= 58 and not any(got[i] for i in (100, 101, 102, 103, 104, 200, 201))
    assert kneser_ney.classify(none, labels).count() == 0 and kneser_ney.classify(docs, labels.limit(0)).filter("kept").count() == 65


def test_pipeline(spark, docs, none, texts, tmp_path):
    item = texts[6].split("\n")[1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{i}"))
        at = spark.read.parquet(str(tmp_path / f"out{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
        if i == 3:
            left = {r["doc_id"] for r in at.collect()}
    assert 6 not in left and not {24, 25, 28, 29, 30, 31} & left and {7, 8, 9, 10, 32} <= left
    once = Counter((r["doc_id"], r["mix_copy"]) for r in at.collect())
    assert Counter((r["doc_id"], r["mix_copy"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == once
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_components(spark, none):
    from wakeflow.llm.components import components

    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(70)] + [(500, 499 - i) for i in range(30)] + [(7, 7), (500, 490)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        i, j = sorted((root(a), root(b)))
        parent[j] = i
    alone = {x for x in parent if not any(x in e and e[0] != e[1] for e in links)}
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if x not in alone}
    assert components(none.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))).count() == 0
