"""Hashes forced to collide change no result: texts of one class, windows of one hash, sets of one class."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, WORDS, _components, docs, line, none, texts, word  # noqa: F401
from wakeflow.llm import jaccard_join, quality_rules, substring_dedup


def test_texts_of_one_class(docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(substring_dedup, "CLASS_DIGITS", 1)
    rows, least = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()], 100
    seen = Counter(t[i : i + least] for _, t in rows for i in range(len(t) - least + 1))
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        want.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    got = substring_dedup.remove_repeats(docs, least).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter(want)


def test_windows_of_one_hash(spark, monkeypatch):
    plain = quality_rules.F.xxhash64
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: plain(*c) % 3)
    rows = [(i, t, None, None, 0) for i, t in enumerate([line(60), "a b c d e " * 3, f"{line(30)} p q r s t {line(9)} p q r s t u", line(4), "", "x y " * 40 + line(30)])]
    for r in quality_rules._base(spark.createDataFrame(rows, SCHEMA)).collect():
        w = WORDS.findall(rows[r["doc_id"]][1])
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert r["n_repeat_words"] == len({j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_sets_of_one_class(spark, docs, monkeypatch):  # noqa: F811
    base, near = line(80).split(" "), []
    for i in range(20):
        w = list(base)
        for k in range(i % 5):
            w[7 * k + i % 3] = word() + "q"
        near.append((200 + i, " ".join(w), None, None, None))
    rows = docs.unionByName(spark.createDataFrame(near, SCHEMA))
    want = Counter((r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard_join.join(rows).collect())
    monkeypatch.setattr(jaccard_join, "CLASS_BITS", 3)
    got = jaccard_join.join(rows).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"]) for r in got) == want
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _components([(r["doc_id"], r["text"]) for r in rows.select("doc_id", F.col("text")).collect()], 3, 90)
