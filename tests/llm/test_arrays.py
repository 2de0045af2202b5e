"""Byte helpers, suffix arrays, the CRF, the lattice and the network against plain versions."""

import base64
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeflow.llm import decontaminate, jaccard_join, kneser_ney, langid_crf, lattice_lm, mixing, substring_dedup, suffix_array, toxicity_gru
from wakeflow.llm import textbytes as tb
from wakeflow.llm.queries import VOCABULARY

TEXT = st.text(alphabet="ab \n\té\x0b", max_size=40)


@given(st.lists(TEXT | st.none(), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    data, offsets = tb.column_bytes(pa.array(texts, pa.string()))
    starts, ends, first = tb.words(data, offsets)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)] for lo, hi in zip(first[:-1], first[1:], strict=True)]
    assert got == [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert b"".join(d.tobytes() for _, _, d, _ in tb.chunks(pa.array(texts, pa.string()), 7)) == "".join(t or "" for t in texts).encode()


@given(st.lists(st.integers(1, 3), max_size=60))
@settings(max_examples=150, deadline=None)
def test_suffix_array(symbols):
    s = np.array([*symbols, 0])
    sa = suffix_array.suffix_array(s)
    assert list(sa) == sorted(range(len(s)), key=lambda i: list(s[i:]))
    plcp, phi = suffix_array.permuted_lcp(s, sa)
    for a, b in zip(sa, sa[1:], strict=False):
        n = next(k for k in range(len(s)) if s[a + k] != s[b + k])
        assert plcp[b] == n and phi[b] == a


@pytest.mark.parametrize("salt", [0, 7])
def test_anchors_cover_each_string_once_and_alike(salt):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), 900)) for _ in range(2)]
    texts += ["x" + texts[0][100:700] + "y", "a" * 1000, "b" * 399]
    data, offsets = tb.column_bytes(pa.array(texts))
    doc, anchor, lo, hi, _ = substring_dedup.anchors(data, offsets, 400, salt)
    of = {}
    for d, a, x, y in zip(doc, anchor, lo, hi, strict=True):
        for s in range(x, y + 1):
            assert (d, s) not in of
            of[d, s] = a
    assert len(of) == sum(max(0, len(t) - 399) for t in texts)
    assert all(of[0, 100 + i] == of[2, 1 + i] for i in range(201))


def test_bodies_meet_those_of_their_shard_only():
    """What is found does not follow from which shards are held together."""
    rng = np.random.default_rng(4)
    own = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    shared, long = own(300), own(450)
    bodies = [own(20) + shared + own(200), own(10) + shared + own(200), long + own(90), own(90) + long]
    count = [len(b) - 399 for b in bodies]
    apart = substring_dedup.repeated_starts(bodies, count, 400, 256, [1, 2, 3, 3])
    assert apart[1][:2] == [[], []] and apart[0] == [[], [], [(0, 50)], [(90, 140)]]
    alone = [substring_dedup.repeated_starts(bodies[a:b], count[a:b], 400, 256) for a, b in ((0, 1), (1, 2), (2, 4))]
    assert apart == tuple(sum((x[i] for x in alone), []) for i in (0, 1))
    assert substring_dedup.repeated_starts(bodies, count, 400, 256, [1, 1, 3, 3])[1][:2] == [[(20, 64)], [(10, 54)]]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    k, sizes = 3, [1, 0, 33, 70, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, tr, st_ = rng.normal(size=(first[-1], k)).astype(np.float32), rng.normal(size=(k, k)), rng.normal(size=k)
    got = langid_crf.posteriors(e, first, tr, st_)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        f, g = [np.exp(st_ + e[a])], [np.ones(k)]
        for t in range(a + 1, b):
            f.append((f[-1] @ np.exp(tr)) * np.exp(e[t]))
            f[-1] /= f[-1].sum()
        for t in range(b - 1, a, -1):
            g.append(np.exp(tr) @ (np.exp(e[t]) * g[-1]))
            g[-1] /= g[-1].sum()
        want = np.array(f) * np.array(g[::-1])
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_lattice_sums_all_segmentations():
    vocab = lattice_lm.vocabulary(VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(VOCABULARY, "rb").read().splitlines() if x)}
    weight = {p: 1 / (r + 3) for p, r in ranks.items() if len(p) <= lattice_lm.LONGEST_PIECE}
    z = sum(weight.values())

    def slow(word):
        word, a = b" " + word, [1.0]
        for j in range(1, len(word) + 1):
            a.append(sum(a[j - n] * weight.get(word[j - n : j], 0) / z for n in range(1, min(12, j) + 1)))
        return math.log(a[-1])

    words = [b"the", b"onenthe", b"a", "él".encode(), b"zq" * 30]
    ends = np.cumsum([len(w) for w in words])
    got = lattice_lm.lattice(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends, vocab)
    assert np.allclose(got, [slow(w) for w in words])


def test_lattice_memory_is_bounded():
    vocab = lattice_lm.vocabulary(VOCABULARY)
    size = np.random.default_rng(0).integers(3, 12, 200_000)
    size[777] = 3000
    ends = np.cumsum(size)
    data = np.random.default_rng(1).choice(np.frombuffer(b"etaoinshr", np.uint8), ends[-1])
    tracemalloc.start()
    got = lattice_lm.lattice(data, ends - size, ends, vocab)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    some = np.array([0, 777, 199_999])  # the same as by themselves
    assert np.array_equal(got[some], [lattice_lm.lattice(data, ends[[i]] - size[i], ends[[i]], vocab)[0] for i in some])


def test_network_gradients():
    rng = np.random.default_rng(0)
    m, x = toxicity_gru._new_model(rng), rng.normal(size=(9, 12))
    index, size = rng.integers(0, 9, (4, 32)), np.array([32, 5, 1, 20])
    grads, d_x = toxicity_gru.backward(m, x, index, size, toxicity_gru.forward(m, x, index, size, keep=True), np.ones(4))
    total = lambda: toxicity_gru.forward(m, x, index, size).sum()
    for array, grad in [(m[k], g) for k, g in grads.items()] + [(x, d_x)]:
        at = tuple(rng.integers(0, s) for s in array.shape)
        keep = array[at]
        array[at] = keep + 1e-5
        up = total()
        array[at] = keep - 1e-5
        down = total()
        array[at] = keep
        assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_windows_cover_and_overlap():
    doc, begin, size = toxicity_gru.windows_of(np.array([0, 0, 1, 33, 133]))
    for d, (a, b) in enumerate(((0, 0), (0, 1), (1, 33), (33, 133))):
        own = doc == d
        assert set().union(*[range(x, x + n) for x, n in zip(begin[own], size[own], strict=True)]) == set(range(a, b))
    assert (doc == 3).sum() == 6


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[:], i
        for j, d in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("edits", range(0, 26, 3))
def test_decontamination_finds_edited_items(edits):
    rng = np.random.default_rng(edits)
    letters = list("abcdefghij ")
    item = "".join(rng.choice(letters, 200))
    near = list(item)
    for _ in range(edits):
        i = int(rng.integers(0, len(near)))
        near[i : i + 1] = [[], ["Z"], [near[i], "q"]][int(rng.integers(0, 3))]
    text = "".join(rng.choice(letters, 300)) + "".join(near) + "".join(rng.choice(letters, 300))
    texts = ["", text.upper(), "".join(rng.choice(letters, 500))]
    data, offsets = tb.column_bytes(pa.array(texts))
    got = decontaminate.Index([(5, item)]).search(data, offsets)
    best = _distance(item.lower(), text.lower())
    assert [(d, n) for d, _, n, _, _ in got] == ([(1, best)] if best <= 20 else [])


def test_targets_and_tree():
    assert mixing.targets([10, 10, 10], [1, 1, 1]) == [10, 10, 10]
    got = mixing.targets([1, 100, 0], [5, 2, 1])
    assert got[0] == 3 and got[1] == pytest.approx(98) and got[2] == 0
    tree = mixing.split_tree([100, 7, 0, 33], 8, 1)
    assert list(tree.sum(axis=0)) == [100, 7, 0, 33] and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3
    assert (tree == mixing.split_tree([100, 7, 0, 33], 8, 1)).all()


def test_kneser_ney_is_a_distribution(spark):
    model = kneser_ney.train(spark.createDataFrame([("the cat sat on the mat",), ("the dog sat",), (None,)], "text string"))
    table = np.exp(kneser_ney.log_table(model)).reshape(-1, 64)
    assert np.allclose(table.sum(axis=1), 1, atol=2e-3)
    assert np.isfinite(np.log(table)).all()


def test_shingles():
    data, offsets = tb.column_bytes(pa.array(["a b c d", "A  b\nC d", "a b", None, "a b a b a b"]))
    sets, first = jaccard_join.shingle_sets(data, offsets, 3)
    assert list(np.diff(first)) == [2, 2, 1, 0, 2]
    cls, _ = jaccard_join.class_ids(sets, first)
    assert cls[0] == cls[1] and len(set(cls[[0, 2, 4]])) == 3


def _distance(item: bytes, text: bytes) -> int:
    """Least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        last, row = row, [i + 1]
        for j, b in enumerate(text):
            row.append(min(last[j] + (a != b), last[j + 1] + 1, row[j] + 1))
    return min(row)


@pytest.mark.parametrize(("postings", "often"), [(1_000_000, 256), (40, 256), (40, 3), (1_000_000, 3)])
def test_items_of_many_lengths_and_stock_phrases(postings, often, monkeypatch):
    """Long items beside short ones, a phrase that items share, an item that repeats itself: each as edit distance has it."""
    monkeypatch.setattr(decontaminate, "POSTINGS", postings)
    monkeypatch.setattr(decontaminate, "OFTEN", often)
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    stock = "what is the right answer to this one: "
    items = [own(rng.randint(31, 90)) for _ in range(12)] + [stock + own(rng.randint(20, 60)) for _ in range(12)] + [own(600), "ab" * 60, own(12)]
    texts = []
    for i, t in enumerate(items):
        b = list(t)
        for _ in range(len(t) // (9 if i % 5 == 4 else 20) if len(t) > 30 else 0):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "yz"])
        texts.append(own(rng.randint(0, 50)) + "".join(b) + own(rng.randint(0, 50)))
    texts += ["ab" * 45, stock * 3, own(200)]
    got = {(d, i): x for d, i, x, *_ in decontaminate.Index(list(enumerate(items))).search(*tb.column_bytes(pa.array(texts)))}
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            k = len(x) // 10 if len(x) - 6 - len(x) // 10 * 7 > 0 else 0
            if (e := _distance(x.encode(), t.encode())) <= k:
                want[d, i] = e
    assert got == want and len(want) > 20


def test_a_long_item_hides_no_short_one():
    """Many short items beside one of 120,000 bytes, in a text of 900 KB: no number in the search overflows."""
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    item, long, text = (letters[rng.integers(0, 26, n)].tobytes().decode() for n in (30, 120_000, 900_000))
    items = [(i, letters[rng.integers(0, 26, 30)].tobytes().decode()) for i in range(50_000)] + [(10**6, item), (10**6 + 1, long)]
    found = decontaminate.Index(items).search(*tb.column_bytes(pa.array([text[:800_000] + item + text[800_000:]])))
    assert [(f[1], f[2], f[3]) for f in found] == [(50_000, 0, 800_000)]


def test_a_phrase_of_all_items_stays_in_bounds(monkeypatch):
    """Many items of one stock phrase against its many places: postings are expanded part by part."""
    monkeypatch.setattr(decontaminate, "POSTINGS", 5000)
    monkeypatch.setattr(decontaminate, "OFTEN", 50)
    parts, counted = [], decontaminate.Index._counted
    monkeypatch.setattr(decontaminate.Index, "_counted", lambda self, offsets, at, begin, count: parts.append(count.sum()) or counted(self, offsets, at, begin, count))
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    stock = "which of these is the best answer "
    items = [(i, stock + own(60)) for i in range(300)]
    text = " ".join(stock + own(30) for _ in range(40)) + items[77][1] + own(5)
    found = decontaminate.Index(items).search(*tb.column_bytes(pa.array([text])))
    assert [(f[1], f[2]) for f in found] == [(77, 0)] and len(parts) > 5 and max(parts) <= 5000


def test_every_byte_is_a_symbol(spark):
    """Letters that share a class (A and F, é and ù) are told apart by the alphabet that op10 takes, whose probabilities sum to 1 too."""
    model = kneser_ney.train(spark.createDataFrame([("THE FACADE était là " * 20,), ("A dog sat",)], "text string"), kneser_ney.BYTES)
    tables = kneser_ney.log_tables(model)
    for before in (b"HE ", b"FAC", b"xyz", b"\xff\xff\xff"):
        code = np.uint32(int.from_bytes(before, "big") << 8) + np.arange(256, dtype=np.uint32)
        assert np.exp(kneser_ney.log_probability(code, tables, 8)).sum() == pytest.approx(1, abs=2e-3)
    data, offsets = tb.column_bytes(pa.array(["FACADE", "AFCFDE"]))
    p = kneser_ney.log_probability(kneser_ney._codes(data, offsets, kneser_ney.BYTES), tables, 8)
    assert kneser_ney.CLASS[ord("A")] == kneser_ney.CLASS[ord("F")] and p[:6].sum() > p[6:].sum() + 1
