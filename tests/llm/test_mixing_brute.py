"""The mix of whole tables against a plain version of its definitions, and shards written in order."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_brute_force import hash_of
from tests.llm.test_operators import SCHEMA, WORDS, docs, texts  # noqa: F401
from wakeflow.llm import mixing


def h(seed, *values):
    """xxhash64 of an int seed, as Spark has it for a 32-bit number, and further values."""
    import xxhash

    out = xxhash.xxh64_intdigest((seed & (1 << 32) - 1).to_bytes(4, "little"), 42)
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else (v[0] & (1 << 32) - 1).to_bytes(4, "little") if isinstance(v, tuple) else (v & (1 << 64) - 1).to_bytes(8, "little")
            out = xxhash.xxh64_intdigest(data, out)
    return out - (1 << 64) if out >> 63 else out


def goals(sizes, weights):
    total, fixed = sum(sizes), {i: 0 for i, s in enumerate(sizes) if not s}
    while True:
        rest = total - sum(fixed.values())
        w = sum(x for i, x in enumerate(weights) if i not in fixed)
        share = {i: rest * x / w for i, x in enumerate(weights) if i not in fixed}
        over = {i: 3 * sizes[i] for i, x in share.items() if x > 3 * sizes[i]}
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= over


def plain_mix(rows, shards=8, seed=17):
    """(doc_id, text hash, source) to (size, source_size, target, shards of the draws) of each row, by loops."""
    sized = [(d, hash_of(t or ""), s, len(WORDS.findall(t or ""))) for d, t, s in rows]
    key = {(d, x): h(seed, d, x) for d, x, _, _ in sized}
    names = sorted({s for _, _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    own = {s: [r for r in sized if r[2] == s] for s in names}
    sizes = [sum(r[3] for r in own[s]) for s in names]
    target = goals(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    taken, quota, wholes, counts = {}, [], [], []
    for number, s in enumerate(names):
        whole = min(3, int(target[number] // sizes[number])) if sizes[number] else 0
        left = max(0.0, target[number] - whole * sizes[number]) if whole < 3 else 0.0
        parts, n = [], len(own[s]) // mixing.BLOCK_DOCUMENTS
        for _ in range(mixing.LEVELS):
            parts.append(max(1, min(mixing.BLOCKS, n)))
            n //= parts[-1]
        block = lambda r, i, parts=parts: (key[r[:2]] if i == 1 else h(i, key[r[:2]])) % parts[i - 1]
        edge, place, extra = own[s], {}, set()
        for i in range(1, mixing.LEVELS + 1):
            words = Counter()
            for r in edge:
                words[block(r, i)] += r[3]
            order = sorted(words, key=lambda b, i=i, number=number: (h(seed + i, (number,), (b,)), b))
            through, part, rest, n_more = 0, None, left, 0
            for j, b in enumerate(order):
                if i == 1:
                    place[b] = j
                state = "all" if through + words[b] <= rest else "part" if through < rest else "none"
                n_more += state != "none"
                if state == "all":
                    extra |= {id(r) for r in edge if block(r, i) == b}
                if state == "part":
                    part, left = b, rest - through
                through += words[b]
            if i == 1:
                more = n_more
            edge = [r for r in edge if block(r, i) == part] if part is not None else []
        groups = defaultdict(int)
        for r in edge:
            if r[3]:
                groups[r[:2]] += r[3]
        fill = sorted(groups, key=lambda g: (key[g], g[0] is not None, g[0] or 0, g[1]))
        inside, through = set(), 0
        for g in fill:
            through += groups[g]
            if through <= left:
                inside.add(g)
        for _ in range(4):
            short = left - sum(groups[g] for g in inside)
            others = [g for g in fill if g not in inside]
            if others:
                best = min(others, key=lambda g, short=short: (abs(short - groups[g]), fill.index(g)))
                if abs(short - groups[best]) < abs(short):
                    inside.add(best)
        extra |= {id(r) for r in edge if r[:2] in inside}
        quota.append(parts[0] * whole + more)
        wholes.append(whole)
        counts.append(parts[0])
        for r in own[s]:
            draws = [i * parts[0] + place[block(r, 1)] for i in range(3) if r[3] and (i < whole or id(r) in extra)]
            taken[id(r)] = (number, draws)
    ends = np.cumsum(mixing.split_tree(quota, shards, seed), axis=0)
    out = Counter()
    for r in sized:
        number, draws = taken[id(r)]
        to = tuple(int((ends[:, number] <= d).sum()) for d in draws if d < ends[-1, number])
        out[r[0], r[2], r[3], sizes[number], round(target[number], 6), r[3] * len(to), to] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], tuple(r["shards"])) for r in df.collect())


def test_small_table_with_odd_rows(docs):  # noqa: F811
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert got(mixing.plan(docs)) == plain_mix(rows)


@pytest.mark.parametrize("blocks", [1024, 4])
def test_sources_of_many_blocks(spark, blocks, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 5)
    rng = random.Random(blocks)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) + f" {i % 50}", None, rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain_mix([(d, t, s) for d, t, _, s, _ in rows])
    assert got(mixing.plan(df)) == want and len({x for r in want for x in r[6]}) == 8


def test_shards_are_written_in_order(spark, docs, tmp_path):  # noqa: F811
    mixing.write_shards(docs, str(tmp_path / "mix"), tasks=5)
    rows = spark.read.parquet(str(tmp_path / "mix"))
    mixed = mixing.mix(docs)
    assert Counter((r["doc_id"], r["mix_shard"], r["mix_order"]) for r in rows.collect()) == Counter((r["doc_id"], r["mix_shard"], r["mix_order"]) for r in mixed.collect())
    for shard in {r["mix_shard"] for r in rows.select("mix_shard").distinct().collect()}:
        own = rows.filter(F.col("mix_shard") == shard).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("i"), "mix_order").collect()
        order = [r["mix_order"] for r in sorted(own, key=lambda r: (r["file"], r["i"]))]
        assert order == sorted(order)
