"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles, by 64-bit hashes. Documents of
equal sets are one class, by two such hashes of the whole set. Shingles are ordered from rare to frequent (those frequent
in some chunk of documents are counted over the corpus; all others come first, by
hash), and classes with the same prefix and size form one group. Groups that share a
prefix shingle meet in that shingle's run; sizes, positions and 256-bit parity
signatures sieve their pairs. Large sets, which differ in more shingles than such a
signature can tell, and meet unlike ones in some shingle in any large corpus, meet by
neighbours instead: by pairs of shingles that follow one another in a set's order of
hashes, of which linked sets share most. They are sieved again by histograms of their
shingles. What passes ties
classes into clumps: every pair that may link lies in one. A clump's members are
expanded and all their pairs verified by the exact intersections of their whole sets;
links between classes and equality within them give the components.

Defined cases: null text and text without words give an empty set, linked with
nothing, a component of its own; a text of fewer words than a shingle is one shingle;
rows that repeat a doc_id are one document per text and take the smallest component
they reach; a null doc_id is linked by its text and never names a component unless it
is alone (then null); an empty table gives an empty result; other columns are ignored.

Scale: no list of pairs leaves a task. The sieves send spanning forests of the pairs
that pass, a clump's task one row for each member: its part and its number of links.
Equal texts collapse before anything is paired. Runs of more than RUN documents are
split into pairs of parts, and clumps of more than MEMBERS classes (or SHINGLES
shingles) into pairs of blocks, each pair a key of its own; so a group of m classes
that are near copies of one another costs m / MEMBERS copies of its texts, the price
of deciding all its pairs. At most FREQUENT shingles are broadcast. Postings are dealt in
turns, each of some of the tokens, and leave the disk before the next and before texts are
shuffled.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.llm import textbytes as tb
from wakeflow.llm.common import cut, free, release, written
from wakeflow.llm.components import components

#: a shingle is frequent if this share of a block of documents has it
SHARE = 1 / 2000
BLOCK_SHINGLES = 3_000_000
#: the most frequent shingles that are told from rare ones, at most
FREQUENT = 1_000_000
WORDS = 4  # 64-bit words of a signature
SIGNATURE = [f"sig{i}" for i in range(WORDS)]
#: linked sets that differ in more shingles than this may look unlike by chance alone: they are large
TELLS = 90
#: the bit of a part that marks a run of neighbours
NEXT = 1 << 60
#: counts of a histogram
COUNTS = 1024
#: bits of a set's hash that are its class
CLASS_BITS = 64
#: percent of a large set's neighbours whose postings are on disk at once, about
AT_ONCE = 20
#: a run of more documents is split; in runs of more classes than LONG, classes that are tied already are not compared again
RUN, LONG = 16_384, 64
#: a clump of more classes, or more shingles, is split into blocks
MEMBERS, SHINGLES = 2048, 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and each document's first."""
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, offsets)
    h = tb.slice_hash(tb.prefix_hash(data), starts, ends)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    out = np.zeros(len(doc), np.uint64)
    for i in range(k):  # short texts: the whole sequence as one
        inside = at + i < first[1:][doc]
        out = np.where(inside, tb.mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + i, max(0, len(h) - 1))] + np.uint64(i)), out) if len(h) else out
    ends = np.cumsum(count)
    for lo, hi in zip((ends - count).tolist(), ends.tolist(), strict=True):
        out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    doc, out = doc[new], out[new]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def class_ids(sets: np.ndarray, first: np.ndarray, renamed: dict[tuple[int, int], int] | None = None, bits: int = CLASS_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set. The first is its class, but for those ``renamed`` by both."""
    total = tb.sum_by(first, tb.mix64(sets ^ np.uint64(0x5851F42D4C957F2D)))
    cls = tb.mix64(total + np.diff(first).astype(np.uint64)).view(np.int64) >> np.int64(64 - bits)
    check = tb.mix64(tb.sum_by(first, tb.mix64(sets * np.uint64(0xFF51AFD7ED558CCD) ^ np.uint64(0x14057B7EF767814F)))).view(np.int64)
    if renamed:
        cls = np.array([renamed.get(x, x[0]) for x in zip(cls.tolist(), check.tolist(), strict=True)], np.int64)
    return cls, check


def _renamed(labelled: DataFrame) -> dict[tuple[int, int], int]:
    """New classes of the sets whose class has other sets too, by their second hash: one in 2^64 pairs of sets, so a few hundred of 10^11 sets."""
    full = labelled.filter("n > 0").select("cls", "check")
    shared = full.groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a < b").select("cls")
    found = sorted((r["cls"], r["check"]) for r in full.join(shared, "cls", "left_semi").distinct().collect())
    taken = {c for c, _ in found}
    out, free_ = {}, itertools.count()
    for pair in found:
        out[pair] = next(x for x in (int(tb.mix64(np.array([i], np.uint64))[0].astype(np.int64)) for i in free_) if x not in taken)
    return out


def need(n1, n2, percent: int):
    """Least intersection of sets of these sizes for percent * union <= 100 * intersection."""
    return -(-percent * (n1 + n2) // (100 + percent))


def large(n, percent: int):
    """Whether linked sets of such a size may differ in more than TELLS shingles."""
    return 2 * n * (100 - percent) > TELLS * (100 + percent)


def by_neighbours(n, percent: int):
    """Whether a set of such a size may link with a large one: pairs with a large set are found by neighbours.

    Neighbours are shingles that follow one another in a set's order of hashes. Of two sets
    with c shingles in common, c - 1 neighbours are common too but for one at most for each
    shingle that only one set has, so linked sets share most of them; unlike sets that meet
    in a few shingles share none. Low percentages do not bound that, so shingles serve there.
    """
    bound = (2 * percent - 100) * percent * TELLS * (100 + percent) >= 20_000 * (100 - percent)  # one at least, for the smallest that may link with a large set
    return large(n * 100 // percent, percent) & bound


def histograms(sets: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """COUNTS counts, modulo 256, of the shingles of each of the sets ``rows`` by hash."""
    out = np.zeros((len(rows), COUNTS), np.uint8)
    for i, row in enumerate(rows):
        out[i] = np.bincount((sets[first[row] : first[row + 1]] >> np.uint64(54)).astype(np.int64), minlength=COUNTS).astype(np.uint8)
    return out


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and document counts of frequent shingles."""

    def flush(held, docs_seen):
        token, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= max(3, SHARE * docs_seen)
        return pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(n[some].astype(np.int64)), pa.array(np.where(np.arange(some.sum()) == 0, docs_seen, 0).astype(np.int64))], ["token", "n", "docs"])

    def run(batches):
        held, seen, size = [], 0, 0
        for batch in batches:
            for lo, hi, data, offsets in tb.chunks(batch.column("text")):
                sets, _ = shingle_sets(data, offsets, k)
                held.append(sets)
                seen, size = seen + hi - lo, size + len(sets)
                if size > BLOCK_SHINGLES:
                    yield flush(held, seen)
                    held, seen, size = [], 0, 0
        if held:
            yield flush(held, seen)

    n_docs = docs.count()
    found = cut(docs.select("text").mapInArrow(run, "token long, n long, docs long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(3, int(n_docs * SHARE))))
    # the least count of the most frequent: by a histogram of a fixed number of buckets
    level = F.floor(F.log2("n") * 8).cast("int")
    least, rows = None, 0
    for at, n in sorted(((r["level"], r["count"]) for r in found.groupBy(level.alias("level")).count().collect()), reverse=True):
        if rows + n > FREQUENT:
            break
        least, rows = at, rows + n
    rows = found.filter(level >= least if least is not None else F.lit(False)).toPandas()  # at most FREQUENT rows
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["n"].to_numpy(np.int64)[order]


def _parity(mixed: np.ndarray, doc: np.ndarray, n: int, words: int) -> np.ndarray:
    """A signature of 64 * words bits for each of n sets: bit i is the parity of the shingles whose hash is i modulo 64 * words."""
    width = 64 * words
    odd = np.bincount(doc * width + (mixed % np.uint64(width)).astype(np.int64), minlength=width * n).reshape(n, words, 64) & 1
    return (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _postings(docs: DataFrame, k: int, percent: int, frequent, renamed, turn: int = 0, turns: int = 1) -> DataFrame:
    """token, part, n, pos, grp, cls and signature of the prefix of each document that is new to its task: of its shingles, and of its neighbours if it may link with a large one.

    A frequent token's run has parts; a row goes to each pair of parts that has its own.
    Rows of neighbours have no signature, as it would not tell large sets. Of ``turns`` this
    one has its share of the tokens, each with its whole run.
    """
    bits = CLASS_BITS

    def first_of(token, rank, doc, held, prefix, size):
        """Of the elements of each set, ``held`` in number and in the order of their (first) hashes, the ``prefix`` first, rare ones before others: set, token, rank, position and group."""
        order = np.argsort(doc << 40 | rank, kind="stable")
        token, rank, doc = token[order], rank[order], doc[order]
        start = np.cumsum(held) - held
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix64(token))])
        grp = tb.mix64(total[start + np.minimum(prefix, held)] - total[start] + size.astype(np.uint64)).view(np.int64)
        pos = np.arange(len(token)) - np.repeat(start, held)
        keep = (pos < prefix[doc]) & (tb.mix64(token) % np.uint64(turns) == turn)
        return doc[keep], token[keep], rank[keep], pos[keep], grp[doc[keep]]

    def run(batches):
        token, count = frequent.value
        known: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in tb.chunks(batch.column("text")):
                sets, first = shingle_sets(data, offsets, k)
                cls, n = class_ids(sets, first, renamed, bits)[0], np.diff(first)
                _, one = np.unique(cls, return_index=True)
                one = np.array([i for i in one if n[i] and int(cls[i]) not in known], np.int64)
                if len(known) < 1_000_000:
                    known.update(map(int, cls[one]))
                if not len(one):
                    continue
                size = n[one]
                doc = np.repeat(np.arange(len(one)), size)
                item = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + first[one][doc]
                sets = sets[item]
                rank = np.zeros(len(sets), np.int64)  # rare first, then by count
                if len(token):
                    at = np.minimum(np.searchsorted(token, sets), len(token) - 1)
                    rank = np.where(token[at] == sets, count[at], 0)
                paired = by_neighbours(size, percent)
                single = ~(paired & large(size, percent))
                sig = _parity(tb.mix64(sets), doc, len(one), WORDS)
                pair = np.flatnonzero((doc[1:] == doc[:-1]) & paired[doc[1:]])
                both = tb.mix64(sets[pair] * np.uint64(0x9E3779B97F4A7C15) + sets[pair + 1])
                # linked sets share one of these: of all shingles, and of all neighbours but one for each shingle they differ in
                alone = first_of(sets[single[doc]], rank[single[doc]], doc[single[doc]], np.where(single, size, 0), size - (-(-percent * size // 100)) + 1, size)
                nexts = first_of(both, np.minimum(rank[pair], rank[pair + 1]), doc[pair], np.where(paired, size - 1, 0), size + 1 - (-(-(2 * percent - 100) * size // 100)), size)
                kind = np.repeat([0, 1], [len(alone[0]), len(nexts[0])])
                doc, sets, rank, pos, grp = (np.concatenate(x) for x in zip(alone, nexts, strict=True))
                parts = np.maximum(1, -(-rank // RUN))
                own = cls[one][doc].view(np.uint64) % parts.astype(np.uint64)
                to = np.repeat(np.arange(len(parts)), parts)
                other = np.arange(len(to)) - np.repeat(np.cumsum(parts) - parts, parts)
                own = own[to].astype(np.int64)
                part = np.minimum(own, other) << 20 | np.maximum(own, other) | kind[to] * NEXT
                doc, sets, pos, grp, kind = doc[to], sets[to], pos[to], grp[to], kind[to]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.view(np.int64)), pa.array(part), pa.array(size[doc].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(grp), pa.array(cls[one][doc]), *[pa.array(np.where(kind, 0, sig[doc, i].view(np.int64))) for i in range(WORDS)]],
                    ["token", "part", "n", "pos", "grp", "cls", *SIGNATURE],
                )

    return docs.select("text").mapInArrow(run, "token long, part long, n int, pos int, grp long, cls long, " + ", ".join(f"{c} long" for c in SIGNATURE))


def _sieve(percent: int):
    """Ties (a, b, weak) of classes that share a prefix token and may link: a spanning forest of the task's pairs, and one of the weak ones, of large sets. Input rows are sorted by token, part, n, grp, cls."""

    def runs(*keys):
        """Where a new run of equal keys begins."""
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return new

    def similar(n, sig, p, q):
        """Which of the rows p and q may link by what their signatures bound: they differ in at least as many shingles as bits."""
        return np.bitwise_count(sig[p] ^ sig[q]).sum(axis=1) <= n[p] + n[q] - 2 * need(n[p], n[q], percent)

    def group_pairs(n, pos, kind, x, y):
        """Which pairs of groups, by a row of each, may link by size and by what is left of their sets, or of their neighbours."""
        least = need(n[x], n[y], percent)
        least = np.where(kind[x], 3 * least - n[x] - n[y], least)  # neighbours in common, and 1 as there are n - 1
        return (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= least)

    def short(run, n, pos, kind, grp, sig):
        """All pairs that pass, of the rows of runs of at most LONG."""
        # groups: equal prefix and size, so equal in every run they share
        first = np.flatnonzero(runs(run, grp))
        size = np.diff(np.append(first, len(run)))
        p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        member = np.repeat(np.arange(len(first)), size)
        i, d = np.flatnonzero(pos == 0), 1  # members of one group meet once, at their first shingle
        while len(i):
            i = i[i + d < len(run)]
            i = i[member[i] == member[i + d]]
            good = similar(n, sig, i, i + d)
            p.append(i[good])
            q.append(i[good] + d)
            d += 1
        i, d = np.arange(len(first)), 1
        while len(i):
            i = i[i + d < len(first)]
            x, y = first[i], first[i + d]
            on = (run[x] == run[y]) & (100 * n[x] >= percent * n[y])
            i, x, y = i[on], x[on], y[on]
            ok = group_pairs(n, pos, kind, x, y)
            x, y, nx, ny = x[ok], y[ok], size[i[ok]], size[i[ok] + d]
            for part in np.array_split(np.arange(len(x)), max(1, int((nx * ny).sum()) // 2_000_000)):  # expand groups, bounded
                total = nx[part] * ny[part]
                k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
                width = np.repeat(ny[part], total)
                u, v = np.repeat(x[part], total) + k // width, np.repeat(y[part], total) + k % width
                good = similar(n, sig, u, v)
                p.append(u[good])
                q.append(v[good])
            d += 1
        return np.concatenate(p), np.concatenate(q)

    def long(rows, n, pos, kind, grp, sig):
        """A spanning forest of the pairs that pass in one long run: from each class only to those that nothing is tied to yet."""
        first = rows[runs(grp[rows])]
        member = np.cumsum(runs(grp[rows])) - 1  # the group of each row of the run
        alone = np.arange(len(rows))
        p, q = [], []
        while len(alone):
            ready, alone = [alone[0]], alone[1:]
            while ready and len(alone):
                at = ready.pop()
                ok = group_pairs(n, pos, kind, np.full(len(first), rows[at]), first)
                meets = alone[ok[member[alone]]]
                meets = meets[similar(n, sig, np.full(len(meets), rows[at]), rows[meets])]
                if len(meets):
                    p.append(np.full(len(meets), rows[at]))
                    q.append(rows[meets])
                    ready.extend(meets.tolist())
                    alone = np.setdiff1d(alone, meets, assume_unique=True)
        return p, q

    def ties(cols):
        token, part, n, pos, grp, cls, *_ = cols
        some = runs(token, part, cls)
        opens = runs(token, part) if len(token) else np.zeros(0, bool)
        run = (np.cumsum(opens) - 1)[some]
        some = np.flatnonzero(some)[np.bincount(run, minlength=1)[run] > 1]
        if not len(some):
            return [np.zeros(0, np.int64)] * 3
        run = (np.cumsum(opens) - 1)[some]
        length = np.bincount(run)[run]
        n, pos, kind, grp, cls = (x[some] for x in (n, pos, part // NEXT, grp, cls))
        sig = np.stack([x[some] for x in cols[6:]], axis=1).view(np.uint64)
        brief = np.flatnonzero(length <= LONG)
        p, q = short(run[brief], n[brief], pos[brief], kind[brief], grp[brief], sig[brief])
        p, q = [brief[p]], [brief[q]]
        rest = np.flatnonzero(length > LONG)
        for rows in np.split(rest, np.flatnonzero(np.diff(run[rest])) + 1) if len(rest) else []:
            x, y = long(rows, n, pos, kind, grp, sig)
            p += x
            q += y
        p, q = np.concatenate(p), np.concatenate(q)
        return cls[p], cls[q], ((kind[p] > 0) | large(np.maximum(n[p], n[q]), percent)).astype(np.int64)

    def run(batches):
        parents: tuple[dict, dict] = ({}, {})  # of the classes that the task has tied, and weakly

        def root(parent, x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def tie(cols):
            a, b, weak = ties(cols)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), weak], axis=1), axis=0) if len(a) else np.zeros((0, 3), np.int64)
            for x, y, w in pair.tolist():
                i, j = root(parents[w], x), root(parents[w], y)
                parents[w][max(i, j)] = min(i, j)

        held = None  # a run may go on in the next batch
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "part", "n", "pos", "grp", "cls", *SIGNATURE)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            held = [c[end:] for c in cols]
            if end:
                tie([c[:end] for c in cols])
        if held is not None and len(held[0]):
            tie(held)
        # stars about the smallest class: tasks that tie the same classes send the same ties
        for weak, parent in enumerate(parents):
            stars = [(x, root(parent, x)) for x in parent]
            for i in range(0, len(stars), 100_000):
                part = np.array([x for x in stars[i : i + 100_000] if x[0] != x[1]], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(np.full(len(part), weak > 0))], ["a", "b", "weak"])

    return run


def shared_counts(tokens: np.ndarray, first: np.ndarray, rows: np.ndarray, others: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of ``rows`` with each of ``others``; set i is tokens[first[i] : first[i + 1]]."""
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]  # shingles of one set alone have none
    owner = tb.rows_of(first)
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(rows), len(others)), np.int32)
    n = int(column[-1]) + 1 if len(column) else 0
    width = min(width, -(-n // 64) * 64)
    for lo in range(0, n, max(1, width)):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((len(first) - 1, width), bool)
        dense[owner[a:b], column[a:b] - lo] = True
        bits = np.packbits(dense, axis=1).view(np.uint64)
        other = bits[others]
        for i, row in enumerate(rows):
            out[i] += np.bitwise_count(other & bits[row]).sum(axis=1, dtype=np.int32)
    return out


def _places(batches, columns: list[str], make):
    """Batches of make(i, j, rows) for the rows of each place (clump, i, j), which follow one another; of rows of one class the first. A class alone has no place."""
    at, rows, seen = None, [], set()
    for batch in batches:
        for c, i, j, cls, *rest in zip(*[batch.column(c).to_pylist() for c in ("clump", "i", "j", "cls", *columns)], strict=True):
            if (c, i, j) != at:
                if len(rows) > 1:
                    yield make(*at[1:], rows)
                at, rows, seen = (c, i, j), [], set()
            if cls not in seen:
                seen.add(cls)
                rows.append((cls, *rest))
    if len(rows) > 1:
        yield make(*at[1:], rows)


def _refine(percent: int):
    """Of the large classes of places: ties of those that may link by their histograms, which differ by no more than the sets; a spanning forest."""

    def place(i, j, rows):
        cls, side, n = (np.array([r[c] for r in rows], np.int64) for c in range(3))
        fine = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        coarse = fine.reshape(len(rows), -1, 8).sum(axis=2, dtype=np.uint8)
        label, a, b = np.arange(len(rows)), [], []
        order = np.argsort(n, kind="stable")
        ends = np.searchsorted(n[order], n[order] * 100 // percent, "right")
        for at, row in enumerate(order):
            y = order[at + 1 : ends[at]]
            y = y[label[y] != label[row]]
            y = y if i == j else y[side[y] != side[row]]
            most = n[row] + n[y] - 2 * need(n[row], n[y], percent)
            for sig in (coarse, fine):
                d = sig[y] - sig[row]
                good = np.minimum(d, -d).sum(axis=1, dtype=np.int64) <= most
                y, most = y[good], most[good]
            if len(y):
                _, first = np.unique(label[y], return_index=True)
                for other in y[first]:
                    a.append(cls[row])
                    b.append(cls[other])
                    label[label == label[other]] = label[row]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lambda batches: _places(batches, ["side", "n", "sig"], place)


def _decide(k: int, percent: int):
    """Of the texts of places, sorted by place: each class of a place with one that it is tied to by links, and its number of links there."""

    def place(i, j, rows):
        cls, side = (np.array([r[c] for r in rows], np.int64) for c in range(2))
        parts = [shingle_sets(data, offsets, k) for _, _, data, offsets in tb.chunks(pa.array([r[2] for r in rows], pa.large_string()))]
        sets, n = np.concatenate([x for x, _ in parts]), np.concatenate([np.diff(first) for _, first in parts])
        first = np.concatenate([[0], np.cumsum(n)])
        x = np.flatnonzero(side == i)
        y = x if i == j else np.flatnonzero(side == j)
        common = shared_counts(sets, first, x, y)
        links, label = np.zeros(len(cls), np.int64), np.arange(len(cls))
        for at, row in enumerate(x):
            if i == j:
                met = y[at + 1 :][100 * common[at, at + 1 :].astype(np.int64) >= percent * (n[row] + n[y[at + 1 :]] - common[at, at + 1 :])]
            else:
                met = y[100 * common[at].astype(np.int64) >= percent * (n[row] + n[y] - common[at])]
            if len(met):
                links[row] += len(met)
                links[met] += 1
                join = np.unique(label[np.append(met, row)])
                if len(join) > 1:
                    label[np.isin(label, join)] = join[0]
        on = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cls[on]), pa.array(cls[label[on]]), pa.array(links[on])], ["a", "b", "links"])

    return lambda batches: _places(batches, ["side", "text"], place)


def _dealt(clumps: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """classes (cls, n and more) of the clumps with their clump, side and ``blocks``, of at most MEMBERS classes and ``most`` shingles."""
    members = clumps.select("node", F.col("comp").alias("clump")).join(classes, F.col("node") == F.col("cls")).drop("node")
    size = members.groupBy("clump").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / most)).cast("int").alias("blocks"))
    return members.join(size, "clump").withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))


def _in_places(rows: DataFrame) -> DataFrame:
    """Rows of :func:`_dealt` once for each pair of blocks that has theirs, dealt by it."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "blocks")
    return other.repartition("clump", "i", "j").sortWithinPartitions("clump", "i", "j")


def _links(docs: DataFrame, classes: DataFrame, clumps: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, links: each linked class, one that it is tied to by links, and its number of links (in parts, if its clump has blocks)."""
    members = _dealt(clumps, classes, SHINGLES).select("clump", "blocks", "side", "cls", F.col("of.doc_id").alias("_id"), F.col("of.hash").alias("_hash"))
    texts = docs.join(members, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["hash"] == F.col("_hash"))).select("clump", "blocks", "side", "cls", "text")
    return _in_places(texts).mapInArrow(_decide(k, percent), "a long, b long, links long")


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, class_id (of equal sets), n_links (of the class with other classes) and component_id of every row."""
    out = _grouped(docs, k, percent, tie=True)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(docs: DataFrame, k: int, percent: int, tie: bool) -> DataFrame:
    """doc_id, hash (of the text), cls, n, n_links, comp and component_id of every row; ``tie``: rows of one doc_id are one document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    bits = CLASS_BITS

    def label(batches):
        for batch in batches:
            ids, n, sig = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.int64)], []
            for _, _, data, offsets in tb.chunks(batch.column("text")):
                sets, first = shingle_sets(data, offsets, k)
                ids.append(np.stack(class_ids(sets, first, bits=bits)))
                n.append(np.diff(first))
                some = np.flatnonzero(large(n[-1] * 100 // percent, percent))  # as of by_neighbours: by the largest that it may link with
                body = dict(zip(some.tolist(), histograms(sets, first, some), strict=True))
                sig += [body[i].tobytes() if i in body else None for i in range(len(n[-1]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *map(pa.array, np.concatenate(ids, axis=1)), pa.array(np.concatenate(n).astype(np.int64)), pa.array(sig, pa.binary())], ["doc_id", "hash", "cls", "check", "n", "sig"])

    labelled = written(docs.mapInArrow(label, "doc_id long, hash long, cls long, check long, n long, sig binary"))
    renamed = _renamed(labelled)
    if renamed:
        other = F.create_map(*[F.lit(x) for (c, check), new in renamed.items() for x in (f"{c}:{check}", new)])
        labelled = labelled.withColumn("cls", F.coalesce(F.try_element_at(other, F.concat_ws(":", "cls", "check")), "cls"))
    labelled = labelled.drop("check")
    rows = labelled.drop("sig")
    full = rows.filter("n > 0")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min(_row_key()).alias("of"), F.max("n").alias("n"))
    frequent = spark.sparkContext.broadcast(_frequent(docs, k))
    turns, found = max(1, -(-2 * (100 - percent) // AT_ONCE)), []
    for turn in range(turns):  # no more than one turn's postings are on disk
        postings = _postings(docs, k, percent, frequent, renamed, turn, turns).repartition("token", "part").sortWithinPartitions("token", "part", "n", "grp", "cls")
        found.append(cut(postings.mapInArrow(_sieve(percent), "a long, b long, weak boolean").distinct()))
        del postings
        release(spark)
    ties = functools.reduce(DataFrame.unionByName, found)
    near = labelled.filter(F.col("sig").isNotNull()).select("cls", "n", "sig").dropDuplicates(["cls"])
    refined = cut(_in_places(_dealt(components(ties.filter("weak").select("a", "b")), near, 1 << 62).select("clump", "blocks", "side", "cls", "n", "sig")).mapInArrow(_refine(percent), "a long, b long"))
    clumps = components(ties.filter("not weak").select("a", "b").unionByName(refined))
    release(spark)  # the postings' shuffle: texts are shuffled next
    links = cut(_links(docs, classes, clumps, k, percent))
    release(spark)
    # rows of one doc_id and several texts tie their classes together
    tied = full.filter("doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b").select("a", "b")
    more = full.join(tied, F.col("cls") == F.col("a"), "left_semi").select("doc_id", F.col("cls").alias("a")).join(full.select("doc_id", F.col("cls").alias("b")), "doc_id").filter("a < b").select("a", "b").distinct()
    edges = links.filter("a <> b").select("a", "b")
    found = components(edges.unionByName(more) if tie else edges).select(F.col("node").alias("cls"), "comp")
    named = classes.select("cls", "rep").join(found, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    degree = links.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("n_links"))
    final = named.join(names, "comp").join(degree, "cls", "left").select(F.col("cls").alias("c"), "comp", "component_id", "n_links")
    return rows.join(final, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left")


def _row_key():
    """Orders rows of a group: known ids first, lowest first, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies: a known doc_id before a null one, the lowest, then by text and the other columns. Texts without words all stay, and so do unlike texts of one doc_id."""
    rows = _grouped(docs, k, percent, tie=False)
    at, of, key, bare, nth = free(docs, "at", "of", "key", "bare", "nth")
    best = rows.filter("n > 0").groupBy("comp").agg(F.min(_row_key()).alias("key")).select("key.doc_id", "key.hash", F.lit(False).alias(bare))
    stay = best.unionByName(rows.filter("n = 0").select("doc_id", "hash", F.lit(True).alias(bare)).distinct())
    stay = stay.select(F.col("doc_id").alias(at), F.col("hash").alias(of), bare)
    out = docs.withColumn(key, F.xxhash64("text"))
    out = out.join(stay, out["doc_id"].eqNullSafe(F.col(at)) & (F.col(key) == F.col(of)))
    again = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return out.withColumn(nth, F.row_number().over(again)).filter(F.col(bare) | (F.col(nth) == 1)).select(*[f"`{c}`" for c in docs.columns])
