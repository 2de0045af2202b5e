"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item of m bytes may stand in a text with at most k = rate * m edits. Each
edit spoils at most q of its m - q + 1 q-grams, so a true occurrence shares at least
T = m - q + 1 - k * q of them with the text, on diagonals at most k apart. Shared
q-grams are counted in overlapping bands of 2 * (k + 1) diagonals; bands that meet T
are verified by banded alignment of the whole item. Letters A-Z are lower-cased and
white space is blank on both sides; nothing else is normalised.

Defined cases: null and empty texts match nothing; items too short for T > 0 (under
about 30 bytes) are looked up as they are, without edits; null items are skipped;
repeated rows give repeated results; equal items each match; an empty table on either
side gives an empty result; other columns are ignored.

Scale: texts are read once a slab in Arrow batches and never shuffled. Items are broadcast in
slabs of about ``slab_bytes`` (some 30 bytes a byte of text), one at a time: a slab's
matches are written and its broadcast released before the next is indexed, so a larger
benchmark takes more passes, not more memory. Equal items are one entry. Of grams that very
many items share, an item leaves out as many as its bound allows and lowers the bound by
their number; what is found so must meet the whole bound before it is aligned. Postings are
expanded in parts of at most POSTINGS and candidates aligned in parts of CELLS, so a
phrase of all items costs time, not memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.llm import textbytes as tb
from wakeflow.llm.common import free, written

Q = 7
RATE = 0.1
NORMAL = tb.LOWER.copy()
NORMAL[tb.SPACE] = 32
#: postings that are expanded, and cells of an alignment that are held, at once
POSTINGS = 1_000_000
CELLS = 2_000_000
#: of a first count of bands, a power of 2
BUCKETS = 1 << 20
#: places of a gram in the items of a slab from which on items do without it if they can
OFTEN = 256
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def _grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each place as one number; the last places stand for less."""
    code = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(Q, np.uint8)])
    for k in range(Q):
        code = (code << np.uint64(8)) | padded[k : k + len(data)].astype(np.uint64)
    return code


class Index:
    """q-grams of a slab of items: sorted codes, their places, and budgets."""

    def __init__(self, items: list[tuple[int, str]]):
        same: dict[str, list[int | None]] = {}
        for i, t in items:
            same.setdefault(t, []).append(i)
        self.ids = list(same.values())  # of each text
        self.data, self.offsets = tb.column_bytes(pa.array(list(same), pa.string()))
        self.data = NORMAL[self.data]
        m = np.diff(self.offsets)
        self.k = np.floor(RATE * m).astype(np.int64)
        need = m - Q + 1 - self.k * Q
        self.k[need <= 0] = 0
        self.need = np.maximum(m - Q + 1 - self.k * Q, 1)
        place = np.arange(len(self.data))
        item = np.repeat(np.arange(len(m)), m)
        full = place + Q <= self.offsets[1:][item] if len(place) else np.zeros(0, bool)
        code, place, item = _grams(self.data)[full], place[full], item[full]
        order = np.argsort(code, kind="stable")  # by gram, item and place
        self.codes, gram = np.unique(code[order], return_inverse=True)
        item, pos = item[order], (place - self.offsets[item])[order]
        # grams of very many places are left out of an item's bound, the most frequent first, as long as one is needed
        times = np.bincount(gram, minlength=1)[gram] if len(gram) else gram
        often = np.flatnonzero(times > OFTEN)
        often = often[np.lexsort((gram[often], -times[often], item[often]))]
        nth = np.arange(len(often)) - np.searchsorted(item[often], item[often])
        left_out = often[nth < self.need[item[often]] - 1]
        self.least = self.need - np.bincount(item[left_out], minlength=len(m))
        kept = np.ones(len(order), bool)
        kept[left_out] = False
        gram, item, pos = gram[kept], item[kept], pos[kept]
        here, gram = np.unique(gram, return_inverse=True)
        self.codes = self.codes[here]
        self.item, self.pos = item.astype(np.int32), pos.astype(np.int32)
        self.order = gram.astype(np.int64) * len(self.ids) + self.item
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(self.codes)] = True
        # items without a q-gram, by length: their sorted bytes as numbers, and the items of each
        self.short = {}
        for size in range(1, Q):
            own = np.flatnonzero(m == size)
            if len(own):
                code, which = np.unique(_grams(self.data)[self.offsets[:-1][own]] >> np.uint64(8 * (Q - size)), return_inverse=True)
                self.short[size] = (code, [own[which == j] for j in range(len(code))])
        # classes of similar length, for the first sieve: window and least hits
        self.sieve = []
        long = m[m >= Q]
        lo = int(long.min()) if len(long) else 0
        while len(long) and lo <= long.max():
            hi = int(lo * 1.3) + 1
            own = np.flatnonzero((m >= lo) & (m < hi))
            if len(own):
                self.sieve.append((int((m[own] + self.k[own]).max()), int(self.least[own].min())))
            lo = hi

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, end) of the best occurrence of each item in each document."""
        if not len(data) or not (len(self.codes) or self.short):
            return []
        data = NORMAL[data]
        code = _grams(data)
        short = list(self._exact(code, offsets))
        if not len(self.codes):
            return sorted(short)
        hit = self.seen[self._slot(code)]
        for k in range(1, Q):  # q-grams do not cross documents
            e = offsets[1:] - k
            hit[e[(e >= 0) & (e >= offsets[:-1])]] = False
        at = np.flatnonzero(hit)
        where = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        ok = self.codes[where] == code[at]
        at, where = at[ok], where[ok]
        keep = np.zeros(len(at), bool)
        for window, need in self.sieve:  # runs of hits that are dense enough for an item of the class
            n = len(at) - need + 1
            if n > 0:
                dense = at[need - 1 :] - at[:n] <= window
                mark = np.zeros(len(at) + 1, np.int32)
                mark[:n] = dense
                mark[need : need + n] -= dense
                keep |= np.cumsum(mark[:-1]) > 0
        at, where = at[keep], where[keep]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, band in self._bands(offsets, at, where, 0, len(self.ids)):
            for d, i, distance, s, e in self._aligned(data, offsets, doc, item, band):
                old = found.get((d, i))
                if old is None or (distance, s) < old[:2]:
                    found[d, i] = (distance, s, e)
        return sorted(short + [(doc, item, *x) for (doc, item), x in found.items()])

    def _exact(self, code, offsets):
        """The first place of each item without a q-gram in each document, as it is."""
        for size, (keys, items) in self.short.items():
            here = code >> np.uint64(8 * (Q - size))
            which = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
            at = np.flatnonzero(keys[which] == here)
            doc = np.searchsorted(offsets, at, "right") - 1
            at, doc = (x[at + size <= offsets[doc + 1]] for x in (at, doc))
            _, first = np.unique(doc * len(keys) + which[at], return_index=True)
            for d, i in zip(doc[first].tolist(), at[first].tolist(), strict=True):
                for item in items[which[i]].tolist():
                    yield d, item, 0, int(i - offsets[d]), int(i - offsets[d] + size)

    def _bands(self, offsets, at, where, lo, hi):
        """(documents, items, bands) that meet the bound, of the items lo to hi - 1: in parts of at most POSTINGS postings.

        Postings are halved by items, and those of a single item by places of the text. Where
        even an item and a text not much longer than it have more, the item repeats itself:
        all its bands there are taken, for alignment decides.
        """
        if not len(at):
            return
        grams, which = np.unique(where, return_inverse=True)
        base = grams.astype(np.int64) * len(self.ids)
        begin, end = np.searchsorted(self.order, base + lo), np.searchsorted(self.order, base + hi)
        count = (end - begin)[which]
        if count.sum() <= POSTINGS:
            yield from self._counted(offsets, at, begin[which], count)
        elif hi - lo > 1:
            some = count > 0
            for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)):
                yield from self._bands(offsets, at[some], where[some], a, b)
        else:
            at, where = at[count > 0], where[count > 0]
            m = int(self.offsets[lo + 1] - self.offsets[lo])
            middle = (at[0] + at[-1]) // 2
            if at[-1] - at[0] > 16 * m:
                for part in (at <= middle + 2 * m, at >= middle - 2 * m):  # an occurrence stands in one of them
                    yield from self._bands(offsets, at[part], where[part], lo, hi)
            else:
                doc = np.unique(np.searchsorted(offsets, at, "right") - 1)
                w = int(self.k[lo]) + 1
                for d in doc.tolist():
                    own = at[(at >= offsets[d]) & (at < offsets[d + 1])] - offsets[d]
                    band = np.arange((own[0] - m) // w - 1, own[-1] // w + 1)
                    yield np.full(len(band), d), np.full(len(band), lo), band

    def _counted(self, offsets, at, begin, count):
        posting = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        at = np.repeat(at, count)
        item, pos = self.item[posting].astype(np.int64), self.pos[posting].astype(np.int64)
        doc = np.searchsorted(offsets, at, "right") - 1
        band = np.floor_divide(at - offsets[doc] - pos, self.k[item] + 1)  # of the place of the item's start in the document
        # overlapping bands: [b, b + 2) widths. A place of the item counts once in a band, however many places of the text repeat it
        pair, item = np.concatenate([doc * len(self.ids) + item] * 2), np.concatenate([item, item])
        band, pos = np.concatenate([band, band - 1]), np.concatenate([pos, pos])
        # most bands have too few places even if all that share a bucket are theirs: these need no sorting
        bucket = ((pair * 0x9E3779B1 + band * 0x85EBCA77) >> 7) & (BUCKETS - 1)
        some = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS)[bucket] >= self.least[item])
        pair, band, pos = pair[some], band[some], pos[some]
        if not len(some):
            return
        low, first_pair, wide, long = int(band.min()), int(pair.min()), int(band.max() - band.min()) + 1, int(pos.max()) + 1
        if (int(pair.max()) - first_pair + 1) * wide * long < 1 << 63:
            order = np.argsort(((pair - first_pair) * wide + band - low) * long + pos)
        else:
            order = np.lexsort((pos, band, pair))
        pair, band, pos = pair[order], band[order], pos[order]
        group = np.append(True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])) if len(pair) else np.zeros(0, bool)
        new = group.copy()
        new[1:] |= pos[1:] != pos[:-1]
        first = np.flatnonzero(group)
        times = np.add.reduceat(new.astype(np.int64), first) if len(first) else first
        good = first[times >= self.least[pair[first] % len(self.ids)]]
        if len(good):
            yield pair[good] // len(self.ids), pair[good] % len(self.ids), band[good]

    def _shares(self, text, item):
        own = self.data[self.offsets[item] : self.offsets[item + 1]]
        return self.least[item] == self.need[item] or np.isin(_grams(own)[: len(own) - Q + 1], _grams(text)[: max(0, len(text) - Q + 1)]).sum() >= self.need[item]

    def _aligned(self, data, offsets, doc, item, band):
        """(document, item, distance, start, end) of the bands in which the item occurs."""
        w, m = self.k[item] + 1, self.offsets[item + 1] - self.offsets[item]
        lo = np.maximum(0, band * w)
        begin, end = offsets[doc] + lo, np.minimum(offsets[doc + 1], offsets[doc] + (band + 2) * w + m + w)
        order, at = np.argsort(w, kind="stable"), 0
        if (self.least < self.need)[item].any():  # found by some of their grams: the bound on all of them comes first
            order = order[[self._shares(data[begin[c] : end[c]], item[c]) for c in order]]
        while at < len(order):
            # as many candidates side by side as CELLS hold
            size = min(256, len(order) - at)
            while size > 1 and size * (4 * int(w[order[at + size - 1]]) + 3) > CELLS:
                size //= 2
            c = order[at : at + size]
            found = align(self.data, self.offsets[item[c]], m[c], data, begin[c], np.maximum(end[c] - begin[c], 0), band[c] * w[c] - lo[c], 2 * w[c], self.k[item[c]])
            for i in np.flatnonzero(found[0] <= self.k[item[c]]):
                yield int(doc[c[i]]), int(item[c[i]]), int(found[0][i]), int(lo[c[i]] + found[1][i]), int(lo[c[i]] + found[2][i])
            at += size


def align(items, item_at, m, data, text_at, length, shift, band, k):
    """(distance, start, end) of each item's best place in its text, within the band of diagonals [shift - k - 1, shift + band + k + 1].

    All candidates advance by one item byte at a time, side by side: the longest first,
    so that those which go on are a prefix. Items are items[item_at : item_at + m], texts
    data[text_at : text_at + length].
    """
    order = np.argsort(-m, kind="stable")
    item_at, m, text_at, length, shift, band, k = (x[order] for x in (item_at, m, text_at, length, shift, band, k))
    width = band + 2 * k + 3
    steps = np.arange(int(width.max()))
    big = int(m.max() + length.max() + width.max() + 1)
    column = (shift - k - 1)[:, None] + steps  # text place before the first byte, by diagonal
    own = steps < width[:, None]
    row = np.where(own & (column >= 0) & (column <= length[:, None]), 0, big)
    start = column.copy()
    edge = np.full((len(m), 1), big)
    out = np.full((3, len(m)), big)
    of = np.arange(len(m))
    for i in range(int(m[0])):
        if i % 16 == 15:  # whose best is over its budget already goes; whose item has ended stays
            on = (row.min(axis=1) <= k) | (m <= i)
            if not on.any():
                break
            if not on.all():
                of, item_at, m, text_at, length, k, row, start, column, own, edge = (x[on] for x in (of, item_at, m, text_at, length, k, row, start, column, own, edge))
            if m[0] <= i:
                break
        n = int(np.searchsorted(-m, -i, "left"))  # items longer than i
        j, tl = column[:n] + i, length[:n, None]
        inside = (j >= 0) & (j < tl)
        other = data[np.where(inside, text_at[:n, None] + j, 0)] if len(data) else np.zeros(j.shape, np.uint8)
        take = np.where(inside, row[:n] + (other != items[item_at[:n] + i][:, None]), big)
        drop = np.where((j >= 0) & (j <= tl), np.concatenate([row[:n, 1:] + 1, edge[:n]], axis=1), big)  # item byte left out
        here = np.minimum(take, drop)
        origin = np.where(take <= drop, start[:n], np.concatenate([start[:n, 1:], edge[:n]], axis=1))
        low = np.minimum.accumulate(here - steps, axis=1)  # text byte left out: along the row
        source = np.maximum.accumulate(np.where(here - steps == low, steps, 0), axis=1)
        row[:n] = np.where(own[:n] & (j + 1 >= 0) & (j + 1 <= tl), low + steps, big)
        start[:n] = np.take_along_axis(origin, source, axis=1)
    best, rows = row.argmin(axis=1), np.arange(len(m))
    out[:, order[of]] = np.stack([row[rows, best], np.maximum(start[rows, best], 0), column[rows, best] + m])
    return out


def matches(docs: DataFrame, benchmark: DataFrame, slab_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, distance, start, end (byte places) of the best occurrence of each item in each row's text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null and text <> ''")
    total = items.agg(F.sum(F.octet_length("text")).alias("b"), F.max(F.octet_length("text")).alias("m")).first()
    slabs = max(1, -(-int(total["b"] or 0) // slab_bytes)) if total["b"] else 0
    out = spark.createDataFrame([], SCHEMA)
    for slab in range(slabs):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slabs)) == slab).collect()  # about slab_bytes
        index = spark.sparkContext.broadcast(Index(sorted(((r["item_id"], r["text"]) for r in own), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))))
        out = out.unionByName(written(_search(docs, index)))
        index.unpersist()
    return out


def _search(docs: DataFrame, index) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for lo, _, data, offsets in tb.chunks(batch.column("text"), 1 << 20):
                rows += [(lo + d, own, dist, s, e) for d, i, dist, s, e in index.value.search(data, offsets) for own in index.value.ids[i]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                ["doc_id", "item_id", "distance", "start", "end"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no item occurs: by text, whatever the ids."""
    (key,) = free(docs, "hash")
    found = matches(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, F.xxhash64(docs["text"]) == F.col(key), "left_anti")
