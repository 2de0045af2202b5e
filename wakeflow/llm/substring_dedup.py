"""Removal of repeated substrings over all texts by sharded suffix arrays.

A string of ``least`` bytes that starts anywhere else too, in the same text or another,
is repeated; every byte that a repeated string covers goes. Strings are dealt to shards
by content: a string's anchor is the smallest hash of its K-grams, so equal strings
have equal anchors, and the strings of a text with one anchor form one region. Regions
whose anchor occurs once hold nothing repeated. The others are cut out and sorted, shard
by shard, by induced sorting of suffixes; permuted common prefixes of at least ``least``
bytes mark the repeated strings.

Texts are UTF-8 bytes, null is empty. Equal texts are one class: if there are several
and they have ``least`` bytes, all of each is repeated, and the class stands for them
where others match it. Beside what is removed, ``n_shared`` counts the bytes of strings
of ``hint`` bytes, shorter than ``least``, that shards find repeated by their hashes:
where their regions meet in one shard, so at most all there are. ``n_passage_words`` counts, whole,
the words that stand in a passage: ``passage`` words in a row, whatever white space
parts them, that stand in another document too. Repeats within a document are none, of
equal texts each is the other's passage, and no text of so many words is too short.

Defined cases: null, empty and short texts keep all; rows that repeat a doc_id are
texts of their own, so equal rows remove each other; an empty table gives an empty
result; other columns are ignored. No text is too long; a text over the chunk size is
a chunk. A class is the head of a text's SHA-256; where it heads several texts, these get
classes by their whole digests. Hashes only bring strings together, except that regions
with a common K-gram (passages: with GRAM common words) whose 64-bit hashes agree, over
mixed windows of bytes or mixed words, count as equal.

Scale: numbers of regions are written once, equal regions of a text as one row, and
those whose anchor stands once are dropped before anything is sorted. What is counted
by anchor or region is aggregated in part first, so a hot one is a row per map task.
Texts are shuffled by class, one of a class and task (one exchange, used twice), and of
the regions only the distinct ones with a repeated anchor. A hot anchor, with more than
HOT distinct regions, is dealt again by a second hash, so that its strings spread over
shards. In a shard only runs of ``hint``-grams that stand there twice are sorted, equal
runs once. Passages go the same way beside the strings: their regions are dealt by
GRAMs of words, an anchor must stand in two classes, and shards get the hashes of the
passages of distinct regions, a hot anchor's one by one. A shard's arrays hold about
SHARD bytes, or those of one key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeflow.llm import textbytes as tb
from wakeflow.llm.common import written
from wakeflow.llm.suffix_array import permuted_lcp, suffix_array

K = 64
GRAM = 8
LONG_WORD = 32
#: the first 0 to 8 bytes of a little-endian number
HEADS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
SHARD = 1 << 20
HOT = 256
#: hexadecimal digits of a text's SHA-256 that are its class
CLASS_DIGITS = 15


def _share(order: np.ndarray, offsets: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, lo, hi): strings of ``least`` items of a document that start at lo..hi and have the lowest of their ``width`` values of ``order`` at one place."""
    starts = int(offsets[-1]) - least + 1
    bits = np.uint64(max(1, int(offsets[-1]).bit_length()))
    key = order >> bits
    key <<= bits
    key |= np.arange(len(order), dtype=np.uint64)
    # sliding minimum: suffix minima of one block meet prefix minima of the next
    blocks = -(-len(key) // width)
    key = np.concatenate([key, np.full(blocks * width - len(key), np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(blocks, width)
    right = np.minimum.accumulate(key, axis=1).ravel()
    left = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(left[:starts], right[width - 1 : width - 1 + starts])
    low &= (np.uint64(1) << bits) - np.uint64(1)
    # starts whose string stays in its document: a document's are apart from the next one's
    count = np.maximum(np.diff(offsets) - least + 1, 0)
    step = np.zeros(starts + 1, np.int8)
    step[offsets[:-1][count > 0]] = 1
    step[(offsets[:-1] + count)[count > 0]] = -1
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    begin, end = inside.copy(), inside.copy()
    change = low[1:] != low[:-1]
    begin[1:] &= change | ~inside[:-1]
    end[:-1] &= change | ~inside[1:]
    lo = np.flatnonzero(begin)
    return np.searchsorted(offsets, lo, "right") - 1, low[lo].astype(np.int64), lo, np.flatnonzero(end)


def anchors(data: np.ndarray, offsets: np.ndarray, least: int, salt: int = 0):
    """(document, anchor hash, lo, hi, region hash): strings of a document that start at lo..hi, by place in it, and share an anchor."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < least:
        return none, none, none, none, none
    prefix = tb.window_hash(data)
    h = tb.windows(prefix, K)
    doc, low, lo, hi = _share(tb.mix64(h ^ np.uint64(salt)) if salt else h, offsets, least, least - K + 1)
    region = tb.window_slices(prefix, lo, hi + least)
    return doc, h[low].view(np.int64), lo - offsets[doc], hi - offsets[doc], region.view(np.int64)


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, mixed 8 bytes by 8; those of over LONG_WORD bytes by BLAKE2."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    code = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    h = size.astype(np.uint64)
    which = np.arange(len(size))
    for shift in range(0, LONG_WORD, 8):
        left = size[which] - shift
        h[which] = tb.mix64(h[which] + (code[begin[which] + shift] & HEADS[np.minimum(left, 8)]))
        which = which[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def passages(data: np.ndarray, offsets: np.ndarray, words: int):
    """As :func:`anchors` for strings of ``words`` words, lo and hi being words of the document; and the function that hashes the passages at lo..hi."""
    none = np.zeros(0, np.int64)
    begin, end, first = tb.words(data, offsets)
    if not len(begin) or np.diff(first).max() < words:
        return none, none, none, none, none, None
    prefix = np.zeros(len(begin) + 1, np.uint64)
    np.cumsum(_word_hashes(data, begin, end) * tb.powers(tb.BASE, len(begin)), out=prefix[1:])

    def hashes(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return tb.mix64((prefix[e] - prefix[s]) * tb.powers(tb.INVERSE, len(prefix))[s])

    s = np.arange(len(begin) - GRAM + 1)
    h = hashes(s, s + GRAM)
    doc, low, lo, hi = _share(h, first, words, words - GRAM + 1)
    region = tb.mix64(hashes(lo, hi + words) + (hi - lo).astype(np.uint64))

    def each(doc: int, lo: int, hi: int) -> np.ndarray:
        s = np.arange(lo, hi + 1) + first[doc]
        return hashes(s, s + words)

    return doc, h[low].view(np.int64), lo - first[doc], hi - first[doc], region.view(np.int64), each


def _class(text: bytes, digits: int, renamed: dict[str, int]) -> int:
    sha = hashlib.sha256(text).hexdigest()
    return renamed.get(sha) or int(sha[:digits], 16)


def _renamed(rows: DataFrame) -> dict[str, int]:
    """Classes, below -1, of the texts whose first digits stand for other texts too: about one in 2^61 pairs of texts, so a few thousand of 10^11 texts."""
    shared = rows.groupBy("cls").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a < b").select("cls")
    found = rows.join(shared, "cls", "left_semi").select("sha").distinct()
    return {sha: -2 - i for i, sha in enumerate(sorted(r["sha"] for r in found.collect()))}


def _regions(least: int, passage: int, shortest: int, renamed: dict[str, int]):
    digits = CLASS_DIGITS

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in tb.chunks(batch.column("text"), 1 << 20):
                size = np.diff(offsets)
                cls = np.array([_class(data[a:b].tobytes(), digits, renamed) if b - a >= shortest else -1 for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
                fresh = np.zeros(len(size), bool)  # equal texts in one task: the first
                for i in range(len(size)):
                    if cls[i] != -1 and int(cls[i]) not in known:
                        fresh[i] = True
                        if len(known) < 1_000_000:
                            known.add(int(cls[i]))
                for words, n, found in ((False, least, anchors), (True, passage, passages)):
                    doc, h, lo, hi, body = found(data, offsets, n)[:5]
                    keep = fresh[doc]
                    yield _rows(words, n, cls[doc[keep]], h[keep], body[keep], lo[keep], hi[keep])

    return run


REGIONS = "words boolean, anchor long, body long, cls long, lo long, hi long, spans array<struct<a:long,b:long>>"


def _rows(words: bool, least: int, cls, anchor, body, lo, hi) -> pa.RecordBatch:
    """One row for equal regions of a class: the first's lo and hi, and, if there are several, the ranges of bytes or words that all cover."""
    order = np.lexsort((lo, body, anchor, cls))
    cls, anchor, body, lo, hi = (x[order] for x in (cls, anchor, body, lo, hi))
    new = np.ones(len(cls), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(cls)))
    many = np.repeat(times > 1, times)  # of those, the ranges that do not reach the one before
    opens = many.copy()
    opens[1:] &= new[1:] | (lo[1:] > hi[:-1] + least)
    begin = np.flatnonzero(opens)
    end = np.maximum.reduceat(np.where(many, hi, -1), begin) if len(begin) else begin
    size = np.add.reduceat(opens.astype(np.int64), first) if len(first) else first
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(size == 0, False))
    spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(lo[begin]), pa.array(end + least)], ["a", "b"]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), words)), *[pa.array(x[first]) for x in (anchor, body, cls, lo, hi)], spans], ["words", "anchor", "body", "cls", "lo", "hi", "spans"])


def _second(anchor: int, h: int) -> int:
    """A hot anchor's shard for the second hash."""
    return int(tb.mix64(np.array([anchor, h], np.int64).view(np.uint64)[:1] * np.uint64(31) + np.array([h], np.int64).view(np.uint64))[0].astype(np.int64))


def _cut_passages(cls: int, text: bytes, cuts: list[dict], passage: int):
    """Rows of :func:`_cut` for regions of passages: hashes of the passages as bytes, and all the words where the region starts."""
    _, anchor, lo, hi, body, each = passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]), passage)
    asked = {(c["anchor"], c["body"]): c for c in cuts}
    at: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(np.isin(body, [c["body"] for c in cuts])).tolist():
        if (place := (int(anchor[i]), int(body[i]))) in asked:
            at.setdefault(place, []).append(i)
    for place, found in at.items():
        c, hashes, los = asked[place], each(0, lo[found[0]], hi[found[0]]), lo[found]
        if not c["hot"]:
            yield place[0], place[1], cls, int(los[0]), not c["same"], None, hashes.tobytes(), los.tolist()
            continue
        for i, h in enumerate(hashes.view(np.int64).tolist()):
            yield _second(place[0], h), h, cls, int(los[0]) + i, not c["same"], None, hashes[i].tobytes(), (los + i).tolist()


def _cut(least: int, passage: int):
    """Cuts regions out of texts: shard, body hash, cls, lo, whether its ranges are wanted, how many starts are its own and no other region's (null: passages), bytes, words where passages start."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for cls, text, cuts in zip(batch.column("cls").to_pylist(), batch.column("text"), batch.column("cuts").to_pylist(), strict=True):
                text = text.as_py().encode()
                worded = [c for c in cuts if c["words"]]
                if worded:
                    rows.extend(_cut_passages(cls, text, worded, passage))
                for c in cuts:
                    if c["words"]:
                        continue
                    body = text[c["lo"] : c["hi"] + least]
                    starts = lambda lo, hi, n=len(text): (n if hi + least == n else hi + 1) - lo  # noqa: E731  the last region has the text's end too
                    if not c["hot"]:
                        rows.append((c["anchor"], c["body"], cls, c["lo"], not c["same"], starts(c["lo"], c["hi"]), body, None))
                        continue
                    data = np.frombuffer(body, np.uint8)
                    _, a, lo, hi, inner = anchors(data, np.array([0, len(data)]), least, salt=0x2545F4914F6CDD1D)
                    for h, s, e, b in zip(a.tolist(), lo.tolist(), hi.tolist(), inner.tolist(), strict=True):
                        rows.append((_second(c["anchor"], h), b, cls, c["lo"] + s, not c["same"], starts(c["lo"] + s, c["lo"] + e), body[s : e + least], None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shard", "body", "cls", "lo", "wanted", "own", "bytes", "los"])

    return run


def _runs(on: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of ``on`` that stays with one owner."""
    at = np.flatnonzero(on)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1]


def repeated_starts(bodies: list[bytes], own: list[int], least: int, hint: int, shard: list[int] | None = None) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """For each body (first, last): runs of the starts of its strings of ``least`` bytes that start elsewhere too, by a suffix array; and of ``hint`` bytes, by hashes.

    Of each body only the first ``own`` starts count; the others are those of bodies cut
    from the same text. Bodies meet those of their shard, whichever others are at hand.
    """
    size, owned = np.array([len(b) for b in bodies], np.int64), np.array(own, np.int64)
    text = np.frombuffer(b"".join(bodies), np.uint8)
    begin, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    long: list[list[tuple[int, int]]] = [[] for _ in bodies]
    near: list[list[tuple[int, int]]] = [[] for _ in bodies]
    inner = np.arange(len(text)) - begin[owner]
    at = np.flatnonzero(inner + hint <= size[owner])
    grams = tb.windows(tb.window_hash(text), hint)[at]
    if shard is not None:
        grams ^= tb.mix64(np.array(shard, np.int64).view(np.uint64))[owner[at]]
    _, which = np.unique(grams, return_inverse=True)
    mine = inner[at] < owned[owner[at]]
    on = np.zeros(len(text), bool)
    on[at] = mine & (np.bincount(which, mine)[which] > 1) if len(at) else False
    for a, b in zip(*_runs(on, owner), strict=True):
        near[owner[a]].append((int(inner[a]), int(inner[b])))
    # a repeated string consists of repeated hint-grams: runs of those are all that needs sorting
    on[at] = np.bincount(which)[which] > 1 if len(at) else False
    first, last = _runs(on, owner)
    some = last - first >= least - hint
    pieces: dict[bytes, list[tuple[int, int]]] = {}
    for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True):
        pieces.setdefault(text[a : b + hint].tobytes(), []).append((int(owner[a]), int(inner[a])))
    if not pieces:
        return long, near
    names, places = list(pieces), list(pieces.values())
    size = np.array([len(x) for x in names], np.int64)
    ends = np.cumsum(size + 1)
    s = np.ones(ends[-1] + 1, np.int16)  # 1 parts pieces, 0 ends all
    of = np.repeat(np.arange(len(size)), size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = (ends - size - 1)[of] + inner
    s[place] = np.frombuffer(b"".join(names), np.uint8).astype(np.int16) + 2
    s[-1] = 0
    # how often each start of a piece stands in bodies as their own
    first = np.cumsum(size) - size
    times = np.zeros(len(of) + 1, np.int64)
    for i, found in enumerate(places):
        for body, shift in found:
            n = min(own[body] - shift, int(size[i]))
            if n > 0:
                times[first[i]] += 1
                times[first[i] + n] -= 1
    weight = np.zeros(len(s), np.int64)
    weight[place] = np.cumsum(times[:-1])
    sa = suffix_array(s)
    plcp, _ = permuted_lcp(s, sa, 2 * int(size.max()) + 2)  # different pieces follow equal ones
    group = np.empty(len(s), np.int64)  # suffixes with so long a common prefix stand side by side
    group[sa] = np.cumsum(plcp[sa] < least)
    fits = inner + least <= size[of]
    total = np.bincount(group[place[fits]], weight[place[fits]], minlength=int(group.max()) + 1)
    for a, b in zip(*_runs(fits & (total[group[place]] > 1), of), strict=True):
        for body, shift in places[of[a]]:
            end = min(int(inner[b]) + shift, own[body] - 1)
            if end >= inner[a] + shift:
                long[body].append((int(inner[a]) + shift, end))
    return long, near


def repeated_passages(rows: list[tuple], passage: int) -> list[tuple]:
    """(cls, first word, end, None) of the passages that stand in two classes, from the rows of :func:`_cut`; a region that is not wanted stands in several."""
    if not rows:
        return []
    hashes, size = np.frombuffer(b"".join(r[6] for r in rows), np.int64), np.array([len(r[6]) // 8 for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    inner = np.arange(len(hashes)) - (np.cumsum(size) - size)[owner]
    cls, wanted = np.array([r[2] for r in rows], np.int64), np.array([r[4] for r in rows])
    order = np.lexsort((cls[owner], hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    twice = (cls[owner[order[first]]] != cls[owner[order[last]]]) | np.logical_or.reduceat(~wanted[owner[order]], first)
    on = np.zeros(len(order), bool)
    on[order] = np.repeat(twice, last - first + 1)
    found = [(cls[owner[a]], lo + inner[a], lo + inner[b] + passage) for a, b in zip(*_runs(on & wanted[owner], owner), strict=True) for lo in rows[owner[a]][7]]
    if not found:
        return []
    # ranges that meet, as one
    names, which = np.unique(np.array([x[0] for x in found], np.int64), return_inverse=True)
    a, b = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64)
    far = int(b.max()) + 1
    order = np.lexsort((a, which))
    a, b, which = a[order] + which[order] * far, np.maximum.accumulate(b[order] + which[order] * far), which[order]
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    shift = which[first] * far
    return [(*x, None) for x in zip(names[which[first]].tolist(), (a[first] - shift).tolist(), (b[np.append(first[1:], len(a)) - 1] - shift).tolist(), strict=True)]


def _sort(least: int, hint: int, passage: int):
    """Of regions sorted by shard and body: ranges of repeated strings, cls by cls; ``cut`` for those of ``least`` bytes, null for words of passages."""

    def shards(rows: list[tuple]):
        worded = repeated_passages([r for r in rows if r[5] is None], passage)
        rows = [r for r in rows if r[5] is not None]
        found = repeated_starts([r[6] for r in rows], [r[5] for r in rows], least, hint, [r[0] for r in rows])
        return worded + [(cls, lo + a, lo + b + n, n == least) for n, runs in zip((least, hint), found, strict=True) for (_, _, cls, lo, wanted, *_), own in zip(rows, runs, strict=True) if wanted for a, b in own]

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("shard", "body", "cls", "lo", "wanted", "own", "bytes", "los")], strict=True):
                if held and row[0] != held[-1][0] and size > SHARD:
                    yield _ranges(shards(held))
                    held, size = [], 0
                if not held or row[:4] != held[-1][:4]:
                    size += len(row[6])
                    held.append(row)
        if held:
            yield _ranges(shards(held))

    return run


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.bool_())], ["cls", "a", "b", "cut"])


def _n_words(text: bytes, ranges: list[dict]) -> int:
    """Words that ranges of words cover; one that ends before its start covers all."""
    if any(r["b"] < r["a"] for r in ranges):
        data = np.frombuffer(text, np.uint8)
        return len(tb.words(data, np.array([0, len(data)]))[0])
    n = end = 0
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        n, end = n + max(0, b - max(a, end)), max(b, end)
    return n


def _remove(passage: int):
    """Of texts with their ranges: what is left of each class, null if nothing goes, and its words in passages."""

    def run(batches):
        for batch in batches:
            out = []
            for cls, text, ranges in zip(batch.column("cls").to_pylist(), batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
                text = text.as_py().encode()
                words = _n_words(text, [r for r in ranges if r["cut"] is None])
                ranges = [r for r in ranges if r["cut"] is not None]
                if words < passage:
                    words = 0
                if not ranges:
                    out.append((cls, 0, 0, 0, None, None, words))
                    continue
                data = np.frombuffer(text, np.uint8)
                step = np.zeros((2, len(data) + 1), np.int32)
                for r in ranges:
                    for row in step[0 if r["cut"] else 1 :]:
                        row[r["a"]] += 1
                        row[r["b"]] -= 1
                gone, shared = np.cumsum(step[:, :-1], axis=1) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = data[~gone].tobytes() if spans else None
                out.append((cls, int(gone.sum()), spans, int(shared.sum()), hashlib.sha256(kept).hexdigest() if spans else None, kept.decode("utf-8", "ignore") if spans else None, words))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["cls", "n_removed", "n_spans", "n_shared", "kept_sha256", "kept", "n_passage_words"])

    return run


def _repeated(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of regions the rows whose region stands at two places or more (passages: in two classes); and one place of each region whose anchor has other regions too (``same``: it is one of those; ``hot``: there are many)."""
    place = F.when(F.col("words"), F.col("cls")).otherwise(F.xxhash64("cls", "body"))
    many = F.max((F.col("spans").isNotNull() & ~F.col("words")).cast("int")).alias("many")
    again = found.groupBy("words", "anchor").agg(F.min(place).alias("low"), F.max(place).alias("high"), many)
    rows = written(found.join(again.filter("low < high or many = 1").select("words", "anchor"), ["words", "anchor"], "left_semi"))
    bodies = rows.groupBy("words", "anchor", "body").agg(F.min("cls").alias("cls"), F.max("cls").alias("top"), F.min_by("lo", "cls").alias("lo"), F.min(F.col("hi") - F.col("lo")).alias("length"), many)
    bodies = bodies.withColumn("same", (F.col("cls") < F.col("top")) | (F.col("many") == 1))
    anchors = bodies.groupBy("words", "anchor").agg(F.count("*").alias("bodies")).filter("bodies > 1")
    lead = bodies.join(anchors, ["words", "anchor"]).select("words", "anchor", "body", "cls", "lo", (F.col("lo") + F.col("length")).alias("hi"), "same", (F.col("bodies") > HOT).alias("hot"))
    same = rows.join(bodies.filter("same").select("words", "anchor", "body"), ["words", "anchor", "body"], "left_semi")
    return same, lead


def remove_repeats(docs: DataFrame, least: int = 400, hint: int = 256, passage: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_shared, kept_sha256, kept_text (null where nothing was removed) and n_passage_words of every row.

    kept_text drops the bytes of letters that a removed run cuts apart; kept_sha256 does not.
    """
    if passage < GRAM:
        raise ValueError(f"a passage has {GRAM} words at least")
    text, hint = F.coalesce(F.col("text"), F.lit("")), min(hint, least)
    shortest = min(hint, 2 * passage - 1)
    sha = F.sha2(text, 256)
    cls = F.conv(F.substring(sha, 1, CLASS_DIGITS), 16, 10).cast("long")
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha"), cls.alias("cls")))
    renamed = _renamed(rows)
    if renamed:
        other = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
        cls = F.coalesce(F.try_element_at(other, sha), cls).cast("long")
        rows = rows.withColumn("cls", F.coalesce(F.try_element_at(other, F.col("sha")), F.col("cls")).cast("long"))
    copied = rows.filter(F.col("n_bytes") >= shortest).groupBy("cls").agg(F.count("*").alias("copies")).filter("copies > 1").select("cls")

    long = docs.select(text.alias("text")).filter(F.octet_length("text") >= shortest)
    same, lead = _repeated(written(long.mapInArrow(_regions(least, passage, shortest, renamed), REGIONS)))
    texts = docs.select(cls.alias("cls"), text.alias("text")).filter(F.octet_length("text") >= shortest).groupBy("cls").agg(F.first("text").alias("text"))
    cuts = lead.groupBy("cls").agg(F.collect_list(F.struct("words", "anchor", "body", "lo", "hi", "same", "hot")).alias("cuts"))
    regions = texts.join(cuts, "cls").select("cls", "text", "cuts").mapInArrow(_cut(least, passage), "shard long, body long, cls long, lo long, wanted boolean, own long, bytes binary, los array<long>")
    inner = regions.repartition("shard").sortWithinPartitions("shard", "body", "cls", "lo").mapInArrow(_sort(least, hint, passage), "cls long, a long, b long, cut boolean")
    cut = lambda a, b, on: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), on.alias("cut"))
    kind = F.when(~F.col("words"), True)
    whole = F.coalesce(F.transform("spans", lambda x: cut(x["a"], x["b"], kind)), F.array(cut(F.col("lo"), F.col("hi") + F.when(F.col("words"), passage).otherwise(least), kind)))
    parts = inner.select("cls", F.array(cut(F.col("a"), F.col("b"), F.col("cut"))).alias("r")).unionByName(same.select("cls", whole.alias("r")))
    parts = parts.join(copied, "cls", "left_anti").unionByName(copied.select("cls", F.array(cut(F.lit(0), F.lit(-1), F.lit(None).cast("boolean"))).alias("r")))
    ranges = parts.groupBy("cls").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    changed = texts.join(ranges, "cls").select("cls", "text", "ranges").mapInArrow(_remove(passage), "cls long, n_removed long, n_spans long, n_shared long, kept_sha256 string, kept string, n_passage_words long")
    out = rows.join(changed, "cls", "left").join(copied.withColumn("copied", F.lit(True)), "cls", "left")
    again = F.col("copied").isNotNull() & (F.col("n_bytes") >= hint)
    gone = again & (F.col("n_bytes") >= least)
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_shared", F.lit(0))).cast("long").alias("n_shared"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, "").otherwise(F.col("kept")).alias("kept_text"),
        F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"),
    )
