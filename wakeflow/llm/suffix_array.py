"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

The scans of induced sorting are sequential only where an entry falls into the part
being read. Each scan therefore takes the longest stretch that none of its own entries
falls into and places all its entries at once; the work stays linear.
"""

from __future__ import annotations

import numpy as np

from wakeflow.llm import textbytes as tb


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the last, a unique least symbol, is."""
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # equal symbols take the type of what follows
    out = np.ones(len(s), bool)
    out[:-1] = np.where(nxt < len(step), step[np.minimum(nxt, len(step) - 1)] > 0, False) if len(step) else out[:-1]
    return out


def _ranks(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item its number among the equal ones before it, and the stable order."""
    order = np.argsort(c, kind="stable")  # by radix for the 16-bit symbols of texts
    run = c[order]
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    return rank, order


def _scan(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, edge: np.ndarray, way: int) -> None:
    """Induces the suffixes before those in sa that ``wanted`` marks: from the left at bucket heads (way 1), or from the right at bucket ends (way -1)."""
    n, size, at = len(sa), 1024, 0
    edge = edge.copy()
    while at < n:
        here = sa[at : at + size] if way == 1 else sa[n - at - size if n - at > size else 0 : n - at][::-1]
        live = np.flatnonzero(here > 0)
        before = here[live] - 1
        ok = wanted[before]
        live, before = live[ok], before[ok]
        if not len(live):
            at += len(here)
            size = min(2 * size, 1 << 16)
            continue
        c = s[before]
        rank, _ = _ranks(c)
        target = edge[c] + rank if way == 1 else n - 1 - (edge[c] - rank)  # both count from the side of the scan
        low = np.full(len(here), n + size)
        low[live] = target
        low = np.minimum.accumulate(low)
        hit = np.flatnonzero(low[:-1] <= at + 1 + np.arange(len(here) - 1))
        stop = int(hit[0]) + 1 if len(hit) else len(here)
        k = int(np.searchsorted(live, stop))
        place = target[:k] if way == 1 else n - 1 - target[:k]
        sa[place] = before[:k]
        if len(edge) > size:
            np.add.at(edge, c[:k], way)
        elif k:
            edge += way * np.bincount(c[:k], minlength=len(edge))
        at += stop
        size = min(2 * size, 1 << 16) if stop == len(here) else max(256, 2 * stop)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of the leftmost-smaller ones."""
    sa = np.full(len(s), -1, np.int64)
    c = s[lms]
    rank, _ = _ranks(c[::-1])
    sa[ends[c] - rank[::-1]] = lms
    _scan(sa, s, ~small, heads, 1)
    kept = sa >= 0
    kept[kept] = ~small[sa[kept]]
    kept[0] = True  # the end symbol
    sa[~kept] = -1
    end = ends.copy()
    end[s[-1]] -= 1
    _scan(sa, s, small, end, -1)
    return sa


def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether s[a : a + n] and s[b : b + m] are the same, for each of the pairs."""
    out = n == m
    size = np.where(out, n, 0)
    first = np.concatenate([[0], np.cumsum(size)])
    pair = np.repeat(np.arange(len(a)), size)
    at = np.arange(first[-1]) - first[pair]
    unlike = np.flatnonzero(s[a[pair] + at] != s[b[pair] + at])
    out[pair[unlike]] = False
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes of s, whose last symbol is 0 and the only 0."""
    n = len(s)
    s = s.astype(np.int16 if s.max(initial=0) < 1 << 15 else np.int64)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    size = np.bincount(s)
    ends = np.cumsum(size) - 1
    heads = ends - size + 1
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(s, small, lms, heads, ends)
    # names of the leftmost-smaller substrings, in the order that inducing gave them
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:] + 1, n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * tb.powers(tb.BASE, n), out=prefix[1:])
    h = tb.slice_hash(prefix, order, stop[order])
    new = np.ones(len(order), np.int64)
    new[0] = 0
    new[1:] = h[1:] != h[:-1]
    alike = np.flatnonzero(new == 0)[1:]  # of equal hashes: compared symbol by symbol, at most all symbols once
    new[alike] = ~_equal(s, order[alike], order[alike - 1], stop[order[alike]] - order[alike], stop[order[alike - 1]] - order[alike - 1])
    name = np.empty(n, np.int64)
    name[order] = np.cumsum(new)
    if name[order[-1]] + 1 < len(lms):
        lms = lms[suffix_array(name[lms])]  # equal substrings: sort their sequence the same way
    else:
        lms = order
    return _induce(s, small, lms, heads, ends)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): for each place, its suffix's predecessor in sorted order and their common prefix; ``longest``: no prefix is longer.

    Only places whose left neighbours differ are compared; the others follow from the
    place before them, one less.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * tb.powers(tb.BASE, n), out=prefix[1:])
    p = np.arange(n)
    follows = (p > 0) & (phi > 0)
    follows[follows] = s[p[follows] - 1] == s[phi[follows] - 1]
    first = np.flatnonzero(~follows)
    lcp = np.zeros(len(first), np.int64)
    own = np.flatnonzero(phi[first] >= 0)
    a, b = first[own], phi[first[own]]
    step = 1 << max(0, int(min(n, longest or n)).bit_length() - 1)
    while step:
        l = lcp[own]
        fits = np.flatnonzero(np.maximum(a, b) + l + step <= n)
        x, y = a[fits] + l[fits], b[fits] + l[fits]
        same = tb.slice_hash(prefix, x, x + step) == tb.slice_hash(prefix, y, y + step)
        lcp[own[fits[same]]] += step
        step >>= 1
    # hashes found the lengths; the symbols confirm them, in parts of bounded size
    for lo in range(0, len(own), 4096):
        some = own[lo : lo + 4096]
        x, y, l = first[some], phi[first[some]], lcp[some]
        for i in some[~_equal(s, x, y, l, l)]:
            k = int(np.flatnonzero(s[first[i] : first[i] + lcp[i]] != s[phi[first[i]] : phi[first[i]] + lcp[i]])[0])
            lcp[i] = k
    owner = np.cumsum(~follows) - 1
    return lcp[owner] - (p - first[owner]), phi
