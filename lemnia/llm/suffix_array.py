"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classed as smaller or larger than their successors.  The
leftmost-smaller substrings are compared and named; the sequence of names is
sorted by the same method, whatever its alphabet; and its order induces that
of all suffixes.  The induction goes over ranges of buckets: as
long as no suffix of a range induces another within it, one stable partition
does what a scan of the range would.  Each suffix is moved a fixed number of
times, so the work is linear in the text.
"""

from __future__ import annotations

import numpy as np


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; t ends with its one least symbol."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[at] > 0
    return out


def _place(sa: np.ndarray, t: np.ndarray, pos: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Write positions, in their order, from their buckets' edges on; the edges move along."""
    if not len(pos):
        return
    c = t[pos]
    order = np.argsort(c, kind="stable")
    c, pos = c[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, size)
    sa[edge[c] + step * rank - (step < 0)] = pos
    edge[c[first]] += step * size


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones, which are in order within each bucket."""
    n = len(t)
    start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
    large = np.bincount(t[~small], minlength=sigma)
    sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    _place(sa, t, lms, start[:-1] + large, 1)
    wide = max(256, int(n**0.5))
    # the last suffix is induced by nothing, and what stands before the first one falls on it
    is_large, is_small = ~small, small.copy()
    is_small[-1] = False

    # the larger suffixes, from the least bucket on
    head = start[:-1].copy()
    c = 0
    while c < sigma:
        stop = max(c + 1, int(np.searchsorted(start, start[c] + wide, "right")) - 1)
        if stop > c + 1:
            part = sa[start[c] : start[stop]]
            p = part[part > 0] - 1
            p = p[is_large[p]]
            target = t[p]
            near = target < stop
            if near.any():
                stop = max(c + 1, int(target[near].min()))
                part = sa[start[c] : start[stop]]
                p = part[part > 0] - 1
                p = p[is_large[p]]
        if stop == c + 1:
            out = []
            got = sa[start[c] : head[c]]
            while len(got):  # a bucket that induces within itself is filled in rounds
                p = got - 1
                p = p[is_large[p]]
                same = t[p] == c
                got = p[same]
                out.append(p[~same] if len(got) else p)
                sa[head[c] : head[c] + len(got)] = got
                head[c] += len(got)
            seeds = sa[start[c] + large[c] : start[stop]]
            p = seeds[: np.searchsorted(seeds < 0, True)] - 1
            p = np.concatenate([*out, p[is_large[p]]])
        _place(sa, t, p, head, 1)
        c = stop
    # the smaller suffixes, from the greatest bucket down
    sa[(sa >= 0) & small[sa]] = -1
    tail = start[1:].copy()
    c = sigma
    while c > 0:
        low = max(0, min(c - 1, int(np.searchsorted(start, start[c] - wide, "left"))))
        if low < c - 1:
            part = sa[start[low] : start[c]][::-1]
            p = part[part > 0] - 1
            p = p[is_small[p]]
            target = t[p]
            near = target >= low
            if near.any():
                low = min(c - 1, int(target[near].max()) + 1)
                part = sa[start[low] : start[c]][::-1]
                p = part[part > 0] - 1
                p = p[is_small[p]]
        if low == c - 1:
            out = []
            got = sa[tail[low] : start[c]][::-1]
            while len(got):
                p = got - 1
                p = p[is_small[p]]
                same = t[p] == low
                got = p[same]
                out.append(p[~same] if len(got) else p)
                sa[tail[low] - len(got) : tail[low]] = got[::-1]
                tail[low] -= len(got)
            p = sa[start[low] : start[low] + large[low]][::-1] - 1
            p = np.concatenate([*out, p[is_small[p]]])
        _place(sa, t, p, tail, -1)
        c = low
    sa[0] = n - 1
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of the bytes in ascending order."""
    if not len(text):
        return np.zeros(0, np.int64)
    t = np.concatenate([text.astype(np.int16) + 1, np.zeros(1, np.int16)])
    return _sorted_suffixes(t, 257)[1:]


def substring_names(t: np.ndarray, at: np.ndarray, sigma: int) -> tuple[np.ndarray, int]:
    """(name of each leftmost-smaller substring, in their order; number of names).

    A substring reaches to the next one's first symbol.  As many symbols as a
    number holds are compared at a time, and what ties, and isn't at its end, further on.
    Where one is the beginning of another, the longer one is less: the symbol that ends the
    shorter one starts a smaller suffix, in the longer one a larger suffix, and of equal symbols larger suffixes come first.
    """
    m, last = len(at), len(t) - 1
    length = np.diff(at, append=last) + 1
    bits = int(sigma + 1).bit_length()
    per = 63 // bits

    def keys(live: np.ndarray, first: int) -> np.ndarray:
        begin, room = at[live] + first, length[live] - first
        out = np.zeros(len(live), np.int64)
        for j in range(per):
            symbol = t[np.minimum(begin + j, last)].astype(np.int64)
            out = (out << bits) | np.where(j < room, symbol, sigma)  # an end is greater than all symbols
        return out

    # a rank is the number of lesser substrings, so that ties are told apart within their own ranks
    key = keys(np.arange(m), 0)
    order = np.argsort(key)
    new = np.ones(m, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    first = per
    while True:
        open_ = np.zeros(m, bool)
        open_[rank[length > first]] = True
        size = np.bincount(rank, minlength=m)
        live = np.flatnonzero(open_[rank] & (size[rank] > 1))
        if not len(live):
            break
        key = keys(live, first)
        order = np.lexsort((key, rank[live]))
        live, key = live[order], key[order]
        r, i = rank[live], np.arange(len(live))
        group, part = np.ones(len(live), bool), np.ones(len(live), bool)
        group[1:] = r[1:] != r[:-1]
        part[1:] = group[1:] | (key[1:] != key[:-1])
        rank[live] = r + np.maximum.accumulate(np.where(part, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        first += per
    used = np.zeros(m, bool)
    used[rank] = True
    return (np.cumsum(used) - 1)[rank], int(used.sum())


def _sorted_suffixes(t: np.ndarray, sigma: int) -> np.ndarray:
    """t ends with 0, its one least symbol."""
    small = suffix_types(t)
    first = small.copy()
    first[1:] &= ~small[:-1]
    first[0] = False
    at = np.flatnonzero(first)
    if len(at) <= 1:
        return induce(t, small, at, sigma)
    reduced, count = substring_names(t, at, sigma)
    if count == len(at):
        order = np.argsort(reduced)
    else:
        order = _sorted_suffixes(np.concatenate([reduced + 1, [0]]).astype(np.int16 if count < 32767 else np.int32), count + 1)[1:]
    return induce(t, small, at[order], sigma)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, border: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(lcp of each suffix with the one before it in order, that one's start or -1), both by position.

    A border byte ends a prefix and equals nothing, not even itself.  Values are compared
    out only where the preceding symbols differ or are borders; from there on they
    fall by one a position.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pad = np.concatenate([text, np.zeros(16, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(pad, 16)
    i = np.arange(n)
    fresh = (before <= 0) | (i == 0)
    inner = ~fresh
    last = text[i[inner] - 1]
    fresh[inner] = (last != text[before[inner] - 1]) | (last == border)
    at = np.flatnonzero(fresh & (before >= 0))
    length = np.zeros(n, np.int64)
    live = at
    while len(live):
        a, b = live + length[live], before[live] + length[live]
        room = n - np.maximum(a, b)
        x = view[np.minimum(a, n)]
        same = (x == view[np.minimum(b, n)]) & (x != border)
        run = np.where(same.all(axis=1), 16, same.argmin(axis=1))
        got = np.minimum(run, np.maximum(room, 0))
        length[live] += got
        live = live[got == 16]
    lead = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.maximum(length[lead] - (i - lead), 0), before
