"""Cutting stock by column generation over a histogram of lengths.

The linear program has one row per length that occurs (at most CAPACITY - 1)
and columns that are patterns, multisets of lengths that share a sequence.
Its size does not depend on the number of documents.
"""

from __future__ import annotations

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def padded(used: int, capacity: int) -> int:
    """Tokens that a sequence occupies: capacity, or what it holds if that is a power of two."""
    return used if used & (used - 1) == 0 else capacity


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic programming: best value of each exact fill, and the last item taken."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for u in range(1, capacity + 1):
        k = fits[u]
        if k:
            got = best[u - lengths[:k]] + value[:k]
            i = int(got.argmax())
            best[u], took[u] = got[i], i
    return best, took


def _column(u: int, lengths: np.ndarray, took: np.ndarray) -> np.ndarray:
    col = np.zeros(len(lengths))
    while u > 0:
        i = took[u]
        col[i] += 1
        u -= lengths[i]
    return col


def starting_basis(lengths: np.ndarray, d: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first basis: (columns, counts, inverse).

    The longest length with demand left is filled up with the longest that
    still fit, and the pattern is used until one of its lengths runs out.  That
    length's column is the pattern.  Later patterns hold none of it, so in the
    order of running out the basis is lower triangular.
    """
    m = len(lengths)
    left = d.copy()
    cols, x = np.zeros((m, m)), np.zeros(m)
    order: list[int] = []
    for _ in range(m):
        open_ = np.flatnonzero(left > 0)
        if not len(open_):
            break
        col = np.zeros(m)
        room, at = capacity, len(open_)
        while at > 0:
            at = min(at, int(np.searchsorted(lengths[open_], room, "right")))
            if not at:
                break
            i = open_[at - 1]
            col[i] = min(room // lengths[i], max(1, int(left[i])))
            room -= int(col[i]) * lengths[i]
            at -= 1
        used = np.flatnonzero(col)
        ratio = left[used] / col[used]
        k = int(ratio.argmin())
        step, out = ratio[k], used[k]
        left[used] -= step * col[used]
        left[out] = 0
        left[np.abs(left) < 1e-9] = 0
        cols[:, out], x[out] = col, step
        # lengths that ran out together with another are columns of their own
        order += [int(out), *(int(i) for i in used if i != out and left[i] == 0)]
    rest = set(range(m)) - set(order)
    order += sorted(rest)
    for i in np.flatnonzero(~cols.any(axis=0)):
        cols[i, i] = 1
    return cols, x, triangular_inverse(cols, np.array(order))


def triangular_inverse(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The inverse of a matrix that is lower triangular in the given order of rows and columns, by substitution.

    Sums run without the linear-algebra library, whose threads may hang in a
    process that has forked, as a Spark driver has.
    """
    out = np.zeros_like(a)
    for k in order:
        row = a[k].copy()
        row[k] = 0
        used = np.flatnonzero(row)
        out[k] = -(row[used, None] * out[used]).sum(axis=0)
        out[k, k] += 1
        out[k] /= a[k, k]
    return out


def solve(demand: dict[int, int], capacity: int, gap: float = 2e-4, rounds: int = 400) -> list[tuple[Pattern, float]]:
    """Patterns with fractional counts that cover the demand at near least padded size.

    Ends when no pattern prices out, when the size is within ``gap`` of the
    tokens themselves, or after ``rounds`` pricings; rounding is exact in any case.
    """
    lengths = np.array(sorted(demand), np.int64)
    d = np.array([demand[k] for k in sorted(demand)], float)
    m = len(lengths)
    if not m:
        return []
    cost_of = np.array([0] + [padded(u, capacity) for u in range(1, capacity + 1)], float)
    cols, x, inv = starting_basis(lengths, d, capacity)
    cost = cost_of[(lengths[:, None] * cols).sum(axis=0).astype(int)]
    floor = float((d * lengths).sum())
    for _ in range(rounds):
        if (cost * x).sum() <= floor * (1 + gap):
            break
        dual = (cost[:, None] * inv).sum(axis=0)
        best, took = price(lengths, dual, capacity)
        better = best - cost_of
        better[0] = -np.inf
        entered = False
        for u in np.argsort(-better)[:4]:  # several good fills of one pricing
            if not better[u] > 1e-7 * capacity:
                break
            col = _column(int(u), lengths, took)
            used = np.flatnonzero(col)
            w = (inv[:, used] * col[used]).sum(axis=1)
            if (cost * w).sum() - cost_of[u] <= 1e-7 * capacity:
                continue
            up = w > 1e-9
            if not up.any():
                continue
            ratio = np.full(m, np.inf)
            ratio[up] = np.maximum(x[up], 0) / w[up]
            i = int(ratio.argmin())
            step = ratio[i]
            x -= step * w
            x[i] = step
            pivot = inv[i] / w[i]
            inv -= np.outer(w, pivot)
            inv[i] = pivot
            cols[:, i], cost[i] = col, cost_of[u]
            entered = True
        if not entered:
            break
    return [(tuple((int(lengths[k]), int(cols[k, j])) for k in np.flatnonzero(cols[:, j])[::-1]), float(x[j])) for j in range(m) if x[j] > 1e-9]


def best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing of what rounding leaves over."""
    free: dict[int, list[dict[int, int]]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for n in sorted(left, reverse=True):
        for _ in range(left[n]):
            room = n + int(np.argmax(rooms[n:])) if rooms[n:].any() else -1
            if room < 0:
                seq: dict[int, int] = {}
                room = capacity
            else:
                seq = free[room].pop()
                rooms[room] = bool(free[room])
            seq[n] = seq.get(n, 0) + 1
            free.setdefault(room - n, []).append(seq)
            rooms[room - n] = True
    return [tuple(sorted(s.items(), reverse=True)) for seqs in free.values() for s in seqs]


def integer_plan(demand: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns with whole counts that hold each item exactly once.

    The counts come from the linear program at any size of the demand.
    """
    left = {k: v for k, v in demand.items() if v > 0}
    if not left:
        return []
    solved = solve(left, capacity)
    counts = {}
    for p, x in solved:
        counts[p] = counts.get(p, 0) + int(x + 1e-9)
    for p, c in list(counts.items()):  # never more than there is
        c = min([c, *(left[n] // k for n, k in p)])
        counts[p] = c
        for n, k in p:
            left[n] -= c * k
    for p, _ in sorted(solved, key=lambda s: (-(s[1] % 1), s[0])):  # fractions, the greatest first
        if all(left[n] >= k for n, k in p):
            counts[p] += 1
            for n, k in p:
                left[n] -= k
    return [(p, c) for p, c in counts.items() if c] + [(p, 1) for p in best_fit({n: c for n, c in left.items() if c}, capacity)]
