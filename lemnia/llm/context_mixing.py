"""Logistic mixing of hashed-context bit predictors.

A byte is predicted bit by bit.  For each order k of 1 to ORDERS, the last k
bytes and the bits so far hash to a slot of that order's table, which counts
zeros and ones seen there; a table has as many slots as its contexts need.  The
counts' log odds are summed with weights that a gate picks (bit number, and how
many orders know the context); the weights are learned online, each example
without its own counts.  A table then corrects the mixed probability by what was
seen at it.  Two such mixers, of all orders and of the low ones, are followed
through each text, and the one that did better on the last bytes counts more
for the next.  Contexts begin and texts end with byte 0; a text's own byte 0
is taken for byte 255, which UTF-8 never has.
"""

from __future__ import annotations

import numpy as np

from .textcore import mix

ORDERS = 5
#: Orders whose contexts are so few that their tables are the same for all tasks: at most 2**24 context-byte pairs.
SHARED = 2
GATES = 8 * (ORDERS + 1)
PRIOR, CLIP, RATE, STEPS = 0.15, 7.0, 0.02, 33
#: Orders of each mixer; bytes back that decide between mixers; how much less likely the others are than the first at first.
MIXERS = (ORDERS, 3)
WINDOW, FIRST = 256, 3.0
#: Steps of a log probability as it is stored, per nat; rounded down, so that probabilities sum to at most 1.
FINE = 128
#: Bytes followed at a time, so that what is computed for them stays in the cache.
PART = 65536
_STEP = np.uint64(0x9E3779B97F4A7C15)


def text_grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each byte of all texts with their ends, the ORDERS bytes before, nearest first, and the byte itself, packed; offsets of the texts in them)."""
    n = len(off) - 1
    at = off + np.arange(n + 1)
    index = np.int32 if len(buf) + n * (ORDERS + 1) < 1 << 31 else np.int64
    # each text after as many bytes 0 as a context has, its end among those of the next one
    wide = np.zeros(len(buf) + n * (ORDERS + 1), np.uint8)
    gap = np.repeat(np.arange(n, dtype=index) * index(ORDERS + 1) + index(ORDERS), np.diff(off))
    gap += np.arange(len(buf), dtype=index)
    wide[gap] = buf
    wide[gap[buf == 0]] = 255
    del gap
    # packed at every place of ``wide`` by slices, then picked where a byte or an end is
    size = len(wide) - ORDERS
    g = np.zeros(max(0, size), np.uint64)
    for j in (*range(ORDERS - 1, -1, -1), ORDERS):
        g <<= np.uint64(8)
        g |= wide[j : j + size]
    pick = np.repeat(np.arange(n, dtype=index) * index(ORDERS), np.diff(at))
    pick += np.arange(at[-1], dtype=index)
    g = g[pick]
    return g, at


def shortened(grams: np.ndarray, order: int) -> np.ndarray:
    """The nearest ``order`` bytes and the byte itself, packed."""
    return (grams >> np.uint64(8 * (ORDERS + 1 - order)) << np.uint64(8)) | (grams & np.uint64(255))


def nodes(short: np.ndarray, order: int):
    """For the 8 bits of each byte, from shortened grams: (hash of the order's context and the bits so far, bit)."""
    with np.errstate(over="ignore"):
        base = mix((short >> np.uint64(8)) * _STEP + np.uint64(order))
        byte = (short & np.uint64(255)).astype(np.int64)
        for k in range(8):
            node = ((byte | 256) >> (8 - k)).astype(np.uint64)  # the bits so far, after a leading 1
            yield mix(base + node * np.uint64(0xC2B2AE3D27D4EB4F)), (byte >> (7 - k)) & 1


def counted(grams: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shortened grams, their counts)."""
    g, inverse = np.unique(shortened(grams, order), return_inverse=True)
    return g, np.bincount(inverse, weights=counts, minlength=len(g))


def count_table(short: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """(2, slots) zeros and ones of distinct shortened grams, with at least sixteen slots for each context and bits so far."""
    distinct = sum(1 + np.count_nonzero(np.diff(short >> np.uint64(8 - k))) for k in range(8))
    bits = max(12, int(16 * distinct).bit_length())
    out = np.zeros((2, 1 << bits), np.float32)
    for h, bit in nodes(short, order):
        s = (h >> np.uint64(64 - bits)).astype(np.int64)
        for b in (0, 1):
            got = bit == b
            out[b] += np.bincount(s[got], weights=counts[got], minlength=1 << bits)
    return out


def tables_of(grams: np.ndarray, counts: np.ndarray, orders) -> list[np.ndarray]:
    """A table for each of the orders, from distinct grams."""
    return [count_table(*counted(grams, counts, k), k) for k in orders]


class Model:
    """Count tables by order, gated weights, and the last correction, for each mixer."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.tables = tables
        first = np.tile(np.append(np.full(ORDERS, 0.3), 0.0), (len(MIXERS), GATES, 1))
        self.weights = (first if weights is None else weights.copy()).astype(np.float32)
        for e, k in enumerate(MIXERS):
            self.weights[e, :, k:ORDERS] = 0
        self.refine = refine  # (mixers, 8, STEPS) log odds, or None

    def inputs(self, grams: np.ndarray, without: bool):
        """For each bit: (number, inputs, gate, the bit); without: each gram's own count is left out."""
        its = [nodes(shortened(grams, k), k) for k in range(1, ORDERS + 1)]
        for number in range(8):
            x = np.ones((len(grams), ORDERS + 1), np.float32)
            known = np.zeros(len(grams), np.int64)
            for k, table in enumerate(self.tables):
                h, bit = next(its[k])
                s = (h >> np.uint64(65 - int(table.shape[1]).bit_length())).astype(np.int64)
                zeros, ones = table[0, s], table[1, s]
                if without:
                    zeros, ones = np.maximum(zeros - (1 - bit), 0).astype(np.float32), np.maximum(ones - bit, 0).astype(np.float32)
                known += zeros + ones > 0
                x[:, k] = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
            yield number, np.clip(x, -CLIP, CLIP), number * (ORDERS + 1) + known, bit

    def mixed(self, mixer: int, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[mixer][gate]), -CLIP - 3, CLIP + 3)

    def refined(self, mixer: int, number: int, z: np.ndarray) -> np.ndarray:
        """Log odds after the correction, interpolated between its steps and averaged with what came in."""
        if self.refine is None:
            return z
        at = (np.clip(z, -CLIP, CLIP) + CLIP) / (2 * CLIP) * (STEPS - 1)
        i = np.minimum(at.astype(np.int64), STEPS - 2)
        t = at - i
        r = self.refine[mixer, number]
        return (z + r[i] * (1 - t) + r[i + 1] * t) / 2

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        """(mixers, grams) natural log of the probability of each gram's byte after its context."""
        out = np.zeros((len(MIXERS), len(grams)))
        for number, x, gate, bit in self.inputs(grams, without=False):
            for e in range(len(MIXERS)):
                z = self.refined(e, number, self.mixed(e, x, gate))
                out[e] -= np.logaddexp(0, np.where(bit == 1, -z, z))
        return out

    def learn(self, grams: np.ndarray, counts: np.ndarray, batch: int = 2048) -> None:
        """One online pass of the gate weights over the grams, in hash order."""
        order = np.argsort(mix(grams))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            c = np.sqrt(counts[pick])
            for _, x, gate, bit in self.inputs(grams[pick], without=True):
                total = np.bincount(gate, weights=c, minlength=GATES)
                rate = 4 * RATE * np.minimum(1, total / 32) / np.maximum(total, 1)
                for e, k in enumerate(MIXERS):
                    err = (bit - 1 / (1 + np.exp(-self.mixed(e, x, gate)))) * c
                    for j in (*range(k), ORDERS):
                        self.weights[e, :, j] += rate * np.bincount(gate, weights=err * x[:, j], minlength=GATES)

    def observe(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(mixers, 8, STEPS, 2) zeros and ones seen at each mixed probability, for the correction."""
        seen = np.zeros((len(MIXERS), 8, STEPS, 2))
        for number, x, gate, bit in self.inputs(grams, without=True):
            for e in range(len(MIXERS)):
                i = np.rint((np.clip(self.mixed(e, x, gate), -CLIP, CLIP) + CLIP) / (2 * CLIP) * (STEPS - 1)).astype(np.int64)
                for b in (0, 1):
                    seen[e, number, :, b] = np.bincount(i, weights=counts * (bit == b), minlength=STEPS)
        return seen

    @staticmethod
    def correction(seen: np.ndarray) -> np.ndarray:
        """Log odds by step from sums of observe(); a step's own log odds weigh like 20 sights."""
        odds = np.linspace(-CLIP, CLIP, STEPS)
        p = 1 / (1 + np.exp(-odds))
        return np.log((seen[..., 1] + 20 * p) / (seen[..., 0] + 20 * (1 - p)))


def stored(log_p: np.ndarray) -> np.ndarray:
    """(mixers, n) log probabilities as whole steps below 0."""
    return np.minimum(np.ceil(-log_p * FINE), 65535).astype("<u2")


#: Probabilities by stored step.
_STEPS_P = np.exp(np.arange(65536) / -FINE)


def follow(steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of each byte's probability, from stored() ones of each mixer for all texts' bytes.

    A mixer's weight at a byte is what it gave the WINDOW bytes before, in the same text.
    """
    n = steps.shape[1]
    sums = np.zeros((len(steps), n + 1), np.int64)
    np.cumsum(steps, axis=1, out=sums[:, 1:])
    first = np.repeat(at[:-1], np.diff(at))
    out = np.empty(n)
    for a in range(0, n, PART):
        b = min(a + PART, n)
        begin = np.maximum(np.arange(a, b) - WINDOW, first[a:b])
        w = np.empty((len(steps), b - a))
        for k in range(len(steps)):
            w[k] = (sums[k, begin] - sums[k, a:b]) / FINE - (FIRST if k else 0)
        w -= w.max(axis=0)
        np.exp(w, out=w)
        total = w.sum(axis=0)
        w *= _STEPS_P[steps[:, a:b]]
        out[a:b] = np.log(w.sum(axis=0) / total)
    return out
