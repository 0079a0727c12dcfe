"""Columnar text primitives shared by the Arrow-batched operators.

All of them work on one byte buffer holding many texts back to back, so their
cost is a few vector passes per byte instead of a Python call per word.
Null texts count as empty ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20

#: The white space that separates words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[48:58] = IS_ALNUM[65:91] = IS_ALNUM[97:123] = IS_ALNUM[128:] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the SplitMix generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    _KEYS = mix(np.arange(1001, 1065, dtype=np.uint64) * _STEP) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64, for n positions."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums of the polynomial hash, with a leading 0, for span_hash."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(len(buf) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal bytes at any position."""
    inv = _power(len(sums))[1]
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its len + 1 offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES):
    """(slice of the batch, bytes, offsets), of at most ``size`` bytes or one row."""
    buf, off = buffers(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs, cut where a text begins."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = off[1:-1]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    inner = cut[(cut > 0) & (cut < len(mask))]
    begins[inner] = mask[inner]
    ends[inner - 1] = mask[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def rows_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each row, the index of its first item; len + 1 entries."""
    return np.searchsorted(starts, off)


class Words:
    """The words of a block: spans, hashes, and the first word of each row."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool, alnum: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.start, self.end = runs((IS_ALNUM if alnum else IS_WORD)[buf], off)
        self.first = rows_of(self.start, off)
        self.count = np.diff(self.first)
        self.hash = span_hash(prefix_hash(self.buf), self.start, self.end)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive items, over row ends too (see gram_rows)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _KEYS[j]
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, sorted by both.

    A row of 1 to k-1 words has one shingle, its whole sequence.
    """
    g = grams(words.hash, k)
    row = words.row()
    keep = np.zeros(len(g), bool)
    if len(g):
        keep = row[: len(g)] == row[k - 1 :]
    r, h = row[: len(g)][keep], g[keep]
    for n in range(1, k):
        short = np.flatnonzero(words.count == n)
        if len(short):
            at = words.first[short]
            x = np.zeros(len(short), np.uint64)
            for j in range(n):
                x += words.hash[at + j] * _KEYS[j]
            r, h = np.concatenate([r, short]), np.concatenate([h, mix(x + np.uint64(n))])
    # one sort of (row, hash): rows are few, so order by hash, then stably by row
    order = np.argsort(h)
    order = order[np.argsort(r[order].astype(np.uint16 if len(words.count) < 65536 else np.int64), kind="stable")]
    r, h = r[order], h[order]
    if len(r):
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        r, h = r[new], h[new]
    return r, h


def char_positions(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte position; len + 1 entries."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out
