"""Quality classifier: a byte-level convolutional network in numpy.

Each filter is a table of weights by byte and offset, so a convolution is a
sum of table rows.  A text is cut into overlapping chunks that cover it
whole; each filter's greatest response in a chunk is kept (max pooling), and
the mean and the least over the chunks, with the greatest, make one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_sample
from .textcore import blocks, buffers

FILTERS, WIDTH, CHUNK, OVERLAP = 16, 4, 384, 64
#: The bound of the labelled sample, and passes over it.
TRAIN_ROWS, EPOCHS, BATCH, RATE = 3000, 6, 32, 0.01
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_chunks long"


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of a text of n bytes: each begins OVERLAP before the last one's end."""
    step = CHUNK - OVERLAP
    return np.arange(0, max(1, n - OVERLAP), step)


class Network:
    """Weights of the filters, and of the pooled responses' logistic combination."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    @staticmethod
    def spread(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The bytes with WIDTH - 1 zeros after each text, so that no filter reaches into the next one."""
        n = len(off) - 1
        wide = np.zeros(len(buf) + n * (WIDTH - 1), np.uint8)
        wide[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(off)) * (WIDTH - 1)] = buf
        return wide

    def chunks(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of all chunks of a block, as positions in its spread bytes."""
        n = np.diff(off)
        starts = [chunk_starts(int(k)) for k in n]
        row = np.repeat(np.arange(len(n)), [len(s) for s in starts])
        a = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        base = off[row] + row * (WIDTH - 1)
        return row, base + a, base + np.minimum(a + CHUNK, n[row])

    def respond(self, buf: np.ndarray) -> np.ndarray:
        """Each filter's response at each byte position, bytes beyond the end as 0."""
        n = len(buf)
        x = np.concatenate([buf, np.zeros(WIDTH, np.uint8)])
        y = self.table[0][x[:n]]
        for k in range(1, WIDTH):
            y += self.table[k][x[k : n + k]]
        y += self.bias
        return y

    def pool(self, buf: np.ndarray, off: np.ndarray, where: bool = False):
        """Pooled responses of each chunk, and the positions that gave them if asked for."""
        row, a, b = self.chunks(off)
        if not len(row):
            return row, np.zeros((0, FILTERS), np.float32), None
        if not len(buf):
            return row, np.zeros((len(row), FILTERS), np.float32), np.full((len(row), FILTERS), -1)
        y = np.concatenate([self.respond(self.spread(buf, off)), np.full((1, FILTERS), -1e9, np.float32)])
        if where:
            at = np.full((len(row), FILTERS), -1)
            for i in range(len(row)):
                if b[i] > a[i]:
                    at[i] = a[i] + np.argmax(y[a[i] : b[i]], axis=0)
            top = np.take_along_axis(y, at, axis=0)
        else:
            at, top = None, np.maximum.reduceat(y, np.stack([a, b], 1).ravel(), axis=0)[::2]
        top = np.where((b > a)[:, None], np.maximum(top, 0), 0)
        return row, top, at

    @staticmethod
    def combine(row: np.ndarray, top: np.ndarray, n: int):
        """Mean, least and greatest pooled responses of each row; every row has a chunk."""
        first = np.searchsorted(row, np.arange(n))
        count = np.bincount(row, minlength=n)[:, None]
        return first, count, np.concatenate([np.add.reduceat(top, first) / count, np.minimum.reduceat(top, first), np.maximum.reduceat(top, first)], 1)

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(off) - 1
        row, top, _ = self.pool(buf, off)
        _, count, z = self.combine(row, top, n)
        return 1 / (1 + np.exp(-np.clip((z @ self.out + self.out_bias).astype(float), -30, 30))), count[:, 0]

    def gradients(self, buf: np.ndarray, off: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> list[np.ndarray]:
        """Of the weighed log loss, with a little decay, by the filters, their biases, the combination and its bias."""
        row, top, at = self.pool(buf, off, where=True)
        first, count, z = self.combine(row, top, len(off) - 1)
        p = 1 / (1 + np.exp(-np.clip(z @ self.out + self.out_bias, -30, 30)))
        d = (p - y) * weigh
        dz = d[:, None] * self.out
        f = FILTERS
        g_top = dz[row, :f] / count[row]
        for k in (f, 2 * f):  # the least and the greatest; chunks that tie, as through what they both hold, share it
            same = top == z[row, k : k + f]
            g_top += dz[row, k : k + f] * same / np.maximum(np.add.reduceat(same.astype(int), first), 1)[row]
        g_top = g_top * (top > 0)
        x = np.concatenate([self.spread(buf, off), np.zeros(WIDTH + 1, np.uint8)])
        g_table = 1e-5 * self.table
        lane = np.broadcast_to(np.arange(f), at.shape)
        live = g_top != 0
        for k in range(WIDTH):
            np.add.at(g_table[k], (x[at[live] + k], lane[live]), g_top[live])
        return [g_table, g_top.sum(0), z.T @ d + 1e-4 * self.out, np.array([d.sum()])]

    def train(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam on the log loss, both classes weighed alike; needs rows of both."""
        y_all = np.asarray(labels, np.float32)
        if not len(y_all) or y_all.min() == y_all.max():
            return self
        weigh = np.where(y_all == 1, 0.5 / y_all.mean(), 0.5 / (1 - y_all.mean()))
        weigh = np.sqrt(weigh)
        params = [self.table, self.bias, self.out, self.out_bias]
        m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
        r, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                buf, off = buffers(pa.array([texts[j] for j in pick], pa.large_string()))
                grads = self.gradients(buf, off, y_all[pick], weigh[pick] / len(pick))
                step += 1
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    q -= (RATE * (0.3 if epoch >= epochs - 2 else 1) * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def _score(net: Network):
    def run(batches):
        for batch in batches:
            for whole, buf, off in blocks(batch):
                at = 0
                while at < whole.num_rows:  # small slices keep the responses in cache
                    to = max(at + 1, int(np.searchsorted(off, off[at] + 262144, "right")) - 1)
                    part = whole.slice(at, to - at)
                    p, n = net.predict(buf[off[at] : off[to]], off[at : to + 1] - off[at])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.7).astype(np.int32)), pa.array(n)],
                        ["doc_id", "held_out", "score", "predicted", "n_chunks"],
                    )
                    at = to

    return run


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row, in one pass.

    Null and empty texts are one empty chunk whose responses are 0; repeated
    rows get equal scores; a null id has no fold, so held_out is null.  With no
    rows of both labels the starting weights are kept.
    """
    net = Network().train(*training_sample(docs, labels, "quality", 4, 2, rows, "quality"))
    picked = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    return picked.withColumn("held_out", fold(F.col("id"), 4) == 2).mapInArrow(_score(net), SCHEMA)
