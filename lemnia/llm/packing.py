"""Packing of tokenised documents into sequences, by cutting-stock column generation.

A document longer than a sequence gives whole sequences and a tail.  The tails'
length histogram, one count per possible length, is planned on the driver;
the plan says, for each length, which ranks go to which pattern, so each tail
finds its place from its rank alone.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cutting_stock import integer_plan
from .store import Tables
from .textcore import blocks, prefix_hash, span_hash

CAPACITY, END_ID = 1024, 0
#: Rows of a length that are ranked by one task, about.
RANKED_ROWS = 50_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of characters among which are white-space characters beyond ASCII.
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Byte-level BPE of a tokenizers file, run once per distinct piece of a block.

    A space between two characters that are no white space always starts a
    pre-token, so the ids of a text are those of its pieces cut there.  The
    file's added tokens cut a text and are one id each; as in tokenizers,
    ``encode_special_tokens`` spells the special ones out like any other text.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, tokens = file["model"]["vocab"], file.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError("added tokens that take in or look at their surroundings are not supported")
        self.added = {t["content"].encode(): t["id"] for t in tokens if not (encode_special_tokens and t["special"])}
        # at one place the longest is taken
        self.find = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        names = {t["content"] for t in tokens}
        # the file writes bytes as characters: printable ones as themselves, the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token) and token not in names}
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    @staticmethod
    def get(path: str, encode_special_tokens: bool = False) -> Encoder:
        key = path, encode_special_tokens
        if key not in _encoders:
            _encoders[key] = Encoder(*key)
        return _encoders[key]

    def pieces(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the pieces of all texts."""
        n = len(buf)
        x = np.concatenate([np.full(3, 32, np.uint8), buf, np.full(1, 32, np.uint8)])
        cut = (buf == 32) & ~_SPACE[x[2 : n + 2]] & ~_SPACE[x[4:]] & ~_MAYBE[x[4:]] & (x[1 : n + 1] != 0xC2) & ~_MAYBE[x[:n]]
        at = off[:-1][np.diff(off) > 0]
        cut[off[1:][off[1:] > 0] - 1] = False
        cut[at] = True
        return np.flatnonzero(cut)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by END_ID; offsets of the texts in them)."""
        start, end, ids = self._added_at(buf, off)
        if not len(start):
            return self._ordinary(buf, off)
        # the parts between added tokens are encoded as texts; in place of its end id, each has the token after it
        keep = np.ones(len(buf), bool)
        for s, e in zip(start, end, strict=True):
            keep[s:e] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        stop = np.concatenate([start, off[1:]])
        row = np.concatenate([np.searchsorted(off, start, "right") - 1, np.arange(len(off) - 1)])
        order = np.lexsort((np.arange(len(row)), row))
        out, at = self._ordinary(buf[keep], np.concatenate([[0], kept[stop[order]]]))
        out[at[1:] - 1] = np.concatenate([ids, np.full(len(off) - 1, END_ID)])[order]
        return out, at[np.searchsorted(row[order], np.arange(len(off)))]

    def _added_at(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ids of the added tokens, none of them across two texts."""
        found: list[tuple[int, int, int]] = []
        raw = buf.tobytes()
        if self.find is not None and self.find.search(raw):
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                found += [(m.start(), m.end(), self.added[m.group()]) for m in self.find.finditer(raw, s, e)]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def _ordinary(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts without added tokens."""
        n_rows = len(off) - 1
        if not len(buf):
            return np.full(n_rows, END_ID, np.uint32), np.arange(n_rows + 1)
        start = self.pieces(buf, off)
        end = np.append(start[1:], len(buf))
        _, first, inverse = np.unique(span_hash(prefix_hash(buf), start, end), return_index=True, return_inverse=True)
        s, e = start[first], end[first]
        # pieces that may stand next to each other in one text are encoded together
        second = buf[np.minimum(s + 1, len(buf) - 1)]
        last, before, third = buf[e - 1], buf[np.maximum(e - 2, 0)], buf[np.maximum(e - 3, 0)]
        free = (e - s >= 2) & (buf[s] == 32) & ~_SPACE[second] & ~_MAYBE[second] & ~_SPACE[last] & (before != 0xC2) & ~_MAYBE[third]
        order = np.concatenate([np.flatnonzero(free), np.flatnonzero(~free)])
        count = np.zeros(len(s), np.int64)
        parts = []
        k = int(free.sum())
        if k:
            fs, size = s[order[:k]], (e - s)[order[:k]]
            stop = np.cumsum(size)
            take = np.repeat(fs - (stop - size), size) + np.arange(stop[-1])
            ids = np.asarray(self.bpe.encode_ordinary(buf[take].tobytes().decode()), np.int64)
            ends = np.searchsorted(np.cumsum(self.size[ids]), stop) + 1
            count[order[:k]] = np.diff(ends, prepend=0)
            parts.append(ids)
        for i in order[k:]:
            ids = np.asarray(self.bpe.encode_ordinary(buf[s[i] : e[i]].tobytes().decode()), np.int64)
            count[i] = len(ids)
            parts.append(ids)
        flat = np.concatenate(parts)
        at = np.zeros(len(s), np.int64)
        at[order] = np.cumsum(count[order]) - count[order]
        times = count[inverse]
        stop = np.cumsum(times)
        body = flat[np.repeat(at[inverse] - (stop - times), times) + np.arange(stop[-1])]
        rows = np.concatenate([[0], stop])[np.searchsorted(start, off)]
        out = np.full(len(body) + n_rows, END_ID, np.uint32)
        out[np.arange(len(body)) + np.repeat(np.arange(n_rows), np.diff(rows))] = body
        return out, rows + np.arange(n_rows + 1)


def _measure(path: str, capacity: int, encode_special_tokens: bool):
    def run(batches):
        encoder = Encoder.get(path, encode_special_tokens)
        for batch in batches:
            for part, buf, off in blocks(batch):
                ids, at = encoder.encode(buf, off)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [[zlib.crc32(raw[4 * s : 4 * min(s + capacity, e)]) for s in range(int(at[i]), int(e), capacity)] for i, e in enumerate(at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n", "crcs"])

    return run


def _places(plan, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys (length, first rank) and rows (first rank, times, first sequence, offset) of the plan."""
    next_rank: dict[int, int] = {}
    keys, rows, seq = [], [], 0
    for pattern, count in plan:
        offset = 0
        for n, times in pattern:
            rank = next_rank.get(n, 0)
            keys.append((n, rank))
            rows.append((rank, times, seq, offset))
            next_rank[n] = rank + times * count
            offset += n * times
        seq += count
    order = sorted(range(len(keys)), key=keys.__getitem__)
    packed = np.array([(keys[i][0] << 48) | keys[i][1] for i in order], np.int64)
    return packed, np.array([rows[i] for i in order], np.int64).reshape(-1, 4), seq


def _place(keys: np.ndarray, rows: np.ndarray):
    def run(batches):
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            r = rows[np.searchsorted(keys, (n << 48) | rank, "right") - 1] if len(rank) else np.zeros((0, 4), np.int64)
            k = rank - r[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(r[:, 2] + k // np.maximum(r[:, 1], 1)), pa.array(r[:, 3] + k % np.maximum(r[:, 1], 1) * n)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, encode_special_tokens: bool = False) -> DataFrame:
    """One row per piece: its document, place in it, checksum of its ids, sequence and offset there.

    Null and empty texts are the end id alone.  Repeated rows are packed each;
    tails of equal length are ranked by id, equal ids in any order, as they are
    interchangeable.  Tails are never cut; longer texts fill whole sequences first.
    encode_special_tokens is that of tokenizers: False gives special tokens in the texts their own ids, True spells them out.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    tables = Tables(spark, "packing")
    picked = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    # as many files as the few bytes a document are worth, not one for each partition of the texts
    measured = picked.mapInArrow(_measure(str(path), capacity, encode_special_tokens), "doc_id long, n long, crcs array<long>")
    sized = tables.write(measured.hint("rebalance"), "sized")
    n, tail = F.col("n"), F.col("n") % capacity
    demand = {r["t"]: r["c"] for r in sized.groupBy(tail.alias("t")).agg(F.count("*").alias("c")).collect() if r["t"]}
    keys, rows, sequences = _places(integer_plan(demand, capacity), capacity)
    # a length that very many share is ranked in salted parts
    parts = max(1, -(-max(demand.values(), default=0) // RANKED_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    tails = sized.where(tail > 0).select(
        "doc_id", (n - tail).alias("start"), tail.alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), n.alias("doc_tokens"),
        F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(parts)).alias("salt"),
    )
    # length x part counts, whose running sums are the parts' first ranks
    counts = tails.groupBy("length", "salt").agg(F.count("*").alias("c"))
    before = counts.select("length", "salt", (F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c")).alias("before"))
    ranked = tails.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("r"))
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_place(keys, rows), SCHEMA)
    whole = sized.where(n >= capacity).select("doc_id", n.alias("doc_tokens"), F.posexplode(F.slice("crcs", F.lit(1), F.floor(n / capacity).cast("int"))).alias("k", "ids_crc32"))
    whole = whole.select(
        "doc_id", (F.col("k").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return placed.unionByName(whole)
