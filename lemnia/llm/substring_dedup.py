"""Exact removal of repeated byte strings with suffix arrays over shards.

Every window of LEAST bytes picks an anchor, its least-hashed GRAM bytes, so
equal windows pick equal anchors.  Consecutive windows with one anchor are a
unit.  Anchors that occur once can't lie in a repeated window.  Of the others,
equal units are counted and one of each goes, with its count, to the anchor's
shard, where the suffix array and its common prefixes tell which windows are
repeated.  An anchor with more distinct units than a
shard should hold is split by longer anchors: a unit is cut where its windows
reach further to the left or to the right of the anchor, and what all windows
of a part share, the anchor and the bytes around it, is the part's new anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables
from .suffix_array import permuted_lcp, suffix_array
from .textcore import blocks, buffers, mix, prefix_hash, span_hash

LEAST, GRAM = 200, 32
#: Bytes of text that a shard holds, about; and distinct units of an anchor beyond which it is split.
SHARD_BYTES, ANCHOR_UNITS = 2 << 20, 4000
#: Rows up to which a list of ids is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def anchors(buf: np.ndarray, sums: np.ndarray, least: int, gram: int) -> np.ndarray:
    """The position of each window's anchor: the first of its least-hashed grams."""
    n = len(buf) - gram + 1
    at = np.arange(n)
    key = (span_hash(sums, at, at + gram) & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    w = least - gram + 1
    blocks_ = -(-n // w)
    pad = np.full(blocks_ * w, np.uint64((1 << 64) - 1))
    pad[:n] = key
    grid = pad.reshape(blocks_, w)
    down = np.minimum.accumulate(grid, axis=1).ravel()
    up = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(buf) - least + 1
    return (np.minimum(up[:windows], down[w - 1 : w - 1 + windows]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def units(buf: np.ndarray, off: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """(row, first window's start in the row, number of windows, anchor hash, unit hash, anchor's place in the unit) of all units of a block."""
    none = np.zeros(0, np.int64)
    parts = []
    # positions take 24 bits of a key, so longer blocks (one long text) go in overlapping pieces
    size = len(buf)
    step = (1 << 24) - least
    for base in range(0, max(1, size - least + 1), step):
        piece = buf[base : min(size, base + step + least - 1)]
        if len(piece) < least:
            continue
        sums = prefix_hash(piece)
        anchor = anchors(piece, sums, least, gram)
        start = np.arange(len(anchor))
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))[base : base + len(anchor)]
        ok = off[row + 1] - base >= start + least
        edge = np.ones(len(anchor), bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
        edge &= ok
        s = np.flatnonzero(edge)
        if not len(s):
            continue
        total = np.concatenate([[0], np.cumsum(ok)])
        stop = np.append(s[1:], len(anchor))
        n = total[stop] - total[s]
        a = anchor[s]
        parts.append((row[s], s + base - off[row[s]], n, span_hash(sums, a, a + gram), span_hash(sums, s, s + n - 1 + least), a - s))
    if not parts:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _units(batches):
    """Units met once in their block with c = 1.  Of those met again one has c = 2 and stands for all, and each has c = 0."""
    for batch in batches:
        for part, buf, off in blocks(batch):
            row, s, n, a, h, q = units(buf, off)
            _, one, which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            pick = np.concatenate([one, np.flatnonzero(count[which] > 1)])
            c = np.where(np.arange(len(pick)) >= len(one), 0, np.minimum(count[which[pick]], 2)).astype(np.int32)
            take = pa.array(row[pick])
            cols = [pa.array(x) for x in (a[pick].view(np.int64), h[pick].view(np.int64), s[pick], n[pick].astype(np.int32), q[pick].astype(np.int32), c)]
            yield pa.RecordBatch.from_arrays([part.column("i").take(take), part.column("u").take(take), *cols], ["i", "u", "a", "h", "s", "n", "q", "c"])


#: A piece, named by anchor and hash, of what is named (a, h): its windows from o on.  The first anchor lies q bytes after the
#: piece's first window, and its windows reach from lo to hi - 1 bytes to the left of that; c: 2 if met again.
PIECE = "a long, h long, o int, anchor long, hash long, n int, q int, lo int, hi int, c int, bytes binary"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]


def _cut(batches):
    """Texts with the units wanted of them, to the units' bytes."""
    for batch in batches:
        buf, off = buffers(batch.column("text"))
        raw, wanted = buf.tobytes(), batch.column("wanted")
        rows, flat = wanted.value_lengths().to_numpy(), wanted.flatten()
        base = np.repeat(off[:-1], rows)
        for i in range(0, len(flat), 4000):
            part = flat.slice(i, 4000)
            s, n = part.field("s").to_numpy(), part.field("n").to_numpy().astype(np.int64)
            text = [raw[x : x + k] for x, k in zip((base[i : i + 4000] + s).tolist(), (n + LEAST - 1).tolist(), strict=True)]
            k, zero = len(s), np.zeros(len(s), np.int32)
            cols = [part.field("a"), part.field("h"), zero, part.field("a"), part.field("h"), part.field("n"), part.field("q"), zero, np.full(k, LEAST - GRAM + 1, np.int32), part.field("c"), pa.array(text, pa.binary())]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], _NAMES)


def _split(batches):
    """Pieces to the halves of their windows that reach less and more to the left."""
    for batch in batches:
        b = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in _NAMES if k != "bytes"}
        text, out = batch.column("bytes").to_pylist(), []
        mid = (b["lo"] + b["hi"]) // 2
        for lo, hi in ((b["lo"], mid), (mid, b["hi"])):
            first, last = np.maximum(0, b["q"] - hi + 1), np.minimum(b["n"] - 1, b["q"] - lo)
            for k in np.flatnonzero((first <= last) & (lo < hi)):
                f, z, q = int(first[k]), int(last[k]), int(b["q"][k])
                # what all windows of the half share
                out.append((k, f, z, lo[k], hi[k], text[k][q - lo[k] : q - hi[k] + 1 + LEAST], text[k][f : z + LEAST]))
        if not out:
            continue
        k, f, z, lo, hi, shared, cut = (np.array(x) if i < 5 else x for i, x in enumerate(zip(*out, strict=True)))
        new = {"a": b["anchor"][k], "h": b["hash"][k], "o": f, "anchor": mix(_hashes(shared) ^ b["anchor"][k].view(np.uint64) ^ lo.astype(np.uint64)).view(np.int64), "hash": _hashes(cut).view(np.int64), "n": z - f + 1, "q": b["q"][k] - f, "lo": lo, "hi": hi, "c": b["c"][k]}
        yield pa.RecordBatch.from_arrays([*(pa.array(new[c].astype(np.int64 if c in ("a", "h", "anchor", "hash") else np.int32)) for c in _NAMES[:-1]), pa.array(cut, pa.binary())], _NAMES)


def _hashes(texts) -> np.ndarray:
    stop = np.cumsum([len(x) for x in texts])
    return span_hash(prefix_hash(np.frombuffer(b"".join(texts), np.uint8)), np.concatenate([[0], stop[:-1]]), stop)


def repeated_windows(texts: list[bytes], n: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For all first n[i] windows of each text in turn, whether it is repeated among them all."""
    size = np.array([len(x) for x in texts], np.int64) + 1
    at = np.cumsum(size) - size
    joined = np.frombuffer(b"".join(x + b"\xff" for x in texts), np.uint8)  # a byte that UTF-8 never has
    sa = suffix_array(joined)
    lcp, before = permuted_lcp(joined, sa, 0xFF)
    same = np.flatnonzero(lcp >= least)
    hit = np.zeros(len(joined), bool)
    hit[same] = True
    hit[before[same]] = True
    n = n.astype(np.int64)
    stop = np.cumsum(n)
    return hit[np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]


def spans(hit: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, end) of the byte runs covered by the hit windows of each unit."""
    stop = np.cumsum(n)
    unit = np.repeat(np.arange(len(n)), n)
    x = np.flatnonzero(hit)
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x) > 1) | (unit[x[1:]] != unit[x[:-1]])
    first = x[new]
    last = x[np.append(np.flatnonzero(new)[1:], len(x)) - 1] if len(x) else x
    base = (stop - n)[unit[first]]
    return unit[first], first - base, last - base + least


def _shard(table: pa.Table) -> pa.Table:
    """(anchor, hash, start, end): what is repeated of each piece.

    Equal pieces are one string with a count.  All suffixes of a string met again have an equal neighbour, its copy's.
    """
    texts, n = table.column("bytes").to_pylist(), table.column("n").to_numpy().astype(np.int64)
    hit = repeated_windows(texts, n) | np.repeat(table.column("c").to_numpy() > 1, n)
    unit, start, end = spans(hit, n, LEAST)
    return pa.table({"anchor": table.column("anchor").to_numpy()[unit], "hash": table.column("hash").to_numpy()[unit], "start": start.astype(np.int32), "end": end.astype(np.int32)})


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def _remove(keep_text: bool):
    def run(batches):
        for batch in batches:
            buf, off = buffers(batch.column("text"))
            raw = buf.tobytes()
            lists = batch.column("spans")
            out: list[tuple] = []
            for i, pairs in enumerate(lists):
                text = raw[off[i] : off[i + 1]]
                removed = count = 0
                if pairs.is_valid and len(pairs):
                    v = pairs.values
                    s, e = _merge(v.field("s").to_numpy(), v.field("e").to_numpy())
                    removed, count = int((e - s).sum()), len(s)
                    edge = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
                    text = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                out.append((int(off[i + 1] - off[i]), removed, count, hashlib.sha256(text).hexdigest(), text if keep_text else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            arrays = [batch.column("id"), *(pa.array(cols[k], pa.int64()) for k in range(3)), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _decided(pieces: DataFrame, tables: Tables, level: int) -> tuple[DataFrame, DataFrame | None]:
    """((anchor, hash, start, end) of the repeated spans of distinct pieces, pieces of anchors that are to be split or None)."""
    stats = pieces.groupBy("anchor").agg(F.count("*").alias("k"), F.max(F.col("hi") - F.col("lo")).alias("wide"))
    hot = tables.write(stats.where((F.col("k") > ANCHOR_UNITS) & (F.col("wide") > 1)).select("anchor"), f"hot{level}")
    some = bool(hot.head(1))
    n_bytes = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-n_bytes // SHARD_BYTES))
    cool = pieces.join(hot, "anchor", "left_anti") if some else pieces
    cool = cool.select("anchor", "hash", "n", "c", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    found = tables.write(cool.groupBy("shard").applyInArrow(_shard, "anchor long, hash long, start int, end int"), f"spans{level}")
    return found, pieces.join(hot, "anchor", "left_semi") if some else None


def _repeats(pieces: DataFrame, tables: Tables, level: int = 0) -> DataFrame:
    """(anchor, hash, start, end): the repeated spans of distinct pieces."""
    found, hot = _decided(pieces, tables, level)
    if hot is None:
        return found
    # windows are halved, so this goes eight levels deep at most
    parts = tables.write(hot.mapInArrow(_split, PIECE), f"split{level}")
    often = parts.groupBy("anchor").agg(F.sum("c").alias("t")).where("t > 1").select("anchor")
    parts = tables.write(parts.join(often, "anchor"), f"parts{level}")
    tables.drop(f"split{level}")
    # parts of several pieces may be equal
    one = parts.groupBy("anchor", "hash").agg(F.least(F.sum("c"), F.lit(2)).cast("int").alias("c"), *(F.first(x).alias(x) for x in _NAMES if x not in ("anchor", "hash", "c")))
    deeper = _repeats(tables.write(one.select(*_NAMES), f"pieces{level}"), tables, level + 1)
    of = parts.select("a", "h", "o", "anchor", "hash").join(deeper, ["anchor", "hash"])
    return found.unionByName(of.select(F.col("a").alias("anchor"), F.col("h").alias("hash"), (F.col("o") + F.col("start")).alias("start"), (F.col("o") + F.col("end")).alias("end")))


def remove_repeated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per input row; with ``keep_text`` also the remaining bytes.

    A byte goes if a string of LEAST bytes around it starts anywhere else in
    the table too.  Null texts are empty; texts shorter than LEAST keep all;
    repeated rows repeat each other's strings.  Rows are told apart by their id and
    a 64-bit hash of the text, units by two such hashes.
    """
    tables = Tables(docs.sparkSession, "substrings")
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    picked = picked.select("id", "text", F.coalesce("id", F.lit(-1)).alias("i"), F.xxhash64("text").alias("u"))
    row = ["i", "u"]
    all_units = tables.write(picked.select(*row, "text").mapInArrow(_units, "i long, u long, a long, h long, s long, n int, q int, c int"), "units")
    often = all_units.where("c > 0").groupBy("a").agg(F.sum("c").alias("t")).where("t > 1").select("a")
    found = tables.write(all_units.where("c > 0").join(often, "a"), "found")
    distinct = found.groupBy("a", "h").agg(F.least(F.sum("c"), F.lit(2)).cast("int").alias("c"), F.min(F.struct(*row, "s", "n", "q")).alias("one"))
    wanted = distinct.select("one.i", "one.u", F.struct("a", "h", "one.s", "one.n", "one.q", "c").alias("unit")).groupBy(*row).agg(F.collect_list("unit").alias("wanted"))
    wanted = tables.write(wanted, "wanted")
    texts = picked.select(*row, "text")
    if wanted.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(wanted.select(*row)), row)
    cut = tables.write(texts.dropDuplicates(row).join(wanted, row).select("text", "wanted").mapInArrow(_cut, PIECE), "cut")
    tables.drop("wanted")
    hits = tables.write(_repeats(cut, tables), "hits").withColumnsRenamed({"anchor": "a", "hash": "h"})
    tables.drop("cut")
    # the units of all texts, those met once in their block and those met again
    members = found.where("c = 1").select(*row, "a", "h", "s").unionByName(all_units.where("c = 0").select(*row, "a", "h", "s"))
    runs = members.join(hits, ["a", "h"]).select(*row, (F.col("s") + F.col("start")).alias("s"), (F.col("s") + F.col("end")).alias("e"))
    runs = tables.write(runs.groupBy(*row).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "runs")
    tables.drop("units", "found", "hits")
    schema = SCHEMA + (", kept binary" if keep_text else "")
    return picked.join(runs, row, "left").select("id", "text", "spans").mapInArrow(_remove(keep_text), schema)
