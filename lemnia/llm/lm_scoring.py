"""Language-model scores: a word-unigram base, and bits by context mixing.

The corpus is cut into chunks, one block of texts each.  A chunk asks for what
it needs, its distinct words and byte grams with its own counts of them, by
bucket.  Each bucket sums the counts of all chunks, and answers each chunk
for the keys it asked for: a word's total, a gram's log probabilities.  So each
distinct gram of the corpus is scored once, where all contexts of its higher
orders meet, and what is counted grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .context_mixing import GATES, MIXERS, ORDERS, SHARED, STEPS, Model, counted, follow, stored, tables_of, text_grams
from .store import Tables
from .textcore import Words, blocks, mix

#: The hash of the end token; no word has it but by chance.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Bytes of text per bucket, about, and the bounds of their number: a bucket has whole contexts of order 3, so more would not split them.
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS = 4 << 20, 16, 4096
#: Bytes of text of a chunk, about: the larger, the fewer distinct grams a byte are asked for.
CHUNK_BYTES = 2 << 20
#: Bytes of text of an Arrow batch, about.
BATCH_BYTES = 8 << 20
#: Chunks whose questions to a bucket one task answers.
GROUP_CHUNKS = 16384
#: The greatest count that is stored.
MOST = (1 << 32) - 1
WORD, GRAM = 1, 2

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
_TYPES = {k: {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t] for k, t in map(str.split, SCHEMA.split(", "))}
_PASS = "kind int, bucket int, chunk long, ids array<long>, held array<boolean>, body binary, keys binary, counts binary"


def _zip(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _packed(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed byte planes of their differences."""
    d = np.diff(x, prepend=np.uint64(0))
    return _zip(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def _small(x: np.ndarray) -> bytes:
    return _zip(x.astype("<u4").tobytes())


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(_unzip(b), "<u4")


def _zip_answer(x: np.ndarray) -> bytes:
    """(planes, n) whole numbers as compressed byte planes."""
    return _zip(np.ascontiguousarray(x.view(np.uint8).reshape(*x.shape, x.dtype.itemsize).transpose(0, 2, 1)).tobytes())


def _unzip_answer(b: bytes, dtype: str, planes: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(_unzip(b), np.uint8).reshape(planes, size, -1).transpose(0, 2, 1)).view(dtype)[..., 0]


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lowered words, each text's end after them; offsets of the texts)."""
    w = Words(buf, off, lower=True)
    n = len(off) - 1
    out = np.full(len(w.hash) + n, END, np.uint64)
    out[np.arange(len(w.hash)) + w.row()] = w.hash
    return out, w.first + np.arange(n + 1)


def _bucket_of_words(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(32)).astype(np.int64) * buckets) >> 32


def _bucket_of_grams(g: np.ndarray, buckets: int) -> np.ndarray:
    """Grams with the same nearest SHARED + 1 bytes of context meet, and so all contexts of higher orders."""
    return ((mix(g >> np.uint64(8 * (ORDERS - SHARED))) >> np.uint64(32)).astype(np.int64) * buckets) >> 32


def _questions(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, kind: int, chunk: int) -> list[tuple]:
    """A row per bucket that ascending keys fall in."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    return [(kind, int(bucket[order[a]]), chunk, None, None, None, _packed(keys[order[a:b]]), _small(counts[order[a:b]])) for a, b in zip(edge, edge[1:], strict=False)]


def _gather(buckets: int):
    def run(batches):
        # a block's name is its task's partition and its number there, as equal blocks are different chunks
        partition = TaskContext.get().partitionId()
        for number, (c, buf, off) in enumerate(x for batch in batches for x in blocks(batch, size=CHUNK_BYTES)):
            held = c.column("held").fill_null(False).to_numpy(zero_copy_only=False)
            chunk = partition << 32 | number
            rows = [(0, None, chunk, c.column("id").to_pylist(), c.column("held").to_pylist(), _zip(buf.tobytes()), _small(np.diff(off)), None)]
            for kind, (keys, at), bucket_of in ((WORD, _tokens(buf, off), _bucket_of_words), (GRAM, text_grams(buf, off), _bucket_of_grams)):
                keys, seen = _counted(keys, np.repeat(~held, np.diff(at)))
                rows += _questions(keys, seen, bucket_of(keys, buckets), kind, chunk)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            names = ["kind", "bucket", "chunk", "ids", "held", "body", "keys", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how often each is where train is true)."""
    out, n = np.unique(keys, return_counts=True)
    if not train.all():
        other, m = np.unique(keys[~train], return_counts=True)
        n[np.searchsorted(out, other)] -= m
    return out, n


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ascending; the number each has in the order of first sight; for each key, that number)."""
    coded = pa.array(keys).dictionary_encode()
    seen = coded.dictionary.to_numpy()
    order = np.argsort(seen)
    return seen[order], order, coded.indices.to_numpy()


def _distinct_grams(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_distinct() of packed grams: where few byte values occur, a gram and its place are one number, and numbers sort faster than they are looked up."""
    there = np.bincount(np.ascontiguousarray(g).view(np.uint8)[::8], minlength=256) > 0
    there[0] = True
    values, bits = int(there.sum()), max(1, len(g) - 1).bit_length()
    if values ** (ORDERS + 1) << bits > 1 << 64:
        return _distinct(g)
    rank = np.where(there, np.cumsum(there) - 1, 0).astype(np.uint64)
    pair = (rank[:, None] * np.uint64(values) + rank).ravel()
    halves = g.view("<u2").reshape(-1, 4)
    x = np.zeros(len(g), np.uint64)
    for k in range(ORDERS // 2, -1, -1):
        x *= np.uint64(values * values)
        x += pair[halves[:, k]]
    x <<= np.uint64(bits)
    x |= np.arange(len(g), dtype=np.uint64)
    x.sort()
    at = (x & np.uint64((1 << bits) - 1)).astype(np.int64)
    x >>= np.uint64(bits)
    new = np.ones(len(g), bool)
    new[1:] = x[1:] != x[:-1]
    which = np.empty(len(g), np.int32)
    which[at] = np.cumsum(new, dtype=np.int32) - 1
    keys = g[at[new]]
    return keys, np.arange(len(keys)), which


def _merged(table: pa.Table) -> pa.Table:
    """One row of a bucket's keys and their sums."""
    keys, inverse = np.unique(np.concatenate([_unpacked(x) for x in table.column("keys").to_pylist()]), return_inverse=True)
    sums = np.bincount(inverse, weights=np.concatenate([_ints(x) for x in table.column("counts").to_pylist()]), minlength=len(keys)).astype(np.int64)
    return pa.table({"bucket": table.column("bucket")[:1], "keys": pa.array([_packed(keys)], pa.binary()), "counts": pa.array([_small(np.minimum(sums, MOST))], pa.binary()), "known": [int((sums > 0).sum())], "total": [int(sums.sum())]})


_MERGED = "bucket int, keys binary, counts binary, known long, total long"


def _totals(asked: DataFrame, groups: int) -> DataFrame:
    """A row per bucket; where a bucket has very many questions, they are summed by groups of chunks first."""
    if groups > 1:
        asked = asked.groupBy("bucket", "part").applyInArrow(_merged, _MERGED)
    return asked.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(_merged, _MERGED)


def _answers(asked: DataFrame, values: DataFrame, groups: int, dtype: str, planes: int) -> DataFrame:
    """(chunk, kind, bucket, values) for each question; values: (bucket, keys, values) of all buckets."""

    def answer(questions: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if questions.num_rows:
            keys = _unpacked(known.column("keys")[0].as_py())
            x = np.frombuffer(_unzip(known.column("values")[0].as_py()), dtype).reshape(planes, -1)
            out = [_zip_answer(np.ascontiguousarray(x[:, np.searchsorted(keys, _unpacked(q))])) for q in questions.column("keys").to_pylist()]
        return pa.table({"chunk": questions.column("chunk"), "kind": questions.column("kind"), "bucket": questions.column("bucket"), "values": pa.array(out, pa.binary())})

    by = ["bucket", "part"]
    each = values.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*by, "keys", "values")
    left = asked.select(*by, "chunk", "kind", "keys").groupBy(*by)
    return left.cogroup(each.groupBy(*by)).applyInArrow(answer, "chunk long, kind int, bucket int, values binary")


def _word_values(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            totals = _ints(batch.column("counts")[k].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("bucket")[k : k + 1], batch.column("keys")[k : k + 1], pa.array([_zip(totals.tobytes())], pa.binary())], ["bucket", "keys", "values"])


def _low_counts(batches):
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            g, c = counted(_unpacked(keys), _ints(counts), SHARED)
            yield pa.RecordBatch.from_arrays([pa.array(g[c > 0].astype(np.int32)), pa.array(c[c > 0].astype(np.int64))], ["g", "c"])


def _bucket_model(shared, keys: bytes, counts: bytes, weights=None, refine=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Model]:
    """(all grams asked for, those learned from, their counts, the model of the bucket)."""
    g, c = _unpacked(keys), _ints(counts).astype(float)
    seen = c > 0
    tables = [*shared.value, *tables_of(g[seen], c[seen], range(SHARED + 1, ORDERS + 1))]
    return g, g[seen], c[seen], Model(tables, weights, refine)


def _over_grams(work):
    """Runs work(keys, counts) -> (weight, numbers) over each bucket, a fixed-size row each."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n, x = work(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([x], pa.list_(pa.float64()))], ["n", "x"])

    return run


def fit(grams: DataFrame):
    """(shared low-order tables as a broadcast, weights, correction) from the buckets' gram counts.

    The driver gets counts of at most 2**24 grams of order SHARED, and sums of a fixed length.
    """
    low = grams.mapInArrow(_low_counts, "g int, c long").groupBy("g").agg(F.sum("c").alias("c")).toPandas()
    g, c = low["g"].to_numpy().astype(np.uint64), low["c"].to_numpy().astype(float)
    g = (g >> np.uint64(8) << np.uint64(8 * (ORDERS + 1 - SHARED))) | (g & np.uint64(255))
    shared = grams.sparkSession.sparkContext.broadcast(tables_of(g, c, range(1, SHARED + 1)))
    # sums of a fixed length, one a bucket, met pairwise before the driver
    total = lambda df, n: df.select("n", F.posexplode("x").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("v").alias("sum")).orderBy("i").limit(n).collect()

    def learn(keys, counts):
        _, g, c, m = _bucket_model(shared, keys, counts)
        m.learn(g, c)
        return c.sum(), m.weights.ravel().astype(float)

    shape = (len(MIXERS), GATES, ORDERS + 1)
    got = total(grams.where("total > 0").mapInArrow(_over_grams(learn), "n double, x array<double>"), int(np.prod(shape)))
    weights = np.array([r["mean"] for r in got]).reshape(shape) if got else None

    def observe(keys, counts):
        _, g, c, m = _bucket_model(shared, keys, counts, weights)
        return 1, m.observe(g, c).ravel()

    shape = (len(MIXERS), 8, STEPS, 2)
    got = total(grams.where("total > 0").mapInArrow(_over_grams(observe), "n double, x array<double>"), int(np.prod(shape)))
    refine = Model.correction(np.array([r["sum"] for r in got]).reshape(shape)) if got else None
    return shared, weights, refine


def _gram_values(shared, weights, refine):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                g, _, _, m = _bucket_model(shared, batch.column("keys")[k].as_py(), batch.column("counts")[k].as_py(), weights, refine)
                x = np.concatenate([stored(m.log_prob(g[i : i + 65536])) for i in range(0, len(g), 65536)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("bucket")[k : k + 1], batch.column("keys")[k : k + 1], pa.array([_zip(x.tobytes())], pa.binary())], ["bucket", "keys", "values"])

    return run


def _told(keys: np.ndarray, order: np.ndarray, bucket: np.ndarray, told: pa.Table, kind: int, dtype: str, planes: int) -> np.ndarray:
    """(planes, keys) answers; that to the k-th of the ascending keys is at order[k]."""
    mine = sorted((b, k) for k, (x, b) in enumerate(zip(told.column("kind").to_pylist(), told.column("bucket").to_pylist(), strict=True)) if x == kind)
    parts = [_unzip_answer(told.column("values")[k].as_py(), dtype, planes) for _, k in mine]
    out = np.empty((planes, len(keys)), dtype)
    out[:, order[np.argsort(bucket, kind="stable")]] = np.concatenate(parts, axis=1)
    return out


def _score(buckets: int, n_train: int, n_known: int):
    scale = n_train + 0.1 * (n_known + 1)

    def run(text: pa.Table, told: pa.Table) -> pa.Table:
        if not text.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _TYPES.items()})
        row = text.to_pylist()[0]
        buf = np.frombuffer(_unzip(row["body"]), np.uint8)
        off = np.concatenate([[0], np.cumsum(_ints(row["keys"]).astype(np.int64))])
        tok, at = _tokens(buf, off)
        words, order, which = _distinct(tok)
        c = _told(words, order, _bucket_of_words(words, buckets), told, WORD, "<u4", 1)[0].astype(np.int64)[which]
        base = np.add.reduceat(np.log10((c + 0.1) / scale), at[:-1])
        known = np.add.reduceat((c > 0).astype(np.int64), at[:-1])
        g, ends = text_grams(buf, off)
        g, order, which = _distinct_grams(g)
        steps = _told(g, order, _bucket_of_grams(g, buckets), told, GRAM, "<u2", len(MIXERS))
        score = np.add.reduceat(follow(np.take(steps, which, axis=1), ends), ends[:-1]) / np.log(10)
        cols = [row["ids"], row["held"], np.diff(at), known, np.full(len(off) - 1, n_train), base, score, -score * np.log2(10) / np.diff(ends)]
        return pa.table({k: pa.array(x, t) for (k, t), x in zip(_TYPES.items(), cols, strict=True)})

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per input row.

    Null and empty texts are their end alone.  Repeated rows count each and get
    equal scores.  A null id belongs to no fold: its row has held_out null and is learned
    from.  The score is the log10 probability of the bytes and the end.  A text's
    own rows are among what is learned from, where it isn't held out; a
    word's stored count ends at 2**32 - 1.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "lm")
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    n_bytes, n_rows = picked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, n_bytes // BUCKET_BYTES))
    groups = 1 + n_bytes // CHUNK_BYTES // GROUP_CHUNKS
    picked = picked.withColumn("held", F.crc32(F.col("id").cast("string")) % 10 == 0)
    gathered = tables.write(picked.mapInArrow(_gather(buckets), _PASS), "gathered", "kind", batch=max(100, min(10_000, n_rows * BATCH_BYTES // max(1, n_bytes))))
    asked = gathered.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
    words = tables.write(_totals(asked.where(F.col("kind") == WORD), groups), "words")
    sums = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    word_values = words.mapInArrow(_word_values, "bucket int, keys binary, values binary")
    grams = tables.write(_totals(asked.where(F.col("kind") == GRAM), groups), "grams")
    gram_values = tables.write(grams.mapInArrow(_gram_values(*fit(grams)), "bucket int, keys binary, values binary"), "values")
    told = tables.write(_answers(asked.where(F.col("kind") == WORD), word_values, groups, "<u4", 1), "told_words")
    tables.drop(f"gathered/kind={WORD}", "words")
    told = told.unionByName(tables.write(_answers(asked.where(F.col("kind") == GRAM), gram_values, groups, "<u2", len(MIXERS)), "told_grams"))
    tables.drop(f"gathered/kind={GRAM}", "grams", "values")
    texts = gathered.where("kind = 0").select("chunk", "ids", "held", "body", "keys")
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(buckets, int(sums["n"]), int(sums["v"])), SCHEMA)
