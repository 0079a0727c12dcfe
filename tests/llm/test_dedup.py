"""Suffix arrays, substring removal and the n-gram join against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lemnia.llm import ngram_join, substring_dedup
from lemnia.llm.components import connected
from lemnia.llm.store import Tables
from lemnia.llm.suffix_array import permuted_lcp, suffix_array

from .fixtures import documents, empty, frame, words
from .test_scans import shingles


def test_suffix_array():
    r = np.random.default_rng(0)
    for k in range(300):
        n, s = int(r.integers(1, 120)), int(r.choice([1, 2, 3, 26, 256]))
        x = r.integers(0, s, n).astype(np.uint8)
        x = np.tile(x[: max(1, n // 4)], 4) if k % 3 == 0 else x
        b = x.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])  # noqa: B023
        sa = suffix_array(x)
        assert sa.tolist() == want
        lcp, _ = permuted_lcp(x, sa)
        for a, c in zip(want, want[1:], strict=False):
            n = 0
            while max(a, c) + n < len(b) and b[a + n] == b[c + n]:
                n += 1
            assert lcp[c] == n


def removed(docs, least=200):
    raw = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[k : k + least] for _, b in raw for k in range(len(b) - least + 1))
    out = []
    for i, b in raw:
        mark = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if count[b[k : k + least]] > 1:
                mark[k : k + least] = b"\1" * least
        spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark, monkeypatch):
    r = random.Random(5)
    base = words(r, 150)
    docs = [*documents(), *((900 + k, words(r, 5) + base[40 * k : 40 * k + 500] + words(r, 30)) for k in range(8)), (950, "x" * 1000), (951, "xy" * 150), (952, "y" * 199)]
    got = sorted((tuple(x) for x in substring_dedup.remove_repeated(frame(spark, docs)).collect()), key=repr)
    assert got == removed(docs) and sum(x[2] for x in got) > 3000
    monkeypatch.setattr(substring_dedup, "ANCHOR_UNITS", 1)  # all anchors are split
    assert sorted((tuple(x) for x in substring_dedup.remove_repeated(frame(spark, docs)).collect()), key=repr) == got
    assert substring_dedup.remove_repeated(empty(spark)).count() == 0


def test_substrings_by_suffixes():
    """Windows that different units share are found by the suffix array, whatever stands around them."""
    r = random.Random(6)
    for _ in range(20):
        shared = words(r, 60).encode()[: r.randint(200, 260)]
        texts = [words(r, r.randint(0, 8)).encode() + shared[r.randint(0, 3) :] + words(r, r.randint(0, 8)).encode() for _ in range(r.randint(1, 4))] + [words(r, 60).encode()[:230]]
        n = [len(x) - 199 for x in texts]
        got = substring_dedup._shard(pa.table({"anchor": [1] * len(texts), "hash": list(range(len(texts))), "n": n, "c": [1] * len(texts), "bytes": texts}))
        count = Counter(x[k : k + 200] for x, m in zip(texts, n, strict=True) for k in range(m))
        hit = {(i, k + j) for i, (x, m) in enumerate(zip(texts, n, strict=True)) for k in range(m) if count[x[k : k + 200]] > 1 for j in range(200)}
        assert {(s["hash"], k) for s in got.to_pylist() for k in range(s["start"], s["end"])} == hit


def test_split_anchors():
    """Equal windows of hot anchors keep equal anchors through all halvings, and a part's windows all hold its anchor."""
    r = random.Random(8)
    base = words(r, 200).encode()
    docs = [words(r, 3 + k).encode() + base[10 * k : 10 * k + 600] for k in range(12)]
    rows = []
    for k, d in enumerate(docs):
        buf = np.frombuffer(d, np.uint8)
        row, s, n, a, h, q = substring_dedup.units(buf, np.array([0, len(d)]))
        rows += [(int(x.view(np.int64)), int(y.view(np.int64)), 0, int(x.view(np.int64)), int(y.view(np.int64)), int(m), int(p), 0, 169, 1, d[i : i + m + 199]) for i, m, x, y, p in zip(s, n, a, h, q)]
    level = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], substring_dedup._NAMES)
    while True:
        where = {}
        for x in level.to_pylist():
            for k in range(x["n"]):
                where.setdefault(x["bytes"][k : k + 200], set()).add(x["anchor"])
        assert all(len(v) == 1 for v in where.values())
        if set(level.column("n").to_pylist()) == {1}:
            break
        count = sum(level.column("n").to_pylist())
        level = pa.concat_batches(list(substring_dedup._split([level])))
        assert sum(level.column("n").to_pylist()) == count


def linked(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(x for x in (least.get(root(k)), i, 10**18) if x is not None)
    return sorted(((i, len(s), least[root(k)] if least[root(k)] < 10**18 else None) for k, (i, s) in enumerate(sets)), key=repr)


def near(seed):
    """Documents with a large group of near copies, chains of drifting copies, and a passage that is most of many texts."""
    r = random.Random(seed)
    docs = documents(seed)
    base = words(r, 120).split()
    for k in range(80):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = words(r, 1) + str(r.random())
        docs.append((1000 + k, " ".join(w)))
    w = words(r, 100).split()
    for k in range(25):
        w[(7 * k) % 100] = f"drift{k}"
        w[(7 * k + 50) % 100] = f"more{k}"
        docs.append((2000 - k, " ".join(w)))
    hot = words(r, 40)
    docs += [(3000 + k, f"{hot} {words(r, r.randint(1, 14))}") for k in range(60)]
    return docs


def test_ngram_join(spark, monkeypatch):
    docs = near(3)
    want = linked(docs)
    rows = lambda: sorted((tuple(x) for x in ngram_join.join_near_duplicates(frame(spark, docs)).collect()), key=repr)
    assert rows() == want
    assert max(Counter(c for _, n, c in want if n).values()) > 40
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 16)
    assert rows() == want, "dense clusters in small blocks"


def test_ngram_followers(spark, monkeypatch):
    """Texts with one shared part and more of their own than lets them be linked to each other, and smaller ones that only some can be linked to."""
    r = random.Random(11)
    docs, i = [], 0
    for base in (words(r, 40).split(), words(r, 64).split()):
        own = lambda k: [f"own{r.random()}" for _ in range(k)]
        for k in (7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 13, 1, 2):
            docs.append((i := i + 1, " ".join(base + own(k))))
        for cut in range(1, 8):
            docs.append((i := i + 1, " ".join(base[: len(base) - cut])))
            docs.append((i := i + 1, " ".join(base[cut:] + own(2))))
    r.shuffle(docs)
    want = linked(docs)
    rows = lambda: sorted((tuple(x) for x in ngram_join.join_near_duplicates(frame(spark, docs)).collect()), key=repr)
    assert rows() == want
    assert len({c for _, _, c in want}) == 4, "some of the larger ones are linked to a smaller text, some to nothing"
    monkeypatch.setattr(ngram_join, "LONG_LIST", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    assert rows() == want


def test_ngram_edges(spark):
    assert ngram_join.join_near_duplicates(empty(spark)).count() == 0
    rows = ngram_join.join_near_duplicates(frame(spark, [(1, None), (2, ""), (3, " "), (None, None)])).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)]


def test_ngram_shared_ids(spark):
    docs = near(6)
    for docs in ([(None if k % 3 == 0 else i, t) for k, (i, t) in enumerate(docs)], [(1 + k % 40, t) for k, (_, t) in enumerate(docs)]):
        got = sorted((tuple(x) for x in ngram_join.join_near_duplicates(frame(spark, docs)).collect()), key=repr)
        assert got == linked(docs)


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {x["cid"]: x["comp"] for x in connected(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "test"), "t").collect()}
    assert got == {x: root(x) for x in parent}
