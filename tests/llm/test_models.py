"""The trained operators: held-out accuracy, probabilities that sum to 1, and exact base columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lemnia.llm import context_mixing, lm_scoring, toxicity
from lemnia.llm.context_mixing import CLIP, FINE, FIRST, MIXERS, ORDERS, PRIOR, STEPS, WINDOW, Model, follow, stored, tables_of, text_grams
from lemnia.llm.lm_scoring import score_documents
from lemnia.llm.quality_cnn import CHUNK, FILTERS, OVERLAP, WIDTH, Network, score_quality
from lemnia.llm.textcore import Words, buffers
from lemnia.llm.toxicity import Lexicon, build_trie, match_words, score_toxicity

from .fixtures import documents, empty, frame, words
from .test_scans import WORD


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_automata():
    r = random.Random(2)
    terms = [(b"worthless", False), (b"idiot", False), (b"moronic", False), (b"lowei", True)]
    pool = ["worthless", "worthles", "wortthless", "worthlesss", "wortless", "worthlezz", "idiot", "idiotic", "idiod", "moronic", "moronik", "loweichen", "lowe", "xworthless", "orthless"]
    pool += ["".join(r.choice("wortheslmnic") for _ in range(r.randint(3, 11))) for _ in range(300)]
    raw = [w.encode() for w in pool]
    width = 11
    matrix = np.array([list((w + b"\0" * width)[:width]) for w in raw], np.uint8)
    got, edits = match_words(matrix, np.array(list(map(len, raw))), build_trie(terms), np.array([len(t) for t, _ in terms]))
    for w, k, e in zip(raw, got, edits, strict=True):
        want = [(distance(w, t), n) for n, (t, stem) in enumerate(terms) if not stem and w[0] == t[0] and distance(w, t) <= (1 if len(t) >= 6 else 0)]
        want += [(0, n) for n, (t, stem) in enumerate(terms) if stem and w.startswith(t)]
        assert (k < 0) == (not want) and (k < 0 or (e, k) == min(want)), (w, k, e, want)


def test_quotation():
    lex = Lexicon([(b"idiot", False)], np.zeros(0))
    f = lambda t: lex.features(*buffers(pa.array([t])))[0]
    assert list(f("you are an idiot today")[1:4]) == [1, 0, 0]
    assert list(f('the word "idiot" has five letters')[1:4]) == [0, 0, 1]
    assert list(f("")[1:4]) == [0, 0, 0]


def test_apostrophes():
    lex = Lexicon([(b"idiot", False)], np.zeros(0))
    f = lambda t: list(lex.features(*buffers(pa.array([t])))[0][1:4])
    plain = ["you can't be serious, idiot, it's over", "l'homme, idiot, c'est fini", '"hello", you idiot, "bye"', '"ok." you idiot "no"', "the dogs' idiot 'friend", 'a 6" idiot screen', "idiot 'x'", "'x' idiot"]
    for t in plain:
        assert f(t) == [1, 0, 0], t
    for t in ["he's an 'idiot', isn't he", "'an idiot'", '"what an idiot!" they wept', 'a " idiot " there', "« idiot »", "\u201c an idiot \u201d"]:
        assert f(t) == [0, 0, 1], t


def labelled(spark, n=600, bad=lambda r, t: t, column="toxic", share=0.3):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        y = int(r.random() < share)
        t = words(r, r.randint(30, 120))
        rows.append((k, bad(r, t) if y else t))
        labels.append((k, 1, y) if column == "toxic" else (k, 1 - y, 0))
    labels += [(None, 1, 1), (1, None, None)]
    return frame(spark, rows + [(9001, None), (9002, ""), (None, "x")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: y for k, y in ((a, c if column == "toxic" else b) for a, b, c in labels[:n])}


def insult(r, t):
    w = t.split()
    for _ in range(2):
        w.insert(r.randrange(len(w)), r.choice(["moron", "worthless", "zorgle", "zorgling", "disgustng"]))
    return " ".join(w)


@pytest.mark.parametrize("mod,held", [(3, 1)])
def test_toxicity(spark, mod, held):
    docs, labels, y = labelled(spark, bad=insult)
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == 603
    out = [r for r in rows if r["held_out"] and r["doc_id"] in y]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == held) for r in rows if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert score_toxicity(empty(spark), labels).count() == 0
    assert score_toxicity(docs, labels.limit(0)).count() == 603
    assert toxicity.learn_terms([], []) == sorted((s.encode(), False) for s in toxicity.SEEDS)


def test_quality_network(spark):
    docs, labels, y = labelled(spark, bad=lambda r, t: " ".join(f"{x.upper()}!!" for x in t.split()), column="quality")
    rows = score_quality(docs, labels).collect()
    out = [r for r in rows if r["held_out"] and r["doc_id"] in y]
    assert np.mean([(r["score"] >= 0.5) == bool(y[r["doc_id"]]) for r in out]) > 0.95 and len(rows) == 603
    assert score_quality(empty(spark), labels).count() == 0


def plain_probability(net, text):
    """The network in plain loops over chunks, positions and filters."""
    data = text.encode()
    starts, step = [0], CHUNK - OVERLAP
    while starts[-1] + step < max(1, len(data) - OVERLAP):
        starts.append(starts[-1] + step)
    pooled = []
    for a in starts:
        best = [0.0] * FILTERS
        for i in range(a, min(a + CHUNK, len(data))):
            for f in range(FILTERS):
                y = float(net.bias[f]) + sum(float(net.table[k][data[i + k] if i + k < len(data) else 0][f]) for k in range(WIDTH))
                best[f] = max(best[f], y)
        pooled.append(best)
    lanes = list(zip(*pooled, strict=True))
    z = [sum(x) / len(x) for x in lanes] + [min(x) for x in lanes] + [max(x) for x in lanes]
    return 1 / (1 + math.exp(-(sum(a * float(b) for a, b in zip(z, net.out, strict=True)) + float(net.out_bias[0]))))


def test_network_forward():
    net = Network()
    net.out[:] = np.random.default_rng(1).normal(0, 1, len(net.out))
    texts = ["", "a", "abc def", words(random.Random(1), 100), words(random.Random(2), 300), "é中" * 200]
    got, _ = net.predict(*buffers(pa.array(texts, pa.large_string())))
    assert got == pytest.approx([plain_probability(net, t) for t in texts], abs=1e-5)


def test_network_gradients():
    """Against differences of the loss."""
    net = Network()
    r = np.random.default_rng(5)
    net.out[:] = r.normal(0, 0.5, len(net.out))
    for name in ("table", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    buf, off = buffers(pa.array([words(random.Random(k), 20 + 60 * k) for k in range(4)] + [""], pa.large_string()))
    y, weigh = np.array([1.0, 0, 1, 0, 1]), np.array([0.3, 0.2, 0.1, 0.5, 0.4])

    def loss():
        p, _ = net.predict(buf, off)
        return -(weigh * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5e-5 * (net.table**2).sum() + 0.5e-4 * (net.out**2).sum()

    for param, grad in zip((net.table, net.bias, net.out, net.out_bias), net.gradients(buf, off, y, weigh), strict=True):
        flat, g = param.reshape(-1), np.asarray(grad).reshape(-1)
        for i in [*np.argsort(-np.abs(g))[:6], *r.integers(0, len(flat), 3)]:
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            assert g[i] == pytest.approx((up - loss()) / 2e-6, abs=1e-5)
            flat[i] = old


def test_long_and_repeated_rows(spark):
    """Ids that repeat in documents and labels, null texts among the labelled, and a very long text."""
    docs, labels, y = labelled(spark, n=300, bad=insult)
    long_ = words(random.Random(3), 20000)
    docs = docs.union(frame(spark, [(5, None), (5, long_), (9100, long_ + " you worthless moron " + long_), (9100, long_)]))
    labels = labels.union(spark.createDataFrame([(5, 0, 1), (5, 1, 0), (9002, 1, 0)], "doc_id long, quality int, toxic int"))
    for score in (score_toxicity, score_quality):
        rows = score(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    toxic = sorted((r["n_terms"] for r in score_toxicity(docs, labels).collect() if r["doc_id"] == 9100))
    assert toxic[0] == 0 and toxic[1] >= 2


def plain_hits(lexicon, text):
    """(exact, misspelled, quoted) by edit distances of all words and all terms."""
    import re

    out = [0, 0, 0]
    data = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    found = [(m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low)]
    for i, (s, e) in enumerate(found):
        w = low[s:e]
        best = min((d for d in ((0 if w.startswith(t) else 9) if stem else (lambda k: k if k <= (1 if len(t) >= 6 and w[:1] == t[:1] else 0) else 9)(distance(w, t)) for t, stem in lexicon.terms if stem or abs(len(t) - len(w)) <= 1) if d < 9), default=None)
        if best is None:
            continue
        lo, hi = max(0, i - toxicity.CONTEXT), min(len(found), i + toxicity.CONTEXT + 1)
        left, right = low[max(0, found[lo][0] - 3) : s], low[e : min(len(low), found[hi - 1][1] + 4)]
        said = any(low[found[j][0] : found[j][1]] in toxicity.REPORTING and not set(b".\n!") & set(low[found[j][1] : s]) for j in range(max(lo, i - 3), i))
        out[2 if said or toxicity.enclosed(left.decode(errors="ignore"), right.decode(errors="ignore")) else 1 if best else 0] += 1
    return out


def test_hits_against_distances():
    r = random.Random(12)
    lexicon = Lexicon([(b"worthless", False), (b"idiot", False), (b"moronic", False), (b"zorg", True)], np.zeros(0))
    pool = ["worthless", "worthles", "Wortthless", "idiot", "IDIOT", "idiotic", "moronik", "zorging", "zorg", '"', "said", ".", "'", "the", "fine", "é", "word"]
    texts = [" ".join(r.choice(pool) if r.random() < 0.4 else words(r, 1) for _ in range(r.randint(0, 80))) for _ in range(60)]
    buf, off = buffers(pa.array(texts, pa.large_string()))
    got = lexicon.hits(Words(buf, off, lower=True, alnum=True), off)
    assert got.astype(int).tolist() == [plain_hits(lexicon, t) for t in texts] and got.sum(axis=0).min() > 5


def test_chunks_cover():
    net = Network()
    for n in (0, 1, 63, 64, 383, 384, 385, 1000, 5000):
        row, a, b = net.chunks(np.array([0, n]))  # a lone text lies where it was
        assert a[0] == 0 and b[-1] == n and (a[1:] < b[:-1]).all() and len(row) >= 1
    long_ = np.frombuffer(b"plain text " * 400, np.uint8)
    whole, _ = net.predict(long_, np.array([0, len(long_)]))
    both, _ = net.predict(np.concatenate([long_, long_]), np.array([0, len(long_), 2 * len(long_)]))
    assert both == pytest.approx([whole[0]] * 2)


def plain_slot(context, prefix, bits):
    """The table's slot of a context and the bits so far."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    base = mixed(int.from_bytes(context, "big") * 0x9E3779B97F4A7C15 + len(context) & mask)
    return mixed(base + prefix * 0xC2B2AE3D27D4EB4F & mask) >> 64 - bits


def plain_log_prob(count, bits, weights, refine, context, byte):
    """The same model in plain steps, bit by bit: (log probability of each mixer)."""
    out = []
    for e, orders in enumerate(MIXERS):
        total = 0.0
        for number in range(8):
            prefix, bit = (byte | 256) >> (8 - number), byte >> (7 - number) & 1
            x, known = [], 0
            for k in range(1, ORDERS + 1):
                s = plain_slot(context[:k], prefix, bits[k - 1])
                zeros, ones = count.get((k, s, 0), 0), count.get((k, s, 1), 0)
                known += zeros + ones > 0
                x.append(max(-CLIP, min(CLIP, math.log((ones + PRIOR) / (zeros + PRIOR)))))
            w = weights[e, number * (ORDERS + 1) + known]
            z = sum(a * b for a, b in zip(x[:orders], w[:orders], strict=True)) + w[ORDERS]
            z = max(-CLIP - 3, min(CLIP + 3, z))
            at = (max(-CLIP, min(CLIP, z)) + CLIP) / (2 * CLIP) * (STEPS - 1)
            i = min(int(at), STEPS - 2)
            r = refine[e, number]
            z = (z + r[i] * (1 - at + i) + r[i + 1] * (at - i)) / 2
            total -= math.log1p(math.exp(-z if bit else z))
        out.append(total)
    return out


def test_mixing():
    """Probabilities sum to 1, equal those of exact contexts, and follow the text."""
    text = (words(random.Random(8), 400) + " ").encode() * 2
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    all_grams, at = text_grams(buf, off)
    g, c = np.unique(all_grams, return_counts=True)
    m = Model(tables_of(g, c.astype(float), range(1, ORDERS + 1)))
    before = m.weights.copy()
    m.learn(g, c.astype(float))
    assert not np.allclose(before, m.weights)
    m.refine = Model.correction(m.observe(g, c.astype(float)))
    ctx = g[::97] & ~np.uint64(255)
    every = (ctx[:, None] | np.arange(256, dtype=np.uint64)).ravel()
    for p in np.exp(m.log_prob(every)).reshape(len(MIXERS), -1, 256):
        assert p.sum(axis=1) == pytest.approx(1)
    count, bits = Counter(), [int(x.shape[1]).bit_length() - 1 for x in m.tables]
    for x in all_grams.tolist():
        context, byte = x.to_bytes(8, "big")[2:7], x & 255
        for k in range(1, ORDERS + 1):
            for number in range(8):
                count[k, plain_slot(context[:k], (byte | 256) >> (8 - number), bits[k - 1]), byte >> (7 - number) & 1] += 1
    plain = np.array([plain_log_prob(count, bits, m.weights, m.refine, x.to_bytes(8, "big")[2:7], x & 255) for x in all_grams[:1500].tolist()]).T
    assert m.log_prob(all_grams[:1500]) == pytest.approx(plain, abs=1e-4)
    steps = stored(m.log_prob(all_grams)).astype(int)
    got = follow(steps, at)
    want = []
    for i in range(len(all_grams)):
        w = [-(FIRST if e else 0.0) - steps[e, max(0, i - WINDOW) : i].sum() / FINE for e in range(len(MIXERS))]
        top = max(w)
        share = [math.exp(x - top) for x in w]
        want.append(math.log(sum(s / sum(share) * math.exp(-steps[e, i] / FINE) for e, s in enumerate(share))))
    assert got == pytest.approx(want)
    assert -got.sum() / math.log(2) / len(buf) < 3


@pytest.mark.parametrize("values", [1, 90, 140, 256])
def test_lm_distinct_grams(values):
    """As numpy's own; places fit beside the grams of few byte values only."""
    r = np.random.default_rng(values)
    for off in ([0, 0], [0, 1], [0, 9000, 9000, 9007, 20000]):
        g, ends = text_grams(r.integers(0, values, off[-1]).astype(np.uint8), np.array(off))
        keys, order, which = lm_scoring._distinct_grams(g)
        there = np.empty(len(keys), np.uint64)
        there[order] = keys
        assert (keys == np.unique(g)).all() and (there[which] == g).all()


def test_lm_followed_in_parts(monkeypatch):
    steps = np.random.default_rng(5).integers(0, 2000, (2, 3000)).astype("<u2")
    whole = follow(steps, np.array([0, 1, 900, 3000]))
    monkeypatch.setattr(context_mixing, "PART", 64)
    assert (follow(steps, np.array([0, 1, 900, 3000])) == whole).all()


def test_nul_is_no_end():
    raw = [b"a\0b", b"a", b"b"]
    g, at = text_grams(np.frombuffer(b"".join(raw), np.uint8), np.array([0, 3, 4, 5]))
    assert (g & np.uint64(255)).tolist() == [97, 255, 98, 0, 97, 0, 98, 0] and at.tolist() == [0, 4, 6, 8]


def test_language_model(spark):
    docs = documents()
    rows = score_documents(frame(spark, docs)).collect()
    low = {c: c + 32 for c in range(65, 91)}
    tokens = [(i, [*WORD.findall((t or "").translate(low)), None]) for i, t in docs]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(x for i, w in tokens if not fold(i) for x in w)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, fold(i), len(w), sum(count[x] > 0 for x in w), n) for i, w in tokens), key=repr)
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == want
    base = {i: sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) for i, w in tokens if i is not None}
    assert all(r["base_score"] == pytest.approx(base[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    assert all(r["score"] <= 0 for r in rows) and len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert score_documents(empty(spark)).count() == 0


def test_groups_of_questions(spark, monkeypatch):
    """Buckets whose questions are summed and answered in groups give the same scores."""
    docs = [(i, t) for i, t in documents() if i is not None and i != 5]
    score = lambda: {r["doc_id"]: tuple(r)[:7] for r in score_documents(frame(spark, docs)).collect()}
    want = score()
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 1 << 12)
    monkeypatch.setattr(lm_scoring, "GROUP_CHUNKS", 2)
    got = score()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_equal_blocks(spark):
    text = words(random.Random(9), 300)
    rows = score_documents(frame(spark, [(1, text)]).union(frame(spark, [(2, text)])).union(frame(spark, [(3, "other words here")]))).collect()
    count = Counter([*WORD.findall(text), None] * 2 + ["other", "words", "here", None])
    n, v = sum(count.values()), len(count)
    want = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*WORD.findall(text), None])
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 3 and not any(r["held_out"] for r in rows)
    assert [got[k]["base_score"] for k in (1, 2)] == pytest.approx([want, want])
    assert [got[k]["n_known"] for k in (1, 2)] == [got[1]["n_tokens"]] * 2
