"""Toxicity: Levenshtein automata against a lexicon trie, weighed by context.

The lexicon holds seed terms and terms learned from labelled rows: whole
words, and stems followed by any ending.  A trie of the lexicon is walked once
per block of texts; at each node the automaton states of all distinct words of
the block are advanced together, and words whose states have died are left out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_sample
from .textcore import Words, blocks, buffers

#: Seed terms, and words that mark what follows as quoted or reported.
SEEDS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "imbecile", "bastard", "asshole", "scumbag", "retard"]
REPORTING = [b"said", b"says", b"quoted", b"quote", b"wrote", b"called", b"word", b"term", b"definition", b"dit", b"dijo", b"sagte", b"cited", b"mot", b"palabra", b"wort"]
#: Marks that open a quotation, each with the one that closes it.
QUOTES = [('"', '"'), ("'", "'"), ("\u201c", "\u201d"), ("\u201e", "\u201c"), ("\u201e", "\u201d"), ("\u00ab", "\u00bb"), ("\u00bb", "\u00ab")]
MAX_EDITS, FUZZY_LEAST, STEM_LEAST, CONTEXT = 1, 6, 4, 6
#: The bound of the labelled sample.
TRAIN_ROWS = 6000
#: Of the rows that hold a term, the share that must be toxic; and the least such rows.
PURITY, LEAST_ROWS = 0.9, 4
N_FEATURES = 7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_terms long, n_misspelled long, n_quoted long"


def build_trie(terms: list[tuple[bytes, bool]]) -> dict:
    """Nested dicts by byte; key None holds (term number, open ending)."""
    root: dict = {}
    for k, (term, stem) in enumerate(terms):
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node.setdefault(None, []).append((k, stem))
    return root


def match_words(matrix: np.ndarray, length: np.ndarray, trie: dict, sizes: np.ndarray, fuzzy: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(term, edits) of the nearest lexicon entry of each word, -1 where none accepts it.

    matrix: bytes of the words, 0 beyond their length.  An entry accepts words
    within MAX_EDITS if it has FUZZY_LEAST bytes or more and the first byte agrees, else only exact ones.
    """
    n, width = matrix.shape
    best, edits = np.full(n, -1, np.int64), np.full(n, 9, np.int8)

    def walk(node, depth, idx, low, mid, high):
        # low, mid, high: states (edits so far) at word offsets depth - 1, depth, depth + 1
        for k, stem in node.get(None, ()):
            allowed = MAX_EDITS if fuzzy and sizes[k] >= FUZZY_LEAST else 0
            d = np.full(len(idx), 9, np.int8)
            for state, at in ((low, depth - 1), (mid, depth), (high, depth + 1)):
                ends = length[idx] >= at if stem else length[idx] == at
                d = np.minimum(d, np.where(ends, state, 9))
            ok = (d <= allowed) & (d < edits[idx])
            best[idx[ok]], edits[idx[ok]] = k, d[ok]
        for c, child in node.items():
            if c is None:
                continue
            rows = matrix[idx]
            hit = lambda at: rows[:, at] != c if 0 <= at < width else np.ones(len(idx), bool)
            # offsets depth, depth + 1, depth + 2 after one more lexicon byte
            a = np.minimum(mid + 1, low + hit(depth - 1)) if depth else np.minimum(mid + 1, 9)
            b = np.minimum(np.minimum(high + 1, mid + hit(depth)), a + 1)
            z = np.minimum(high + hit(depth + 1), b + 1)
            live = np.minimum(np.minimum(a, b), z) <= MAX_EDITS
            if depth == 0:
                live &= rows[:, 0] == c
            if live.any():
                walk(child, depth + 1, idx[live], a[live].astype(np.int8), b[live].astype(np.int8), z[live].astype(np.int8))

    start = np.arange(n)
    walk(trie, 0, start, np.full(n, 9, np.int8), np.zeros(n, np.int8), np.ones(n, np.int8))
    return best, np.where(best >= 0, edits, 0)


def enclosed(left: str, right: str) -> bool:
    """Whether a quotation opens in left, what comes before a word, and closes in right, what comes after it.

    A mark between two letters or digits is an apostrophe.  Marks that look
    alike on both sides open where what follows touches them, and close where
    what precedes does, or stand in blanks.
    """
    apart = lambda c: not c or c.isspace()

    def marks(text: str, at_end: bool):
        for k, c in enumerate(text):
            a, b = text[max(0, k - 1) : k], text[k + 1 : k + 2]
            # the word itself lies beyond the inner end
            inside = "x" if at_end and k + 1 == len(text) else b, "x" if not at_end and k == 0 else a
            b, a = inside
            if not (a.isalnum() and b.isalnum()):
                yield c, not a.isalnum() and (apart(a) or not apart(b)), not b.isalnum() and (apart(b) or not apart(a))

    before, after = list(marks(left, True)), list(marks(right, False))
    for opening, closing in QUOTES:
        last = next((m for m in reversed(before) if m[0] in (opening, closing)), None)
        first = next((m for m in after if m[0] in (opening, closing)), None)
        if last and first and last[0] == opening and first[0] == closing and (opening != closing or (last[1] and first[2])):
            return True
    return False


class Lexicon:
    def __init__(self, terms: list[tuple[bytes, bool]], bias: np.ndarray):
        self.terms, self.weights = terms, bias
        self.sizes = np.array([len(t) for t, _ in terms] or [0])
        self.width = int(self.sizes.max()) + MAX_EDITS + 1
        self.trie = build_trie(terms)
        self.last = np.zeros((0, 3))  # the hits behind the features computed last

    def features(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Per row: exact hits, misspelled hits, quoted hits, each as saturated counts, their density, and a constant."""
        w = Words(buf, off, lower=True, alnum=True)
        hits = self.last = self.hits(w, off)
        out = np.zeros((len(off) - 1, N_FEATURES))
        out[:, 0] = 1
        out[:, 1:4] = np.minimum(hits, 6)
        out[:, 4] = 100 * hits[:, 0] / np.maximum(w.count, 20)
        out[:, 5] = hits[:, 0] > 0
        out[:, 6] = hits[:, 1] > 0
        return out

    def hits(self, w: Words, off: np.ndarray) -> np.ndarray:
        """Per row: how many exact, misspelled and quoted hits."""
        hits = np.zeros((len(off) - 1, 3))
        if not len(w.start):
            return hits
        buf = w.buf
        uniq, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        size = w.end[first] - w.start[first]
        grid = w.start[first][:, None] + np.arange(self.width)
        inside = np.arange(self.width) < size[:, None]
        matrix = np.where(inside, w.buf[np.minimum(grid, len(buf) - 1)], 0)
        term, edits = match_words(matrix, size, self.trie, self.sizes)
        at = np.flatnonzero(term[inverse] >= 0)
        row, wrong = w.row(), edits[inverse] > 0
        for i in at:
            quoted = self._quoted(w, off, int(i), int(row[i]))
            hits[row[i], 2 if quoted else 1 if wrong[i] else 0] += 1
        return hits

    def _quoted(self, w: Words, off: np.ndarray, i: int, row: int) -> bool:
        """Whether quotation marks enclose the word closely, or a reporting word stands shortly before it in its sentence."""
        lo, hi = max(int(w.first[row]), i - CONTEXT), min(int(w.first[row + 1]), i + CONTEXT + 1)
        left = w.buf[max(int(off[row]), int(w.start[lo]) - 3) : w.start[i]].tobytes()
        right = w.buf[w.end[i] : min(int(off[row + 1]), int(w.end[hi - 1]) + 4)].tobytes()
        if enclosed(left.decode(errors="ignore"), right.decode(errors="ignore")):
            return True
        return any(w.text(j) in REPORTING and not any(p in w.buf[w.end[j] : w.start[i]].tobytes() for p in (b".", b"\n", b"!")) for j in range(max(lo, i - 3), i))


def learn_terms(texts: list[str], toxic: list[int]) -> list[tuple[bytes, bool]]:
    """Words and stems found almost only in toxic rows, with the seeds.

    A stem is taken at its longest form that keeps nine tenths of its rows.  A
    word must follow several different words, or it may stem from copies of one text.
    """
    bad, good = Counter(), Counter()
    after: dict[bytes, set[bytes]] = {}
    stems_bad, stems_good = Counter(), Counter()
    for k, y in enumerate(toxic):
        buf, off = buffers(pa.array([texts[k]], pa.large_string()))
        w = Words(buf, off, lower=True, alnum=True)
        seq = [w.buf[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
        words = {x for x in seq if len(x) <= 40}
        if y:
            for before, x in zip([b"", *seq], seq, strict=False):
                known = after.setdefault(x, set())
                if len(known) < 8:
                    known.add(before)
        (bad if y else good).update(words)
        (stems_bad if y else stems_good).update({x[:n] for x in words for n in range(STEM_LEAST, min(len(x), 9))})
    pure = lambda b, g: b >= LEAST_ROWS and b >= PURITY * (b + g)
    total = max(1, sum(toxic))
    words = {x for x, b in bad.items() if len(x) >= STEM_LEAST and pure(b, good[x]) and b >= 0.01 * total and len(after[x]) >= min(b, 8) / 2}
    stems = {x for x, b in stems_bad.items() if pure(b, stems_good[x]) and b >= max(2 * LEAST_ROWS, 0.02 * total)}
    chosen = set()
    for x in stems:
        if any(x[:n] in stems for n in range(STEM_LEAST, len(x))):
            continue
        while longer := [y for y in stems if len(y) == len(x) + 1 and y.startswith(x) and stems_bad[y] >= 0.9 * stems_bad[x]]:
            x = longer[0]
        endings = sum(1 for v in bad if v.startswith(x))
        if endings >= 5 and bad[x] < 0.5 * stems_bad[x]:
            chosen.add(x)
    words -= {x for x in words if any(x.startswith(s) for s in chosen)}
    return sorted([(x, False) for x in words | {s.encode() for s in SEEDS}] + [(x, True) for x in chosen])


def fit(texts: list[str], toxic: list[int], steps: int = 400) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and logistic weights of the features; without toxic rows the prior weights stay."""
    lexicon = Lexicon(learn_terms(texts, toxic), np.zeros(0))
    prior = np.array([-4.0, 0.8, 0.2, -0.1, 0.2, 5.0, 0.8])
    w = prior.copy()
    if toxic and 0 < sum(toxic) < len(toxic):
        x = np.concatenate([lexicon.features(*buffers(pa.array(texts[i : i + 200], pa.large_string()))) for i in range(0, len(texts), 200)])
        y = np.asarray(toxic, float)
        for _ in range(steps):  # Newton's method with a pull towards the prior
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + 0.5 * (w - prior)
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
    return lexicon, w


def _score(lexicon: Lexicon, weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for part, buf, off in blocks(batch):
                x = lexicon.features(buf, off)
                hits = lexicon.last
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.7).astype(np.int32)), *(pa.array(hits[:, k].astype(np.int64)) for k in range(3))],
                    ["doc_id", "held_out", "score", "predicted", "n_terms", "n_misspelled", "n_quoted"],
                )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row, in one pass.  In scores, term counts stop at 6.

    Null and empty texts get the score of a text without terms, repeated rows
    equal scores; a null id has no fold, so held_out is null.  With no usable
    labels the seeds and prior weights decide.
    """
    lexicon, weights = fit(*training_sample(docs, labels, "toxic", 3, 1, rows, "toxicity"))
    picked = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    return picked.withColumn("held_out", fold(F.col("id"), 3) == 1).mapInArrow(_score(lexicon, weights), SCHEMA)
