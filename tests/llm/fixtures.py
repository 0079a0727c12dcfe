"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept string, score double, component_id string, held_out int"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(r: random.Random, n: int) -> str:
    return " ".join("the" if r.random() < 0.2 else "of" if r.random() < 0.1 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """(id, text): nulls, empty and blank texts, ties, repeated rows, exact and near copies, shared passages, one long text."""
    r = random.Random(seed)
    texts = [words(r, r.randint(30, 200)) for _ in range(30)]
    passage = words(r, 60)
    out = list(enumerate(texts))
    out += [(100 + k, t) for k, t in enumerate(texts[:6])]  # exact copies
    for k, t in enumerate(texts[6:12]):  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append((200 + k, " ".join(w)))
    out += [(300 + k, f"{words(r, 20)} {passage} {words(r, 20 + k)}") for k in range(6)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "One two"), (405, "a"), (406, "line one\nline one\nline one\n\n" + passage), (407, "été naïve ñandú 中文 " * 30), (408, words(r, 6000)), (409, "ab " * 400)]
    out += [(5, texts[5]), (None, texts[3]), (None, None)]  # a repeated row, and null ids
    return out


def frame(spark, rows, partitions: int = 3):
    """With further columns whose names clash with results."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 1.0, "y", 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
