"""Secret scans by assignment-aware lexing.

Base spans come from three patterns.  On top of them a small lexer reads
source and configuration syntax into name-literal pairs, follows constants
from name to name, and scores each literal by how sensitive its target name
is and how random the literal looks.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcore import LOWER, blocks, runs

#: Kinds in the order in which ties are listed, patterns and least lengths.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Parts of sensitive names, with their weights.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "api_key": 3, "apikey": 3,
    "api-key": 3, "private_key": 3, "access_key": 3, "auth": 2, "credential": 3, "bearer": 2,
}
_HINT = re.compile("|".join(sorted(SENSITIVE, key=len, reverse=True)).encode())
_AKIA = re.compile(b"akia")
_LEX = re.compile(
    r"""["']?(?P<name>[A-Za-z_$][\w.$-]*)["']?\x20*(?::=|=>|(?<![=!<>])=(?!=)|:)\x20*(?P<value>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z0-9+/_.=$\{\}-]+)(?P<more>(?:\x20*\+\x20*(?:"[^"\n]*"|'[^'\n]*'|[A-Za-z_]\w*))*)""",
    re.A,
)
_PART = re.compile(r""""[^"\n]*"|'[^'\n]*'|[A-Za-z_]\w*""", re.A)
LEAST_SCORE = 4.0

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the three patterns, leftmost and not overlapping within a kind."""
    out = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(2, *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return out


def bits(literal: str) -> float:
    """Entropy of the characters, in bits each."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in map(literal.count, set(literal))) if n else 0.0


def sensitivity(name: str) -> int:
    low = name.lower()
    return max((w for part, w in SENSITIVE.items() if part in low), default=0)


def literal_score(name: str, value: str) -> float:
    """Sensitivity of the name, plus what the literal's randomness adds; placeholders score 0."""
    weight = sensitivity(name)
    if not weight or len(value) < MIN_ASSIGN or len(set(value)) < 4 or re.fullmatch(r"[$%]?\{.*\}|<.*>|[xX*.]+|true|false|null|none", value):
        return 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return weight + 0.4 * bits(value) + 0.5 * (classes - 1)


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    known: dict[str, list] = {}
    found = set()
    for m in _LEX.finditer(text):
        # a part is a literal's span, or the list of parts of a name that was assigned before
        parts: list = []
        at = m.start("value")
        value = m["value"]
        if value[0] in "\"'":
            parts.append((at + 1, at + len(value) - 1))
        elif value in known:
            parts.append(known[value])
        else:
            parts.append((at, at + len(value)))
        for p in _PART.finditer(text, m.start("more"), m.end("more")):
            if p[0][0] in "\"'":
                parts.append((p.start() + 1, p.end() - 1))
            elif p[0] in known:
                parts.append(known[p[0]])
        known[m["name"]] = parts
        if sensitivity(m["name"]):
            spans = _literals(parts)
            if literal_score(m["name"], "".join(text[s:e] for s, e in spans)) >= LEAST_SCORE:
                found |= {(s, e) for s, e in spans if e > s}
    return sorted(found)


def _literals(parts: list) -> list[tuple[int, int]]:
    """The spans that nested parts reach, in order; what is reached again counts once, so constants of constants don't multiply."""
    out: list[tuple[int, int]] = []
    seen, stack = {id(parts)}, [iter(parts)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, tuple):
                out.append(x)
            elif id(x) not in seen:
                seen.add(id(x))
                stack.append(iter(x))
                break
        else:
            stack.pop()
    return out


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with the added literals that no base span covers."""
    base = base_spans(text)
    added = [(3, s, e) for s, e in literal_spans(text) if not any(b[1] <= s and e <= b[2] for b in base)]
    key = lambda x: (x[1], x[0], x[2])
    return sorted(base, key=key), sorted(base + added, key=key)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_NONE = hashlib.sha256(b"").hexdigest()


def _hot(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The rows of a block that may hold a span of any kind."""
    out = np.zeros(len(off) - 1, bool)
    raw = LOWER[buf].tobytes()
    # a hint may seem to reach over a text's end and hide one of the next text, so both ends' texts are looked at
    at = [x for find in (_HINT, _AKIA) for m in find.finditer(raw) for x in (m.start(), m.end() - 1)]
    s, e = runs(_IS_HEX[buf], off)
    at = np.concatenate([np.asarray(at, np.int64), s[e - s >= MIN_HEX]])
    out[np.searchsorted(off, at, "right") - 1] = True
    return np.flatnonzero(out)


def _batches(batches):
    for batch in batches:
        for part, buf, off in blocks(batch):
            n = part.num_rows
            counts = np.zeros((4, n), np.int64)
            sha, spans = [_NONE] * n, [""] * n
            texts = part.column("text")
            for i in _hot(buf, off):
                base, all_ = scan_text(texts[i].as_py() or "")
                for k, _, _ in all_:
                    counts[k, i] += 1
                sha[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(counts[0]), pa.array(counts[1]), pa.array(counts[2]), pa.array(sha), pa.array(spans), pa.array(counts[3])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"],
            )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, in one pass without a shuffle.

    Null and empty texts have no span and the digest of the empty string;
    repeated rows stay repeated; texts of any length are scanned whole.
    Positions are code points, ends exclusive.
    """
    picked = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(_batches, SCHEMA)


def _redact(batches):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for part, buf, off in blocks(batch):
            column = part.column(at)
            out = {}
            for i in _hot(buf, off):
                t = column[i].as_py() or ""
                for _, s, e in reversed(_union(scan_text(t)[1])):
                    t = t[:s] + "[REDACTED]" + t[e:]
                out[int(i)] = t
            if out:
                column = pa.array([out.get(i, t) for i, t in enumerate(column.to_pylist())], column.type)
            yield part.set_column(at, part.schema.field(at), column)


def _union(spans):
    out: list[list[int]] = []
    for k, s, e in sorted(spans, key=lambda x: x[1]):
        if out and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([k, s, e])
    return out


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with each secret in ``text`` replaced; null texts stay null."""
    return docs.mapInArrow(_redact, docs.schema)
