"""Logical formulas: comparisons of math formulas joined left to right.

Square brackets group, round ones belong to math.  Connectives have no
precedence; what follows an implication's right side is not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import compare
from .lexer import SyntaxProblem
from .parser import split_statements

_CONNECT = re.compile(r"\s+(and|or|xor|impl|imp|eq)\s+|\s*(&+|\|+)\s*")
_COMPARE = re.compile(r"!=|==|>=|<=|>|<|\s+(?:le|ge|lt|gt)\s+")
_WORD = {"le": "<=", "ge": ">=", "lt": "<", "gt": ">"}


def split_logical(text: str) -> tuple[list[str], list[str]]:
    """Operands and connectives at bracket depth 0."""
    operands, connectives, depth, cur, i = [], [], 0, "", 0
    while i < len(text):
        c = text[i]
        depth += c in "[(" and 1 or c in "])" and -1 or 0
        m = _CONNECT.match(text, i) if depth == 0 else None
        if m and (cur.strip() or operands):
            operands.append(cur.strip())
            connectives.append((m[1] or m[2][0]).strip())
            cur, i = "", m.end()
            continue
        cur += c
        i += 1
    return [*operands, cur.strip()], connectives


def _combine(op: str, a: Column, b: Column) -> Column:
    if op in ("&", "and"):
        return a & b
    if op in ("|", "or"):
        return a | b
    if op == "xor":
        return a != b
    if op == "eq":
        return a == b
    return ~a | b


Member = Callable[[str, object], "Column | None"]


@dataclass
class _Context:
    session: object
    columns: object
    values: object
    members: tuple[Member, ...]
    trace: list[tuple[int, str]] | None
    depth: int = 0

    def note(self, text: str) -> None:
        if self.trace is not None:
            self.trace.append((self.depth, text.strip()))

    def inner(self) -> _Context:
        return replace(self, depth=self.depth + 1)

    def math(self, text: str) -> Column:
        return self.session.compile(text, self.columns, self.values)


def compile_logical(text: str, session, columns=None, values=None, members: Iterable[Member] = (), trace: list[tuple[int, str]] | None = None) -> Column:
    """A boolean Column; a text without any logical sign is math, true where it is not 0.

    members are asked for each operand first: member(text, session) gives a
    boolean Column, or None for what it does not know.  A trace list gets (depth, text)
    of every part in the order in which it is read.
    """
    *first, last = split_statements(text)
    for s in first:
        session.define(s)
    return _logical(last, _Context(session, columns, values, tuple(members), trace))


def _index_brackets(text: str) -> bool:
    """Whether the first square bracket is a variable's index."""
    return bool(re.match(r"[^\[]*[A-Za-z_]\[\d+\]", text))


def _logical(text: str, context: _Context) -> Column:
    context.note(text)
    operands, connectives = split_logical(text.strip())
    out = _operand(operands[0], context.inner())
    for op, right in zip(connectives, operands[1:], strict=True):
        out = _combine(op, out, _operand(right, context.inner()))
        if op in ("imp", "impl"):
            break
    return out


def _operand(text: str, context: _Context) -> Column:
    text = text.strip()
    for member in context.members:
        found = member(text, context.session)
        if found is not None:
            context.note(text)
            return found
    if text.startswith("!["):
        return ~_operand(text[1:], context)
    if text.startswith("[") and text.endswith("]"):
        return _logical(text[1:-1], context)
    context.note(text)
    if text.lower() in ("true", "false"):
        return F.lit(text.lower() == "true")
    signs = [m for m in _COMPARE.finditer(text)]
    if len(signs) > 1:
        raise SyntaxProblem(f"one comparison only: {text!r}")
    if signs:
        m = signs[0]
        op = _WORD.get(m[0].strip(), m[0].strip())
        a, b = (context.math(t) for t in (text[: m.start()], text[m.end() :]))
        return compare(op, a, b, re.fullmatch(r"\s*[\d.]+\s*", text[: m.start()]) is not None, re.fullmatch(r"\s*-?[\d.]+\s*", text[m.end() :]) is not None)
    c = context.math(text)
    return (c != 0) & ~F.isnan(c)
