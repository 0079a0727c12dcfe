"""Tokens of the formula language."""

from __future__ import annotations

import re


class SyntaxProblem(ValueError):
    """The text is no formula."""


#: Names with an inverse form, written with a raised minus one.
INVERTIBLE = "sin cos tan sec csc cot sinh cosh tanh sech csch coth ln lg log".split()

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<inv>(?:%s)-¹)
    |(?P<name>[A-Za-z_$θπφ][A-Za-z0-9_$θπ]*(?:\[\d+\])?)
    |(?P<text>"[^"]*"|'[^']*')
    |(?P<op>-¹|³√|√|²|³|&&|\|\||==|!=|<=|>=|[-+*/%%^!<>=(),;@РČ×÷])"""
    % "|".join(INVERTIBLE),
    re.X,
)


def tokenize(text: str) -> list[tuple[str, str]]:
    """(kind, text) pairs: num, name, text or op; ends with ("end", "")."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at} in {text!r}")
        at = m.end()
        kind, value = m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "inv":
            kind = "name"
        out.append((kind, {"×": "*", "÷": "/"}.get(value, value)))
    return [*out, ("end", "")]
