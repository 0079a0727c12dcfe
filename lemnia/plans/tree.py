"""Syntax trees of formulas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    """An operator or function applied to arguments; operators use their symbol as name."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Fn:
    """An anonymous function."""

    params: tuple[str, ...]
    body: object


@dataclass(frozen=True)
class Mat:
    """A matrix literal by rows; one row for arrays."""

    rows: int
    cols: int
    items: tuple


Node = Num | Text | Var | Call | Fn | Mat


#: Functions whose value is a matrix.
MATRIX_CALLS = {"invert", "transpose", "tri_mat", "echelon", "cofactor", "adjoint", "eigvec", "eigvalues", "matrix_add", "matrix_sub", "matrix_mul", "matrix_div", "matrix_pow", "matrix_minor", "sub_mat", "matrix_edit", "rnd_mat", "linear_sys"}
_OF_MATRICES = {"+", "-", "*", "/", "^", "pow", "square", "cube"}


def is_matrix(node: Node) -> bool:
    return isinstance(node, Mat) or (isinstance(node, Call) and (node.name in MATRIX_CALLS or (node.name in _OF_MATRICES and any(map(is_matrix, node.args)))))


def call(name: str, *args: Node) -> Call:
    return Call(name, tuple(args))


def rewrite(node: Node, f: Callable[[Node], Node]) -> Node:
    """Bottom-up rewriting."""
    if isinstance(node, Call):
        node = Call(node.name, tuple(rewrite(a, f) for a in node.args))
    elif isinstance(node, Mat):
        node = Mat(node.rows, node.cols, tuple(rewrite(a, f) for a in node.items))
    elif isinstance(node, Fn):
        node = Fn(node.params, rewrite(node.body, f))
    return f(node)


def substitute(node: Node, values: dict[str, Node]) -> Node:
    return rewrite(node, lambda x: values.get(x.name, x) if isinstance(x, Var) else x)


def variables(node: Node) -> list[str]:
    """Names in first-seen order, parameters of inner functions left out."""
    out: list[str] = []

    def walk(x, bound):
        if isinstance(x, Var) and x.name not in bound and x.name not in out:
            out.append(x.name)
        elif isinstance(x, Call):
            for a in x.args:
                walk(a, bound)
        elif isinstance(x, Mat):
            for a in x.items:
                walk(a, bound)
        elif isinstance(x, Fn):
            walk(x.body, bound | set(x.params))

    walk(node, frozenset())
    return out
