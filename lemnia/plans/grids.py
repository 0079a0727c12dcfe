"""Matrix values of formulas.

The shape of a matrix is known when its formula is compiled, so a matrix is a
grid of cells, each a plain number or a Column.  Grids of numbers are computed
at once on the driver; sums, products, transposes and blocks of Columns stay
expressions; eliminations and eigenvalues run in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import matrix as M
from .lexer import SyntaxProblem
from .tree import MATRIX_CALLS, Call, Mat, Node, Num, is_matrix

#: Products of cells up to which a matrix product is one expression.
INLINE = 300


@dataclass(frozen=True)
class Grid:
    rows: int
    cols: int
    cells: tuple

    @property
    def plain(self) -> bool:
        return not any(isinstance(c, Column) for c in self.cells)

    def numbers(self) -> np.ndarray:
        return np.array(self.cells, float).reshape(self.rows, self.cols)

    def columns(self) -> list[Column]:
        return [c if isinstance(c, Column) else F.lit(float(c)) for c in self.cells]

    def array(self) -> Column:
        """The cells by rows."""
        return F.array(*self.columns())

    def struct(self) -> Column:
        return M.matrix(self.rows, self.cols, *self.columns())

    def at(self, i: int, j: int):
        return self.cells[i * self.cols + j]


def of_numbers(m: np.ndarray) -> Grid:
    m = np.atleast_2d(np.asarray(m, float))
    return Grid(m.shape[0], m.shape[1], tuple(m.ravel().tolist()))


def _each(a: Grid, b: Grid, f) -> Grid:
    if (a.rows, a.cols) != (b.rows, b.cols):
        raise SyntaxProblem(f"{a.rows} x {a.cols} against {b.rows} x {b.cols}")
    return Grid(a.rows, a.cols, tuple(f(x, y) for x, y in zip(a.cells, b.cells, strict=True)))


def multiply(a: Grid, b: Grid) -> Grid:
    if a.cols != b.rows:
        raise SyntaxProblem(f"{a.rows} x {a.cols} times {b.rows} x {b.cols}")
    if a.plain and b.plain:
        return of_numbers(a.numbers() @ b.numbers())
    if a.rows * a.cols * b.cols > INLINE:
        return _batch("matrix_mul", (a, b), a.rows, b.cols)
    cell = lambda i, j: sum((a.at(i, k) * b.at(k, j) for k in range(1, a.cols)), a.at(i, 0) * b.at(0, j))
    return Grid(a.rows, b.cols, tuple(cell(i, j) for i in range(a.rows) for j in range(b.cols)))


def _batch(name: str, grids: tuple, rows: int, cols: int, **k) -> Grid:
    """A function of numpy matrices; of numbers at once, of Columns in Arrow batches.  What has no value is NaN."""
    if all(g.plain for g in grids):
        f = (lambda m: np.linalg.matrix_power(m, k["exponent"])) if name == "matrix_pow" else M.UNARY.get(name) or M.BINARY[name]
        try:
            return of_numbers(f(*(g.numbers() for g in grids)))
        except np.linalg.LinAlgError:
            return Grid(rows, cols, (math.nan,) * (rows * cols))
    data = M.apply(name, *(g.struct() for g in grids), **k)["data"]
    return Grid(rows, cols, tuple(F.coalesce(F.get(data, F.lit(i)), F.lit(math.nan)) for i in range(rows * cols)))


def power(a: Grid, n: int) -> Grid:
    if a.rows != a.cols:
        raise SyntaxProblem("a power needs a square matrix")
    if n < 0:
        return power(_batch("invert", (a,), a.rows, a.cols), -n)
    if n == 0:
        return of_numbers(np.eye(a.rows))
    if a.plain or n > 3:
        return _batch("matrix_pow", (a,), a.rows, a.cols, exponent=n)
    out = a
    for _ in range(n - 1):
        out = multiply(out, a)
    return out


def _whole(node: Node) -> int:
    if not isinstance(node, Num) or node.value != int(node.value):
        raise SyntaxProblem("a whole number is needed")
    return int(node.value)


class Grids:
    """Grids of matrix-valued trees; ``number`` lowers what is no matrix."""

    def __init__(self, number):
        self.number = number

    def cell(self, node: Node):
        return node.value if isinstance(node, Num) else self.number(node)

    def grid(self, x: Node) -> Grid:
        if isinstance(x, Mat):
            if any(is_matrix(a) for a in x.items):  # a list of one matrix
                return self.grid(x.items[0]) if len(x.items) == 1 else self._stack(x)
            return Grid(x.rows, x.cols, tuple(map(self.cell, x.items)))
        if not isinstance(x, Call):
            raise SyntaxProblem("a matrix is needed")
        name, args = x.name, x.args
        if name in ("+", "-", "*", "/") or name in ("^", "pow", "square", "cube"):
            return self._operator(name, args)
        if name in MATRIX_CALLS:
            return getattr(self, f"_{name}")(*args)
        raise SyntaxProblem(f"{name} gives no matrix")

    def _stack(self, x: Mat) -> Grid:
        raise SyntaxProblem("a matrix of matrices")

    def _operator(self, name: str, args: tuple) -> Grid:
        if name in ("square", "cube"):
            return power(self.grid(args[0]), 2 if name == "square" else 3)
        a, b = args
        if name in ("^", "pow"):
            return power(self.grid(a), _whole(b))
        if is_matrix(a) and is_matrix(b):
            x, y = self.grid(a), self.grid(b)
            if name == "*":
                return multiply(x, y)
            if name == "/":
                return multiply(x, self._inverse(y))
            return _each(x, y, (lambda p, q: p + q) if name == "+" else (lambda p, q: p - q))
        if name == "*":
            s, m = (a, b) if is_matrix(b) else (b, a)
            k = self.cell(s)
            g = self.grid(m)
            return Grid(g.rows, g.cols, tuple(c * k for c in g.cells))
        if name == "/" and is_matrix(a):
            k, g = self.cell(b), self.grid(a)
            return Grid(g.rows, g.cols, tuple(c / k for c in g.cells))
        if name == "/":
            k, g = self.cell(a), self._inverse(self.grid(b))
            return Grid(g.rows, g.cols, tuple(c * k for c in g.cells))
        raise SyntaxProblem(f"a number {name} a matrix")

    @staticmethod
    def _inverse(g: Grid) -> Grid:
        if g.rows != g.cols:
            raise SyntaxProblem("an inverse needs a square matrix")
        return _batch("invert", (g,), g.rows, g.cols)

    # -- functions ----------------------------------------------------------
    def _invert(self, a):
        return self._inverse(self.grid(a))

    def _transpose(self, a):
        g = self.grid(a)
        return Grid(g.cols, g.rows, tuple(g.at(i, j) for j in range(g.cols) for i in range(g.rows)))

    def _same(self, name, a):
        g = self.grid(a)
        return _batch(name, (g,), g.rows, g.cols)

    def _tri_mat(self, a):
        return self._same("tri_mat", a)

    def _echelon(self, a):
        return self._same("echelon", a)

    def _cofactor(self, a):
        return self._same("cofactor", a)

    def _adjoint(self, a):
        return self._same("adjoint", a)

    def _eigvec(self, a):
        return self._same("eigvec", a)

    def _eigvalues(self, a):
        g = self.grid(a)
        return _batch("eigvalues", (g,), g.rows, 2)

    def _matrix_add(self, a, b):
        return self._operator("+", (a, b))

    def _matrix_sub(self, a, b):
        return self._operator("-", (a, b))

    def _matrix_mul(self, a, b):
        return self._operator("*", (a, b))

    def _matrix_div(self, a, b):
        return self._operator("/", (a, b))

    def _matrix_pow(self, a, n):
        return power(self.grid(a), _whole(n))

    def _matrix_minor(self, a, i, j):
        g, r, c = self.grid(a), _whole(i), _whole(j)
        return Grid(g.rows - 1, g.cols - 1, tuple(g.at(i, j) for i in range(g.rows) if i != r for j in range(g.cols) if j != c))

    def _sub_mat(self, a, i, j):
        g, r, c = self.grid(a), _whole(i), _whole(j)
        return Grid(g.rows - r, g.cols - c, tuple(g.at(i, j) for i in range(r, g.rows) for j in range(c, g.cols)))

    def _matrix_edit(self, a, i, j, v):
        g = self.grid(a)
        at = _whole(i) * g.cols + _whole(j)
        return Grid(g.rows, g.cols, (*g.cells[:at], self.cell(v), *g.cells[at + 1 :]))

    def _rnd_mat(self, n, r, c):
        rows, cols = _whole(r), _whole(c)
        return Grid(rows, cols, tuple(F.floor(F.rand() * self.number(n)).cast("double") + 1 for _ in range(rows * cols)))

    def _linear_sys(self, *args):
        """The unknowns, from an augmented matrix or its numbers by rows."""
        if len(args) == 1 and is_matrix(args[0]):
            g = self.grid(args[0])
        else:
            n = math.isqrt(len(args))
            if n * (n + 1) != len(args):
                raise SyntaxProblem(f"{len(args)} numbers are no system")
            g = Grid(n, n + 1, tuple(map(self.cell, args)))
        if g.cols == 1 or (g.rows == 1 and g.cols > 2):  # a plain list of numbers
            n = math.isqrt(len(g.cells))
            g = Grid(n, n + 1, g.cells)
        if g.cols != g.rows + 1:
            raise SyntaxProblem("a system of n equations has n + 1 columns")
        return _batch("linear_sys", (g,), g.rows, 1)


def determinant(g: Grid) -> Column:
    if g.rows != g.cols:
        raise SyntaxProblem("a determinant needs a square matrix")
    if g.plain:
        return F.lit(float(np.linalg.det(g.numbers())))
    if g.rows > 4:
        return M.determinant(g.struct())

    def expand(rows: list[list]):
        if len(rows) == 1:
            return rows[0][0]
        parts = [top * expand([r[:j] + r[j + 1 :] for r in rows[1:]]) * (-1 if j % 2 else 1) for j, top in enumerate(rows[0])]
        return sum(parts[1:], parts[0])

    out = expand([[g.at(i, j) for j in range(g.cols)] for i in range(g.rows)])
    return out if isinstance(out, Column) else F.lit(float(out))
