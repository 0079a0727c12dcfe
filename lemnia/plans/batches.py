"""What iterates in formulas, as Arrow batches of numpy arrays: integrals, roots and derivatives by jets.

Folds in Columns cost some tenth of a microsecond for each operation of each step; these take all rows of a
batch at once, equal rows of a batch once.  Only what numpy computes as Columns do comes here; the
rest stays a fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import BACKWARD, FORWARD, UNIT
from .calculus import differentiate
from .numeric import FUNCTIONS
from .simplify import simplify
from .tree import Call, Node, Num, Var, variables

#: Panels of integrals computed at once.
_PANELS = 4096


def _divide(a, b):
    return np.divide(a, b + 0.0)  # by -0 as by 0


def _true(c):
    return (c != 0) & ~np.isnan(c)


_SAME = "sin cos tan asin acos atan sinh cosh tanh exp ln lg sqrt cbrt square cube abs atan2 hypot + - * % ^ pow < <= > >= == !=".split()
#: Numeric forms that agree with those of Columns for all values.
FORMS = {k: FUNCTIONS[k] for k in _SAME} | {
    "/": _divide, "inverse": lambda x: _divide(1.0, x), "if": lambda c, a, b: np.where(_true(c), a, b), "&&": lambda a, b: _true(a) & _true(b), "||": lambda a, b: _true(a) | _true(b),
    "sec": lambda x: _divide(1.0, np.cos(x)), "csc": lambda x: _divide(1.0, np.sin(x)), "cot": lambda x: _divide(1.0, np.tan(x)),
    "sech": lambda x: _divide(1.0, np.cosh(x)), "csch": lambda x: _divide(1.0, np.sinh(x)), "coth": lambda x: _divide(1.0, np.tanh(x)),
}


def agrees(node: Node, session, names) -> bool:
    """Whether the tree has a numeric form that gives what its Column gives."""
    if isinstance(node, Num):
        return True
    if isinstance(node, Var):
        return node.name in names
    if not isinstance(node, Call) or node.name not in FORMS or node.name in session.registered or node.name in session.text_methods:
        return False
    return session.division == "ieee" and all(agrees(a, session, names) for a in node.args)


def compiled(node: Node, unit: float = 1.0, forms: dict[str, Callable] = FORMS) -> Callable[[dict], np.ndarray]:
    """The tree as straight code over a dict of arrays, equal parts computed once; angles in units of so many radians."""
    lines, known, given = [], {}, {}

    def visit(x: Node) -> str:
        if x in known:
            return known[x]
        name = known[x] = f"v{len(known)}"
        if isinstance(x, Num):
            given[name] = np.float64(x.value)
        elif isinstance(x, Var):
            lines.append(f"{name} = env[{x.name!r}]")
        else:
            args = [visit(a) for a in x.args]
            given[f"f{name}"] = forms[x.name]
            if unit != 1.0 and x.name in FORWARD:
                args = [f"{args[0]} * {unit!r}"]
            lines.append(f"{name} = f{name}({', '.join(args)}){f' / {unit!r}' if unit != 1.0 and x.name in BACKWARD else ''}{' * 1.0' if x.name in ('<', '<=', '>', '>=', '==', '!=', '&&', '||') else ''}")
        return name

    out = visit(node)
    exec("\n    ".join(["def f(env):", *lines, f"return {out}"]), given)
    return given["f"]


def distinct(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The place of one row for each distinct row, and the number of each row's."""
    code = np.zeros(len(arrays[0]), np.int64)
    for a in arrays:
        part = np.unique(np.ascontiguousarray(a).view(np.int64), return_inverse=True)[1]
        code = np.unique(code * (int(part.max()) + 1) + part, return_inverse=True)[1] if len(a) else code
    return np.unique(code, return_index=True, return_inverse=True)[1:]


def rows(f: Callable[..., np.ndarray], *columns: Column, nulls: bool = True) -> Column:
    """f of the columns as arrays of doubles; null where one of them is, or f of NaN in its place."""

    @F.arrow_udf("double")
    def run(*given: pa.Array) -> pa.Array:
        arrays = [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in given]
        null = np.zeros(len(arrays[0]), bool)
        for c in given:
            if nulls and c.null_count:
                null |= c.is_null().to_numpy(zero_copy_only=False)
        at, back = distinct(arrays)
        with np.errstate(all="ignore"):
            got = pa.array(np.asarray(f(*(a[at] for a in arrays)), float)[back])
        return pc.if_else(pa.array(null), pa.scalar(None, pa.float64()), got) if null.any() else got

    return run(*(c.cast("double") for c in columns))


class Body:
    """A formula of one variable and of further columns; picklable, compiled where it is used."""

    def __init__(self, node: Node, name: str, session, more: dict | None = None):
        self.trees, self.name, self.unit = {"f": node, **(more or {})}, name, UNIT[session.angle] if session.angle != "RAD" else 1.0
        self.others = sorted({v for t in self.trees.values() for v in variables(t)} - {name})

    def at(self, columns: tuple[np.ndarray, ...]) -> dict[str, Callable]:
        """The functions f(x, rows): of x for the rows of given places, or for all."""
        env = dict(zip(self.others, columns, strict=True))

        def bound(code):
            def call(x, places=None):
                local = {k: (v if places is None else v[places]) for k, v in env.items()}
                if x.ndim > 1:
                    local = {k: v[:, None] for k, v in local.items()}
                return np.broadcast_to(np.asarray(code(local | {self.name: x}), float), x.shape)

            return call

        return {k: bound(compiled(t, self.unit)) for k, t in self.trees.items()}


def _column(low, body: Body, f: Callable[..., np.ndarray], arguments: tuple[Node, ...], nulls: bool = True) -> Column | None:
    """f(arguments.., further columns..) as a Column: a number where all are numbers, else a batch; None where neither can be."""
    if not body.others and all(isinstance(a, Num) for a in arguments):
        with np.errstate(all="ignore"):
            return F.lit(float(f(*(np.array([float(a.value)]) for a in arguments))[0]))
    if not low.outer:
        return None
    inner = low.inner()
    return rows(f, *map(inner.number, arguments), *(low.env[k] for k in body.others), nulls=nulls)


# -- integrals ------------------------------------------------------------------
def integral(low, f, lo: Node, hi: Node, panels: int | None, gauss: int, width: float, most: int) -> Column | None:
    """As the fold of the same name: Gauss-Legendre panels, added up in order."""
    if not agrees(f.body, low.session, {*low.env, f.params[0]}) or (panels is not None and panels < 1):
        return None
    body = Body(f.body, f.params[0], low.session)
    nodes, weights = np.polynomial.legendre.leggauss(gauss)

    def run(a, b, *columns):
        call = body.at(columns)["f"]
        wanted = np.maximum(1.0, np.ceil(np.abs(b - a) / width - 1e-9))
        fits = wanted <= most
        n = np.full(len(a), panels) if panels is not None else np.where(fits, wanted, 0).astype(np.int64)
        step = (b - a) / np.maximum(n, 1)
        ends = np.cumsum(n)
        out = np.zeros(len(a))
        for first in range(0, int(ends[-1]) if len(ends) else 0, _PANELS):
            flat = np.arange(first, min(first + _PANELS, int(ends[-1])))
            row = np.searchsorted(ends, flat, "right")
            w = step[row]
            mid = a[row] + (flat - (ends - n)[row] + 0.5) * w
            part = (call(mid[:, None] + w[:, None] * (nodes / 2), row) * weights).sum(axis=1) * w / 2
            np.add.at(out, row, part)
        return out if panels is not None else np.where(fits, out, math.nan)

    return _column(low, body, run, (lo, hi))


# -- roots ------------------------------------------------------------------------
def root(low, f, starts: tuple[Node, ...], steps: int) -> Column | None:
    """As the folds of the same name; each method only goes over rows that the one before left, and stops where nothing moves."""
    p = f.params[0]
    slope = simplify(differentiate(f.body, p))
    if not all(agrees(t, low.session, {*low.env, p}) for t in (f.body, slope)):
        return None
    body = Body(f.body, p, low.session, {"slope": slope})

    def run(first, *rest):
        second, columns = (rest[0], rest[1:]) if len(starts) > 1 else (first + 1.0, rest)
        calls = body.at(columns)
        at, slope_at = calls["f"], calls["slope"]
        out = np.full(len(first), math.nan)

        def settled(x, left):
            ok = (np.abs(x) < 1e300) & ((at(x, left) == 0) | (np.abs(_divide(at(x, left), slope_at(x, left))) <= 1e-9 * (1 + np.abs(x))))
            out[left[ok]] = x[ok]
            return left[~ok]

        left = np.arange(len(first))
        left = settled(_newton(at, slope_at, first, left, steps), left)
        left = settled(_chords(at, first[left], second[left], left, steps), left) if len(left) else left
        if len(left):
            out[left] = _bisected(at, first[left], second[left], left)
        return out

    return _column(low, body, run, starts, nulls=False)


def _newton(at, slope, x, left, steps):
    x, moving = x.copy(), left
    for _ in range(steps):
        v = x[moving]
        move = _divide(at(v, moving), slope(v, moving))
        new = np.where(np.abs(move) <= 5e-16, v, v - move)
        x[moving] = new
        moving = moving[(new != v) & ~np.isnan(new)]
        if not len(moving):
            break
    return x


def _chords(at, a, b, left, steps):
    a, b, moving = a.copy(), b.copy(), np.arange(len(a))
    for _ in range(steps):
        p, q = a[moving], b[moving]
        fp, fq = at(p, left[moving]), at(q, left[moving])
        move = _divide(fq * (q - p), fq - fp)
        still = (p == q) | (fq == 0) | np.isnan(move)
        moving = moving[~still]
        if not len(moving):
            break
        a[moving], b[moving] = q[~still], q[~still] - move[~still]
    return b


def _bisected(at, first, second, left):
    low, high = np.full(len(first), math.nan), np.full(len(first), math.nan)
    open_ = np.arange(len(first))
    for k in range(-1, 240):
        if k < 0:
            a, b = np.fmin(first, second), np.maximum(first, second)
        else:
            r = 1.15 ** float(k // 2 - 40)
            s, u, v = ((1, 1.0, 1.15), (-1, 1.15, 1.0))[k % 2]
            a, b = first + s * r * u, first + s * r * v
        hit = at(a[open_], left[open_]) * at(b[open_], left[open_]) <= 0
        low[open_[hit]], high[open_[hit]] = a[open_[hit]], b[open_[hit]]
        open_ = open_[~hit]
        if not len(open_):
            break
    out, rows_ = np.full(len(first), math.nan), np.flatnonzero(~np.isnan(low))
    if not len(rows_):
        return out
    places, a, b = left[rows_], low[rows_], high[rows_]
    for _ in range(200):
        mid = (a + b) / 2
        product = at(mid, places) * at(a, places)
        same = (product > 0) | np.isnan(product)
        new_a, new_b = np.where(same, mid, a), np.where(same, b, mid)
        if np.array_equal(new_a, a) and np.array_equal(new_b, b):
            break
        a, b = new_a, new_b
    # a change of sign is no pole where the function is small at its end
    small = np.abs(at(a, places)) <= 1e-3 * np.maximum(np.abs(at(low[rows_], places)), np.abs(at(high[rows_], places)))
    out[rows_[small]] = a[small]
    return out


# -- derivatives --------------------------------------------------------------------
class _NoArrays(ValueError):
    """A function that only Columns have a recurrence for, or whose values numpy gives otherwise."""


class Arrays:
    """The recurrences of Jets over arrays: a jet is the list of its coefficients."""

    def __init__(self, name: str, x: np.ndarray, order: int, env: dict, unit: float):
        self.name, self.x, self.n, self.env, self.unit = name, x, max(1, order), env, unit

    def of(self, node: Node) -> list:
        if isinstance(node, Var) and node.name == self.name:
            return self._line(self.x, 1.0)
        if self.name not in variables(node):
            return self._line(compiled(node, self.unit)(self.env), 0.0)
        a, name = node.args, node.name
        if name in ("+", "-"):
            return [p + q if name == "+" else p - q for p, q in zip(self.of(a[0]), self.of(a[1]), strict=True)]
        if name == "*" and isinstance(a[0], Num):
            return [v * a[0].value for v in self.of(a[1])]
        if name in ("*", "/"):
            return (self._times if name == "*" else self._over)(self.of(a[0]), self.of(a[1]))
        if name in ("^", "pow"):
            if self.name not in variables(a[1]):
                return self._power(self.of(a[0]), a[1])
            return self._exp(self.of(Call("*", (a[1], Call("ln", (a[0],))))))
        if len(a) != 1:
            raise _NoArrays(name)
        return self._function(name, self.of(a[0]))

    def _line(self, first, second) -> list:
        return [first, second, *[0.0] * (self.n - 1)]

    def _fold(self, first, step) -> list:
        out = [first]
        for k in range(1, self.n + 1):
            out.append(step(out, k))
        return out

    @staticmethod
    def _sum(first: int, k: int, term):
        return sum((term(j) for j in range(first, k + 1)), 0.0)

    @staticmethod
    def _div(a, b):
        return np.where(b == 0, math.nan, np.divide(a, b))

    def _times(self, p, q):
        return [self._sum(0, k, lambda j, k=k: p[j] * q[k - j]) for k in range(self.n + 1)]

    def _over(self, p, q):
        return self._fold(self._div(p[0], q[0]), lambda c, k: self._div(p[k] - self._sum(1, k, lambda j: q[j] * c[k - j]), q[0]))

    def _exp(self, u):
        return self._fold(np.exp(u[0]), lambda e, k: self._sum(1, k, lambda j: j * u[j] * e[k - j]) / k)

    def _ln(self, u):
        return self._fold(np.where(u[0] > 0, np.log(u[0]), math.nan), lambda c, k: self._div(u[k] - self._sum(1, k - 1, lambda j: j * c[j] * u[k - j]) / k, u[0]))

    def _power(self, u, exponent: Node):
        if isinstance(exponent, Num) and exponent.value == int(exponent.value) and 0 <= exponent.value <= 64:
            n = int(exponent.value)
            if n == 0:
                return self._line(1.0, 0.0)
            if n == 1:
                return u
            half = self._power(u, Num(float(n // 2)))
            even = self._times(half, half)
            return even if n % 2 == 0 else self._times(even, u)
        r = compiled(exponent, self.unit)(self.env)
        return self._fold(np.power(u[0], r), lambda p, k: self._div(self._sum(1, k, lambda j: (r * j - (k - j)) * u[j] * p[k - j]), u[0]) / k)

    def _pair(self, u, first, second, sign: float):
        a, b = [first], [second]
        for k in range(1, self.n + 1):
            a_k = self._sum(1, k, lambda j, k=k: j * u[j] * b[k - j]) / k
            b.append(sign * self._sum(1, k, lambda j, k=k: j * u[j] * a[k - j]) / k)
            a.append(a_k)
        return a, b

    def _function(self, name: str, u: list) -> list:
        one = self._line(1.0, 0.0)
        ratios = {"sin": lambda s, c: s, "cos": lambda s, c: c, "tan": self._over, "cot": lambda s, c: self._over(c, s), "sec": lambda s, c: self._over(one, c), "csc": lambda s, c: self._over(one, s)}
        if name in ratios:
            v = [x * self.unit for x in u]
            return ratios[name](*self._pair(v, np.sin(v[0]), np.cos(v[0]), -1.0))
        hyperbolic = {"sinh": "sin", "cosh": "cos", "tanh": "tan", "sech": "sec", "csch": "csc", "coth": "cot"}
        if name in hyperbolic:
            return ratios[hyperbolic[name]](*self._pair(u, np.sinh(u[0]), np.cosh(u[0]), 1.0))
        simple = {
            "exp": self._exp, "ln": self._ln, "square": lambda v: self._times(v, v), "cube": lambda v: self._power(v, Num(3.0)), "sqrt": lambda v: self._power(v, Num(0.5)),
            "inverse": lambda v: self._over(one, v), "lg": lambda v: [x * (1 / math.log(10)) for x in self._ln(v)], "abs": lambda v: [x * np.sign(v[0]) for x in v],
        }
        if name not in simple:
            raise _NoArrays(name)
        return simple[name](u)


def derivative(low, f, x: Node, order: int) -> Column | None:
    """The derivative of that order at a point, as the jets of Columns give it."""
    p = f.params[0]
    if not agrees(f.body, low.session, {*low.env, p}):
        return None
    body = Body(f.body, p, low.session)

    def run(at, *columns):
        env = dict(zip(body.others, columns, strict=True))
        top = Arrays(p, at, order, env, body.unit).of(body.trees["f"])[order]
        return np.broadcast_to(np.asarray(top, float) * float(math.factorial(order)), at.shape)

    try:
        with np.errstate(all="ignore"):
            run(np.ones(1), *[np.ones(1)] * len(body.others))
    except _NoArrays:
        return None
    return _column(low, body, run, (x,))
