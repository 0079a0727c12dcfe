"""Ordinary differential equations, one problem per row.

All methods run in Arrow batches, the rows of a batch stepping together; where a function has no
numeric form, Euler and RK4 are folds over the steps within one expression.
An equation is an expression that equals 0, linear in its highest derivative: y[0] is the state,
y[k] its k-th derivative, t the time.  Systems are lists of equations in y[0] .. y[n-1], each giving
its unknown's slope d[k] as an expression.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.batches import compiled, distinct
from ..plans.calculus import differentiate
from ..plans.lexer import SyntaxProblem
from ..plans.lower import Lowering
from ..plans.numeric import FUNCTIONS, evaluate
from ..plans.simplify import simplify
from ..plans.tree import Call, Mat, Node, Num, Text, Var, call, is_matrix, rewrite, substitute, variables
from ..session import Session

METHODS = ("euler", "rk4", "rk45", "implicit_euler", "bdf2")


def slopes(equation: str | list[str] | Node, order: int = 1, session: Session | None = None) -> list[Node]:
    """First-order form: the derivative of each state."""
    s = session or Session()
    if isinstance(equation, list):
        free = [*(f"y[{k}]" for k in range(len(equation) + 1)), "t"]
        return [simplify(s.bind(s.parse(e), free)) for e in equation]
    names = [f"y[{k}]" for k in range(order + 1)]
    node = s.bind(s.parse(equation.split("=")[0]), [*names, "t"]) if isinstance(equation, str) else equation
    return [*(Var(names[k]) for k in range(1, order)), _isolated(node, names[-1])]


def _isolated(node: Node, top: str) -> Node:
    """What the name must be for the node, linear in it, to be 0."""
    rest = simplify(substitute(node, {top: Num(0.0)}))
    weight = simplify(call("-", substitute(node, {top: Num(1.0)}), rest))
    return simplify(call("/", call("*", Num(-1.0), rest), weight))


def formula_call(low: Lowering, name: str, args: tuple) -> Column:
    """diffeqn(equation, t0, y0, end, step = 0.01, method = rk4) and its kin, as a formula has them.

    The equation is an expression, or @(n)("..", ..) for n unknowns y[0] .. y[n-1], each equation
    linear in y[n], its unknown's derivative.  Path forms take the number of points or
    a presentation after the method, and the presentation after the points.
    """
    if not 4 <= len(args) <= (8 if "Path" in name else 6):
        raise SyntaxProblem(f"{name}: {len(args)} arguments")
    equation, t0, y0, end, *more = args
    h = more[0].value if more and isinstance(more[0], Num) else 0.01
    word = lambda x: x.name if isinstance(x, Var) else x.value if isinstance(x, Text) else None
    method = (word(more[1]) if len(more) > 1 else None) or "rk4"
    if method not in METHODS:
        raise SyntaxProblem(f"{name}: no method {method!r}")
    start = low.grids().grid(y0).columns() if is_matrix(y0) else [low.number(y0)]
    s = low.session
    if isinstance(equation, Mat):
        n = len(equation.items)
        free = [*(f"y[{k}]" for k in range(n + 1)), "t"]
        texts = [s.bind(s.parse(x.value.split("=")[0]), free) if isinstance(x, Text) else x for x in equation.items]
        nodes = [_isolated(x, f"y[{n}]") for x in texts]
    else:
        nodes = slopes(equation, len(start), s)
    if len(nodes) != len(start):
        raise SyntaxProblem(f"{name}: {len(nodes)} unknowns, {len(start)} starting values")
    if "Path" not in name:
        y = solve(nodes, low.number(t0), start, low.number(end), h, method, s)
        return y if isinstance(equation, Mat) else F.get(y, F.lit(0))
    points = int(more[2].value) if len(more) > 2 and isinstance(more[2], Num) else None
    shown = next((word(x) for x in more[2:] if word(x)), "state" if isinstance(equation, Mat) else "trajectory")
    rows = path(nodes, low.number(t0), start, low.number(end), h, method, points, s)
    return rows if shown == "state" or len(start) == 1 else F.transform(rows, lambda r: F.slice(r, 1, 2))


def _rates(nodes, session, t, y):
    env = {f"y[{k}]": c for k, c in enumerate(y)} | {"t": t}
    low = Lowering(session, env)
    return [low.number(n) for n in nodes]


def _pairs(y, k, h):
    return [a + b * h for a, b in zip(y, k, strict=True)]


def _step(nodes, session, method, t, y, h):
    k1 = _rates(nodes, session, t, y)
    if method == "euler":
        return _pairs(y, k1, h)
    # each stage is bound once, so expressions do not grow from stage to stage
    n = len(nodes)
    unpack = lambda c: [F.get(c, F.lit(i)) for i in range(n)]
    let = lambda v, f: F.transform(F.array(v), f)[0]

    def with1(a):
        return let(F.array(*_rates(nodes, session, t + h / 2, _pairs(y, unpack(a), h / 2))), lambda b: with2(a, b))

    def with2(a, b):
        return let(F.array(*_rates(nodes, session, t + h / 2, _pairs(y, unpack(b), h / 2))), lambda c: with3(a, b, c))

    def with3(a, b, c):
        return let(F.array(*_rates(nodes, session, t + h, _pairs(y, unpack(c), h))), lambda d: F.array(*(v + h / 6 * (p + 2 * q + 2 * r + s) for v, p, q, r, s in zip(y, unpack(a), unpack(b), unpack(c), unpack(d), strict=True))))

    return let(F.array(*k1), with1)


def _tree(equation, n: int, session: Session) -> list[Node]:
    return equation if isinstance(equation, list) and equation and not isinstance(equation[0], str) else slopes(equation, n, session)


def solve(equation: str | list[str] | list[Node], t0: Column, y0: list[Column], t_end: Column, h: float = 0.01, method: str = "rk4", session: Session | None = None) -> Column:
    """The states at t_end as an array; t_end = t0 gives y0.  Rows may have initial values and times of their own."""
    if method not in METHODS:
        raise ValueError(method)
    s = session or Session()
    nodes = _tree(equation, len(y0), s)
    if _numerical(nodes, s):
        return _batched(_radians(nodes, s), t0, y0, t_end, h, method)
    if method not in ("euler", "rk4"):
        raise ValueError(f"{method} needs functions with a numeric form")
    return _folded(nodes, t0, y0, t_end, h, method, s)


def _folded(nodes: list[Node], t0: Column, y0: list[Column], t_end: Column, h: float, method: str, s: Session) -> Column:
    """Steps as a fold within one expression, for functions that only Columns have."""
    n = F.greatest(F.lit(0), F.ceil(F.abs(t_end - t0) / h - 1e-9).cast("int"))
    start = F.array(*(c.cast("double") for c in y0))

    def run(step: Column) -> Column:
        def one(y: Column, k: Column) -> Column:
            states = [F.get(y, F.lit(i)) for i in range(len(y0))]
            got = _step(nodes, s, method, t0 + (k - 1) * step, states, step)
            return F.array(*got) if isinstance(got, list) else got

        return F.when(n == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, one))

    return F.transform(F.array((t_end - t0) / F.greatest(n, F.lit(1))), run)[0]


def path(equation: str | list[str] | list[Node], t0: Column, y0: list[Column], t_end: Column, h: float = 0.01, method: str = "rk4", points: int | None = None, session: Session | None = None) -> Column:
    """Array of [t, y..] rows from t0 to t_end: all steps, or ``points`` even ones by linear interpolation.  Explode it for one row per point.

    Adaptive steps end at the same times as fixed ones would.
    """
    if method not in METHODS:
        raise ValueError(method)
    if points is not None and points < 2:
        raise ValueError("two points at least")
    s = session or Session()
    nodes = _tree(equation, len(y0), s)
    if not _numerical(nodes, s):
        raise ValueError("a path needs functions with a numeric form")
    rows = _batched(_radians(nodes, s), t0, y0, t_end, h, method, whole=True)
    if points is None:
        return rows

    def sample(r: Column) -> Column:
        def at(k: Column) -> Column:
            x = k * (F.size(r) - 1) / (points - 1)
            i = F.least(F.floor(x).cast("int"), F.size(r) - 2)
            return F.zip_with(F.get(r, i), F.get(r, i + 1), lambda a, b: a + (b - a) * (x - i))

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)

    return F.transform(F.array(rows), sample)[0]


def _numerical(nodes: list[Node], session: Session) -> bool:
    """Whether all functions have a numeric form."""
    try:
        for n in nodes:
            evaluate(n, dict.fromkeys(variables(n), 1.0))
    except ValueError:
        return False
    return all(v == "t" or v.startswith("y[") for n in nodes for v in variables(n))


def _radians(nodes: list[Node], session: Session) -> list[Node]:
    """Trigonometric functions turned to those of radians."""
    unit = {"RAD": 1.0, "DEG": math.pi / 180, "GRAD": math.pi / 200}[session.angle]
    if unit == 1.0:
        return nodes

    def visit(x: Node) -> Node:
        if isinstance(x, Call) and x.name in ("sin", "cos", "tan", "sec", "csc", "cot"):
            return Call(x.name, (call("*", Num(unit), x.args[0]),))
        return call("*", Num(1 / unit), x) if isinstance(x, Call) and x.name in ("asin", "acos", "atan") else x

    return [rewrite(n, visit) for n in nodes]


def _numeric(nodes):
    codes = [compiled(n, forms=FUNCTIONS) for n in nodes]

    def f(t, y):
        env = {f"y[{k}]": y[:, k] for k in range(y.shape[1])} | {"t": t}
        return np.stack([np.broadcast_to(np.asarray(c(env), float), t.shape) for c in codes], 1)

    return f


#: The Dormand-Prince tableau.
_C = [0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1]
_A = [[], [1 / 5], [3 / 40, 9 / 40], [44 / 45, -56 / 15, 32 / 9], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729], [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84]]
_E = [71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40]


def rk45(f, t, y, end, h, tol=1e-9, most=100_000):
    """Adaptive steps, each row with its own; finished rows stand still."""
    sign = np.where(end >= t, 1.0, -1.0)
    size = np.minimum(np.abs(h), np.maximum(np.abs(end - t), 1e-300))
    for _ in range(most):
        live = (end - t) * sign > 1e-14 * np.maximum(1, np.abs(end))
        if not live.any():
            break
        step = np.where(live, np.minimum(size, np.abs(end - t)), 0) * sign
        ks = []
        for c, row in zip(_C, _A, strict=True):
            at = y + step[:, None] * sum((a * k for a, k in zip(row, ks, strict=False)), np.zeros_like(y))
            ks.append(f(t + c * step, at))
        new = y + step[:, None] * sum(a * k for a, k in zip(_A[6], ks, strict=False))
        err = np.abs(step[:, None] * sum(e * k for e, k in zip(_E, ks, strict=True))).max(axis=1) / (tol * (1 + np.abs(y).max(axis=1)))
        ok = live & (err <= 1)
        y, t = np.where(ok[:, None], new, y), np.where(ok, t + step, t)
        size = size * np.clip(0.9 * np.maximum(err, 1e-10) ** -0.2, 0.2, 5)
    return y


def jacobian(nodes: list[Node]):
    """f(t, y) -> (rows, n, n) partial derivatives, from the trees; None where one has no rule or numeric form."""
    n = len(nodes)
    try:
        trees = [[simplify(differentiate(x, f"y[{k}]")) for k in range(n)] for x in nodes]
        for row in trees:
            for x in row:
                evaluate(x, dict.fromkeys(variables(x), 1.0))
    except ValueError:
        return None
    codes = [[compiled(x, forms=FUNCTIONS) for x in row] for row in trees]

    def f(t, y):
        env = {f"y[{k}]": y[:, k] for k in range(n)} | {"t": t}
        return np.stack([np.stack([np.broadcast_to(np.asarray(c(env), float), t.shape) for c in row], 1) for row in codes], 1)

    return f


def _differences(f):
    """The same by finite differences."""

    def jac(t, y):
        out = np.zeros((len(y), y.shape[1], y.shape[1]))
        for k in range(y.shape[1]):
            d = 1e-7 * (1 + np.abs(y[:, k]))
            z = y.copy()
            z[:, k] += d
            out[:, :, k] = (f(t, z) - f(t, y)) / d[:, None]
        return out

    return jac


def _newton(f, jac, t, guess, base, h, rounds=12):
    """y with y = base + h f(t, y)."""
    y = guess.copy()
    for _ in range(rounds):
        g = y - base - h[:, None] * f(t, y)
        step = np.linalg.solve(np.eye(y.shape[1]) - h[:, None, None] * jac(t, y), -g[:, :, None])[:, :, 0]
        y = y + step
        if np.abs(step).max() < 1e-12 * (1 + np.abs(y).max()):
            break
    return y


def steps(f, jac, method: str, t, y, end, h):
    """(time, states) after each of the steps about h long; a row's step count is its own, and it stands still when done."""
    n = np.ceil(np.abs(end - t) / h - 1e-9).astype(int)
    step, before = (end - t) / np.maximum(n, 1), None
    for k in range(int(n.max()) if len(n) else 0):
        live = k < n
        at = t + k * step
        if method == "euler":
            new = y + step[:, None] * f(at, y)
        elif method == "rk4":
            s = step[:, None]
            a = f(at, y)
            b = f(at + step / 2, y + s / 2 * a)
            c = f(at + step / 2, y + s / 2 * b)
            d = f(at + step, y + s * c)
            new = y + s / 6 * (a + 2 * b + 2 * c + d)
        elif method == "rk45":
            new = rk45(f, np.where(live, at, end), y, np.where(live, at + step, end), np.full(len(t), h))
        elif method == "bdf2" and before is not None:
            new = _newton(f, jac, at + step, y, (4 * y - before) / 3, 2 * step / 3)
        else:
            new = _newton(f, jac, at + step, y, y, step)
        before, y = y, np.where(live[:, None], new, y)
        yield np.where(live, at + step, end), y


def _batched(nodes, t0, y0, t_end, h, method, whole: bool = False) -> Column:
    """The states at the end, or all [t, y..] rows; the distinct rows of a batch step together, some thousand at a time."""

    @F.pandas_udf("array<array<double>>" if whole else "array<double>")
    def run(t: pd.Series, end: pd.Series, y: pd.Series) -> pd.Series:
        t, end = t.to_numpy(float), end.to_numpy(float)
        y = np.stack([np.asarray(v, float) for v in y]) if len(y) else np.zeros((0, len(nodes)))
        f = _numeric(nodes)
        jac = (jacobian(nodes) or _differences(f)) if method in ("implicit_euler", "bdf2") else None
        at, back = distinct([t, end, *y.T])
        t, end, y = t[at], end[at], y[at]
        out: list = []
        for i in range(0, len(t), 2048):
            a, z, v = t[i : i + 2048], end[i : i + 2048], y[i : i + 2048]
            with np.errstate(all="ignore"):
                if whole:
                    n = np.ceil(np.abs(z - a) / h - 1e-9).astype(int)
                    rows = [np.column_stack([a, v]), *(np.column_stack(x) for x in steps(f, jac, method, a, v, z, h))]
                    out += [[r[k] for r in rows[: n[k] + 1]] for k in range(len(a))]
                    continue
                if method == "rk45":
                    last = rk45(f, a, v, z, np.full(len(a), h))
                else:
                    last = v
                    for _, last in steps(f, jac, method, a, v, z, h):
                        pass
                out += list(np.where((a == z)[:, None], v, last))
        return pd.Series([out[k] for k in back.tolist()], dtype=object)

    return run(t0.cast("double"), t_end.cast("double"), F.array(*(c.cast("double") for c in y0)))


def free_names(equation: str) -> list[str]:
    return [v for v in variables(Session().parse(equation)) if not v.startswith("y[")]
