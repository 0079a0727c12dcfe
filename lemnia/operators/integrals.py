"""Quadrature by sums, and a robust integrator for hard functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lower import Lowering
from ..plans.numeric import evaluate
from ..session import Session


def _at(session: Session, formula: str, name: str, x: Column) -> Column:
    node = session.plan(formula, [name])
    return Lowering(session, {name: x}).number(node)


def trapezoid(formula: str, low: Column, high: Column, n: int, session: Session | None = None, name: str = "x") -> Column:
    s = session or Session()
    h = (high - low) / n
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda a, k: a + _at(s, formula, name, low + k * h)) if n > 1 else F.lit(0.0)
    return h * ((_at(s, formula, name, low) + _at(s, formula, name, high)) / 2 + inner)


def simpson(formula: str, low: Column, high: Column, n: int, session: Session | None = None, name: str = "x") -> Column:
    """n panels, an even number."""
    s = session or Session()
    h = (high - low) / n
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0)) * _at(s, formula, name, low + k * h))
    return h / 3 * (_at(s, formula, name, low) + _at(s, formula, name, high) + inner)


def rectangles(formula: str, low: Column, high: Column, n: int, session: Session | None = None, name: str = "x", end: str = "left") -> Column:
    """n rectangles with their height at the left end, the right end or the middle."""
    s = session or Session()
    h, first = (high - low) / n, {"left": 0.0, "right": 1.0, "middle": 0.5}[end]
    return h * F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda a, k: a + _at(s, formula, name, low + (k + first) * h))


def clenshaw_curtis(formula: str, low: Column, high: Column, n: int = 32, session: Session | None = None, name: str = "x") -> Column:
    """Through the Chebyshev points: exact for polynomials of degree n."""
    s = session or Session()
    k = np.arange(n + 1)
    # the integral of the interpolating Chebyshev series, whose coefficients are cosine sums of the values
    even = np.arange(0, n + 1, 2)
    factor = 2 / (1.0 - even**2) * np.where((even == 0) | (even == n), 0.5, 1.0)
    weights = 2 / n * np.where((k == 0) | (k == n), 0.5, 1.0) * (np.cos(np.pi * np.outer(k, even) / n) * factor).sum(axis=1)
    mid, half = (high + low) / 2, (high - low) / 2
    parts = [_at(s, formula, name, mid + half * float(x)) * float(w) for x, w in zip(np.cos(np.pi * k / n), weights, strict=True)]
    return half * sum(parts[1:], parts[0])


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(15)


def adaptive(f, a: float, b: float, tol: float = 1e-11, depth: int = 45) -> float:
    """Adaptive Gauss-Legendre pairs, which never meet the ends; NaN where they don't settle."""

    def panel(lo, hi):
        v = np.asarray(f((hi - lo) / 2 * _NODES + (hi + lo) / 2), float) * np.ones_like(_NODES)
        return (hi - lo) / 2 * float((_WEIGHTS * v).sum())

    stack, total, open_ = [(a, b, panel(a, b), 0)], 0.0, 0.0
    while stack:
        lo, hi, whole, d = stack.pop()
        mid = (lo + hi) / 2
        left, right = panel(lo, mid), panel(mid, hi)
        off = abs(left + right - whole)
        if off <= tol * (1 + abs(left + right)) or d >= depth or not np.isfinite(off):
            total += left + right
            open_ += off if off > tol * (1 + abs(left + right)) or not np.isfinite(off) else 0.0
        else:
            stack += [(lo, mid, left, d + 1), (mid, hi, right, d + 1)]
    return total if open_ <= 1e-6 * (1 + abs(total)) else math.nan


def poles(f, lo: float, hi: float) -> list[float]:
    """Where a function changes its sign through infinity, in order."""
    x = np.linspace(lo, hi, int(min(1 << 16, max(800, 32 * (hi - lo)))) + 1)
    v = np.asarray(f(x), float) * np.ones_like(x)
    out = [float(p) for p in x[1:-1][np.isinf(v[1:-1])]]
    turn = np.flatnonzero(np.isfinite(v[:-1]) & np.isfinite(v[1:]) & (np.sign(v[:-1]) * np.sign(v[1:]) < 0))
    a, b, va, vb = x[turn].copy(), x[turn + 1].copy(), v[turn].copy(), v[turn + 1].copy()
    first = np.maximum(np.abs(va), np.abs(vb))
    for _ in range(80):
        mid = (a + b) / 2
        w = np.asarray(f(mid), float) * np.ones_like(mid)
        same = np.sign(w) == np.sign(va)
        a, va = np.where(same, mid, a), np.where(same, w, va)
        b, vb = np.where(same, b, mid), np.where(same, vb, w)
    grown = np.maximum(np.where(np.isfinite(va), np.abs(va), np.inf), np.where(np.isfinite(vb), np.abs(vb), np.inf)) > 1e4 * (1 + first)
    return sorted({*out, *((a + b) / 2)[grown].tolist()})


def principal(f, lo: float, hi: float) -> float:
    """The integral, as the principal value at simple poles; NaN where there is none."""
    found = [p for p in poles(f, lo, hi) if lo < p < hi]
    total, at = 0.0, lo
    for k, p in enumerate(found):
        end = found[k + 1] if k + 1 < len(found) else hi
        d = min(p - at, (end - p) / (2 if k + 1 < len(found) else 1))
        total += adaptive(f, at, p - d) if p - d > at else 0.0
        # both sides of a pole together are a tame function
        total += adaptive(lambda t, p=p: np.asarray(f(p + t), float) + np.asarray(f(p - t), float), 0.0, d, 1e-9, 24)
        at = p + d
    return total + (adaptive(f, at, hi) if hi > at else 0.0)


def integrate(formula: str, low: Column, high: Column, session: Session | None = None, name: str = "x") -> Column:
    """The integral per row, in Arrow batches; infinite bounds are mapped to finite ones, and swapped ones change the sign.

    Simple poles inside the bounds give principal values; NaN (null in the
    column) where the integral does not settle.
    """
    node = (session or Session()).plan(formula, [name])

    def one(lo: float, hi: float) -> float:
        if lo > hi:
            return -one(hi, lo)
        f = lambda x: evaluate(node, {name: x})
        if np.isinf(lo) or np.isinf(hi):
            g = lambda u: f(u / (1 - u * u)) * (1 + u * u) / (1 - u * u) ** 2
            to = lambda v: np.sign(v) if np.isinf(v) else (2 * v) / (1 + np.sqrt(1 + 4 * v * v))
            return adaptive(g, to(lo), to(hi))
        return principal(f, lo, hi) if hi > lo else 0.0

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        # equal bounds are integrated once a batch
        known: dict[tuple[float, float], float] = {}
        with np.errstate(all="ignore"):
            return pd.Series([known[k] if k in known else known.setdefault(k, one(*k)) for k in zip(a.tolist(), b.tolist(), strict=True)])

    return run(low.cast("double"), high.cast("double"))
