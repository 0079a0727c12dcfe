"""Taylor coefficients of formulas as array Columns: derivatives of any order without growing trees.

A jet holds f(x), f'(x), f''(x)/2!, .. up to an order.  Each operation is the
textbook recurrence over the jets of its arguments, as a fold over the order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import let
from ..functions.scalar import from_radians, to_radians
from .tree import Call, Node, Num, Var, variables


class NoJet(ValueError):
    """A function without a recurrence here."""


class Jets:
    def __init__(self, lowering, name: str, x: Column, order: int):
        self.low, self.name, self.x, self.n = lowering, name, x, max(1, order)

    def of(self, node: Node) -> Column:
        if isinstance(node, Var) and node.name == self.name:
            return self._line(self.x, F.lit(1.0))
        if self.name not in variables(node):
            return self._line(self.low.number(node), F.lit(0.0))
        if not isinstance(node, Call):
            raise NoJet(node)
        a, name = node.args, node.name
        if name in ("+", "-"):
            return F.zip_with(self.of(a[0]), self.of(a[1]), (lambda p, q: p + q) if name == "+" else (lambda p, q: p - q))
        if name == "if":
            return F.when(self.low.flag(a[0]), self.of(a[1])).otherwise(self.of(a[2]))
        if name == "*" and isinstance(a[0], Num):
            return self._scaled(self.of(a[1]), F.lit(a[0].value))
        if name in ("*", "/"):
            return let(self.of(a[0]), lambda p: let(self.of(a[1]), lambda q: self._times(p, q) if name == "*" else self._over(p, q)))
        if name in ("^", "pow"):
            if self.name not in variables(a[1]):
                return let(self.of(a[0]), lambda u: self._power(u, a[1]))
            return let(self.of(Call("*", (a[1], Call("ln", (a[0],))))), self._exp)
        if name == "log" and len(a) == 2:
            return self.of(Call("/", (Call("ln", (a[0],)), Call("ln", (a[1],)))))
        if len(a) != 1:
            raise NoJet(name)
        return let(self.of(a[0]), lambda u: self._function(name, u))

    # -- series -----------------------------------------------------------
    def _line(self, first: Column, second: Column) -> Column:
        return F.concat(F.array(first, second), F.array_repeat(F.lit(0.0), self.n - 1))

    def _fold(self, first: Column, step: Callable[[Column, Column], Column]) -> Column:
        """step(coefficients so far, k) for k of 1 to the order."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.n)), F.array(first), lambda acc, k: F.concat(acc, F.array(step(acc, k))))

    @staticmethod
    def _sum(first: int, k: Column, term: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter(F.sequence(F.lit(0), k), lambda j: j >= first), F.lit(0.0), lambda s, j: s + term(j))

    @staticmethod
    def _scaled(u: Column, by: Column) -> Column:
        return F.transform(u, lambda v: v * by)

    def _times(self, p: Column, q: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.n)), lambda k: self._sum(0, k, lambda j: F.get(p, j) * F.get(q, k - j)))

    def _over(self, p: Column, q: Column) -> Column:
        head = F.get(q, F.lit(0))
        return self._fold(self._div(F.get(p, F.lit(0)), head), lambda c, k: self._div(F.get(p, k) - self._sum(1, k, lambda j: F.get(q, j) * F.get(c, k - j)), head))

    @staticmethod
    def _div(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(math.nan)).otherwise(a / b)

    def _exp(self, u: Column) -> Column:
        return self._fold(F.exp(F.get(u, F.lit(0))), lambda e, k: self._sum(1, k, lambda j: j * F.get(u, j) * F.get(e, k - j)) / k)

    def _ln(self, u: Column) -> Column:
        head = F.get(u, F.lit(0))
        start = F.when(head > 0, F.ln(head)).otherwise(F.lit(math.nan))
        return self._fold(start, lambda c, k: self._div(F.get(u, k) - self._sum(1, k - 1, lambda j: j * F.get(c, j) * F.get(u, k - j)) / k, head))

    def _power(self, u: Column, exponent: Node) -> Column:
        if isinstance(exponent, Num) and exponent.value == int(exponent.value) and 0 <= exponent.value <= 64:
            n = int(exponent.value)
            if n == 0:
                return self._line(F.lit(1.0), F.lit(0.0))
            if n == 1:
                return u
            half = lambda h: self._times(h, h)
            if n % 2 == 0:
                return let(self._power(u, Num(n / 2)), half)
            return let(let(self._power(u, Num(n // 2)), half), lambda h: self._times(h, u))
        r = self.low.number(exponent)
        head = F.get(u, F.lit(0))
        start = F.pow(head, r)
        return self._fold(start, lambda p, k: self._div(self._sum(1, k, lambda j: (r * j - (k - j)) * F.get(u, j) * F.get(p, k - j)), head) / k)

    def _pair(self, u: Column, first: Column, second: Column, sign: float) -> Column:
        """Two series with a' = b u' and b' = sign a u'."""

        def step(acc: Column, k: Column) -> Column:
            a = self._sum(1, k, lambda j: j * F.get(u, j) * F.get(acc["b"], k - j)) / k
            b = sign * self._sum(1, k, lambda j: j * F.get(u, j) * F.get(acc["a"], k - j)) / k
            return F.struct(F.concat(acc["a"], F.array(a)).alias("a"), F.concat(acc["b"], F.array(b)).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.n)), F.struct(F.array(first).alias("a"), F.array(second).alias("b")), step)

    def _integral(self, start: Column, u: Column, slope: Callable[[Column], Column]) -> Column:
        """start + the integral of slope(u) u'."""
        rise = F.concat(F.transform(F.sequence(F.lit(1), F.lit(self.n)), lambda k: k * F.get(u, k)), F.array(F.lit(0.0)))
        d = let(slope(u), lambda s: let(rise, lambda r: self._times(s, r)))
        return let(d, lambda v: F.concat(F.array(start), F.transform(F.sequence(F.lit(1), F.lit(self.n)), lambda k: F.get(v, k - 1) / k)))

    def _shifted(self, u: Column, by: float, factor: float = 1.0) -> Column:
        """by + factor u."""
        return F.transform(u, lambda v, i: F.when(i == 0, F.lit(by)).otherwise(F.lit(0.0)) + factor * v)

    def _function(self, name: str, u: Column) -> Column:
        from ..functions.registry import INVERSE_NAMES

        name = {"ln-¹": "exp", "aln": "exp", "log": "lg"}.get(name, INVERSE_NAMES.get(name, name))
        unit, head = self.low.session.angle, F.get(u, F.lit(0))
        if name in ("sin", "cos", "tan", "sec", "csc", "cot"):
            return let(self._scaled(u, to_radians(F.lit(1.0), unit)), lambda v: let(self._pair(v, F.sin(F.get(v, F.lit(0))), F.cos(F.get(v, F.lit(0))), -1.0), lambda p: self._ratio(name, p["a"], p["b"])))
        if name in ("sinh", "cosh", "tanh", "sech", "csch", "coth"):
            return let(self._pair(u, F.sinh(head), F.cosh(head), 1.0), lambda p: self._ratio({"sinh": "sin", "cosh": "cos", "tanh": "tan", "sech": "sec", "csch": "csc", "coth": "cot"}[name], p["a"], p["b"]))
        simple = {"exp": self._exp, "ln": self._ln, "square": lambda v: self._times(v, v), "cube": lambda v: self._power(v, Num(3.0)), "sqrt": lambda v: self._power(v, Num(0.5)), "inverse": lambda v: self._over(self._line(F.lit(1.0), F.lit(0.0)), v), "lg": lambda v: self._scaled(self._ln(v), F.lit(1 / math.log(10))), "abs": lambda v: self._scaled(v, F.signum(head))}
        if name in simple:
            return simple[name](u)
        if name == "cbrt":
            return let(self._scaled(u, F.signum(head)), lambda v: self._scaled(self._power(v, Num(1 / 3)), F.signum(head)))
        one_plus = lambda v, sign: let(self._times(v, v), lambda s: self._shifted(s, 1.0, sign))
        root = lambda s: self._power(s, Num(-0.5))
        slopes = {
            "atan": (F.atan(head), lambda v: let(one_plus(v, 1.0), lambda s: self._power(s, Num(-1.0)))), "asin": (F.asin(head), lambda v: let(one_plus(v, -1.0), root)),
            "acos": (F.acos(head), lambda v: self._scaled(let(one_plus(v, -1.0), root), F.lit(-1.0))), "asinh": (F.asinh(head), lambda v: let(one_plus(v, 1.0), root)),
            "acosh": (F.acosh(head), lambda v: let(let(self._times(v, v), lambda s: self._shifted(s, -1.0)), root)), "atanh": (F.atanh(head), lambda v: let(one_plus(v, -1.0), lambda s: self._power(s, Num(-1.0)))),
        }
        if name in slopes:
            start, slope = slopes[name]
            out = self._integral(start, u, slope)
            return self._scaled(out, from_radians(F.lit(1.0), unit)) if name in ("atan", "asin", "acos") else out
        if name == "erf":
            from ..functions.scalar import SIMPLE

            return self._integral(SIMPLE["erf"](head), u, lambda v: self._scaled(let(let(self._times(v, v), lambda s: self._scaled(s, F.lit(-1.0))), self._exp), F.lit(2 / math.sqrt(math.pi))))
        raise NoJet(name)

    def _ratio(self, name: str, s: Column, c: Column) -> Column:
        one = self._line(F.lit(1.0), F.lit(0.0))
        return {"sin": lambda: s, "cos": lambda: c, "tan": lambda: self._over(s, c), "cot": lambda: self._over(c, s), "sec": lambda: self._over(one, c), "csc": lambda: self._over(one, s)}[name]()

    def derivatives(self, node: Node, order: int) -> Column:
        """[f, f', f'', ..] up to the order, at x."""
        scaled = F.transform(self.of(node), lambda c, k: c * F.aggregate(F.sequence(F.lit(0), k), F.lit(1.0), lambda a, j: a * F.when(j == 0, F.lit(1.0)).otherwise(j.cast("double"))))
        return F.slice(scaled, F.lit(1), F.lit(order + 1))
