"""Lowering of syntax trees to Columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions.registry import INVERSE_NAMES
from ..functions.rounding import ECHO, ROUNDING
from ..functions.scalar import BACKWARD, FORWARD, HYPERBOLIC, SIMPLE, from_radians, to_radians
from ..functions.stats import LISTS, TRIMMED
from .calculus import differentiate
from .lexer import SyntaxProblem
from .simplify import simplify
from .tree import Call, Fn, Mat, Node, Num, Text, Var, is_matrix

COMPARISONS = {"<", "<=", ">", ">=", "==", "!="}
WORDS = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "==", "ne": "!="}
VECTORS = {"sort", "mode", "quadratic", "t_root", "autodiffN", "rot"}
#: Nodes of the Gauss-Legendre rule, panels of an integral, and Newton steps of a root.
GAUSS, PANEL, MAX_PANELS, NEWTON = 16, 0.2, 1 << 16, 60
#: Order of derivatives up to which a derivative at a point is symbolic; beyond, jets.
SYMBOLIC = 2
#: Calls whose Columns use their arguments outside of lambdas, where batches may stand.
OPEN = {"+", "-", "*", "/", "^", "pow", "if", "&&", "||", "square", "cube", "sqrt", "abs", "exp", "ln", "intg", "root", "autodiff"} | COMPARISONS | WORDS.keys()


class Lowering:
    """Turns trees into Columns, with the values of variables in ``env``; ``outer`` where what iterates may become a batch, which a lambda can't hold."""

    def __init__(self, session, env: dict[str, Column], outer: bool = False):
        self.session, self.env, self.outer = session, env, outer

    def inner(self) -> Lowering:
        return Lowering(self.session, self.env)

    def column(self, node: Node) -> Column:
        return self._typed(node)[0]

    def number(self, node: Node) -> Column:
        c, flag = self._typed(node)
        return G.number(c) if flag else c

    def flag(self, node: Node) -> Column:
        c, flag = self._typed(node)
        return c if flag else (c != 0) & ~F.isnan(c)

    def _at(self, node: Node, **env: Column) -> Column:
        return Lowering(self.session, {**self.env, **env}).number(node)

    def _typed(self, x: Node) -> tuple[Column, bool]:
        if isinstance(x, Num):
            return F.lit(x.value), False
        if isinstance(x, Text):
            return F.lit(x.value), False
        if isinstance(x, Var):
            if x.name not in self.env:
                raise SyntaxProblem(f"unknown name {x.name!r}")
            return self.env[x.name], False
        if isinstance(x, Mat):
            if self.outer:
                return self.inner()._typed(x)
            texts = [a for a in x.items if isinstance(a, Text)]
            return F.array(*((self.column(a).cast("string") if texts else self.number(a)) for a in x.items)), False
        if isinstance(x, Fn):
            raise SyntaxProblem("a function is no value")
        name, args = x.name, x.args
        if self.outer and (name not in OPEN or name in self.session.registered or is_matrix(x)):
            return self.inner()._typed(x)
        if name in self.session.registered:
            return self.session.registered[name](*map(self.number, args)), False
        if name in self.session.text_methods:
            from ..session import show

            return self.session.text_methods[name](self.session, *map(show, args)), False
        if name in COMPARISONS or name in WORDS:
            a, b = map(self.number, args)
            return G.compare(WORDS.get(name, name), a, b, isinstance(args[0], Num), isinstance(args[1], Num)), True
        if name in ("&&", "||"):
            a, b = map(self.flag, args)
            return (a & b if name == "&&" else a | b), True
        if is_matrix(x):
            return self.grids().grid(x).array(), False
        return self._number(name, args), False

    def grids(self):
        from .grids import Grids

        return Grids(self.number)

    def _number(self, name: str, args: tuple) -> Column:
        s = self.session
        if name in ("+", "-", "*"):
            a, b = map(self.number, args)
            return a + b if name == "+" else a - b if name == "-" else a * b
        if name == "/":
            a, b = map(self.number, args)
            return a / b if isinstance(args[1], Num) and args[1].value else G.divide(a, b, s.division)
        if name in ("%", "rem", "mod"):
            return G.remainder(*map(self.number, args))
        name = INVERSE_NAMES.get(name, name)
        if name in FORWARD:
            return FORWARD[name](to_radians(self._one(name, args), s.angle))
        if name in BACKWARD:
            return from_radians(BACKWARD[name](self._one(name, args)), s.angle)
        if name in HYPERBOLIC:
            return HYPERBOLIC[name](self._one(name, args))
        if name in LISTS:
            return LISTS[name](self.array(args))
        if name in TRIMMED:
            return TRIMMED[name](self.number(args[0]), self.array(args[1:]))
        if name in ECHO:
            return ECHO[name](*map(self.column, args))
        for table in (SIMPLE, ROUNDING):
            if name in table:
                try:
                    return table[name](*map(self.number, args))
                except TypeError as e:
                    raise SyntaxProblem(f"{name}: {len(args)} arguments") from e
        special = getattr(self, f"_{name}", None)
        if special is None:
            raise SyntaxProblem(f"unknown function {name!r}")
        return special(*args)

    def _one(self, name: str, args: tuple) -> Column:
        if len(args) != 1:
            raise SyntaxProblem(f"{name}: {len(args)} arguments")
        return self.number(args[0])

    def array(self, args: tuple) -> Column:
        """Argument lists; vectors among them are spliced in."""
        vector = lambda a: is_matrix(a) or (isinstance(a, Call) and a.name in VECTORS)
        if any(map(vector, args)):
            return F.flatten(F.array(*(self.column(a) if vector(a) else F.array(self.number(a)) for a in args)))
        return F.array(*map(self.number, args)) if args else F.array().cast("array<double>")

    # -- special forms ----------------------------------------------------
    def _if(self, c, a, b):
        return F.when(self.flag(c), self.number(a)).otherwise(self.number(b))

    def _rnd(self, n=None):
        return F.rand() if n is None else F.rand() * self.number(n)

    def _now(self):
        return F.unix_micros(F.current_timestamp()).cast("double") * 1000

    _nanos = _now

    def _print(self, *args):
        return ECHO["echo"](*map(self.column, args))

    def _help(self):
        return F.lit(math.inf)

    def _det(self, *args):
        from .grids import Grid, determinant

        if len(args) == 1 and is_matrix(args[0]):
            g = self.grids().grid(args[0])
            if g.rows == g.cols:
                return determinant(g)
            cells = g.cells
        else:
            cells = tuple(map(self.grids().cell, args))
        k = math.isqrt(len(cells))
        if k * k != len(cells):
            raise SyntaxProblem("a determinant needs a square number of values")
        return determinant(Grid(k, k, cells))

    def _eigpoly(self, a):
        """The characteristic polynomial as text."""
        from ..operators.matrix import characteristic

        return characteristic(self.grids().grid(a).struct())

    @staticmethod
    def _function(f: Node) -> Fn:
        if not isinstance(f, Fn):
            raise SyntaxProblem("a function is needed")
        return f

    def _derivatives(self, f: Fn, at: Column, order: int) -> Column:
        """Derivatives 0 to order at a point, by jets; by repeated derivation where a function has none."""
        from .jets import Jets, NoJet

        p = f.params[0]
        try:
            return Jets(Lowering(self.session, {**self.env, p: at}), p, at, order).derivatives(f.body, order)
        except NoJet:
            return F.array(*(self._at(self.session.derivative(f, k).body, **{p: at}) for k in range(order + 1)))

    def _autodiff(self, f, x, n=Num(1.0)):  # noqa: B008
        f, order = self._function(f), int(n.value)
        if order <= SYMBOLIC:
            try:
                return self._at(self.session.derivative(f, order).body, **{f.params[0]: self.number(x)})
            except ValueError:
                pass
        from . import batches

        batch = batches.derivative(self, f, x, order)
        if batch is not None:
            return batch
        if self.outer:
            return self.inner()._autodiff(f, x, n)
        return F.get(self._derivatives(f, self.number(x), order), F.lit(order))

    def _autodiffN(self, f, x, n=Num(1.0)):  # noqa: B008, N802
        return self._derivatives(self._function(f), self.number(x), int(n.value))

    def _intg(self, f, a, b, panels=None):
        """Gauss-Legendre panels about PANEL wide; swapped bounds change the sign; NaN where the bounds are too far apart for that."""
        from . import batches

        f = self._function(f)
        batch = batches.integral(self, f, a, b, None if panels is None else int(panels.value), GAUSS, PANEL, MAX_PANELS)
        if batch is not None:
            return batch
        if self.outer:
            return self.inner()._intg(f, a, b, panels)
        lo, hi = self.number(a), self.number(b)
        wanted = F.greatest(F.lit(1.0), F.ceil(F.abs(hi - lo) / PANEL - 1e-9).cast("double"))
        n = F.lit(int(panels.value)) if panels is not None else F.least(F.lit(float(MAX_PANELS)), wanted).cast("int")
        nodes, weights = np.polynomial.legendre.leggauss(GAUSS)

        def panel(width: Column) -> Column:
            def one(total: Column, k: Column) -> Column:
                mid = lo + (k + 0.5) * width
                parts = [self._at(f.body, **{f.params[0]: mid + width * float(t / 2)}) * float(w) for t, w in zip(nodes, weights, strict=True)]
                return total + sum(parts[1:], parts[0]) * width / 2

            return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), one)

        total = G.let((hi - lo) / n, panel)
        return total if panels is not None else F.when(wanted > MAX_PANELS, F.lit(math.nan)).otherwise(total)

    def _root(self, f, x1=Num(1.0), *more):  # noqa: B008
        """Newton from x1; where it does not settle, secant steps from x1 and x2, and then bisection of the nearest change of sign; else NaN."""
        from . import batches

        f = self._function(f)
        p = f.params[0]
        steps = int(more[1].value) if len(more) == 2 else NEWTON
        batch = batches.root(self, f, (x1, *more[:1]), steps)
        if batch is not None:
            return batch
        if self.outer:
            return self.inner()._root(f, x1, *more)
        at = lambda x: self._at(f.body, **{p: x})
        first = self.number(x1)
        second = self.number(more[0]) if more else first + 1.0
        count = F.sequence(F.lit(1), F.lit(steps))
        slope = simplify(differentiate(f.body, p))

        def step(x: Column, _: Column) -> Column:
            move = G.divide(at(x), self._at(slope, **{p: x}))
            return F.when(F.abs(move) <= 5e-16, x).otherwise(x - move)

        def chord(s: Column, _: Column) -> Column:
            fa, fb = at(s["a"]), at(s["b"])
            move = G.divide(fb * (s["b"] - s["a"]), fb - fa)
            still = (s["a"] == s["b"]) | (fb == 0) | F.isnan(move)
            return F.struct(F.when(still, s["a"]).otherwise(s["b"]).alias("a"), F.when(still, s["b"]).otherwise(s["b"] - move).alias("b"))

        def halve(s: Column, _: Column) -> Column:
            mid = (s["a"] + s["b"]) / 2
            return G.let(at(mid) * at(s["a"]) > 0, lambda same: F.struct(F.when(same, mid).otherwise(s["a"]).alias("a"), F.when(same, s["b"]).otherwise(mid).alias("b")))

        def bracket() -> Column:
            # x1 and x2, then ever wider steps to both sides of x1
            reach = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda k: F.pow(F.lit(1.15), k - 40))
            pairs = F.concat(
                F.array(F.struct(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))),
                F.flatten(F.transform(reach, lambda r: F.array(*(F.struct((first + s * r * u).alias("a"), (first + s * r * v).alias("b")) for s, u, v in ((1, 1.0, 1.15), (-1, 1.15, 1.0)))))),
            )
            found = F.filter(pairs, lambda q: F.coalesce(at(q["a"]) * at(q["b"]) <= 0, F.lit(False)) & ~F.isnan(at(q["a"]) * at(q["b"])))
            return F.get(found, F.lit(0))

        def checked(x: Column, otherwise: Column) -> Column:
            return G.let(x, lambda r: F.when(F.coalesce((F.abs(r) < 1e300) & ((at(r) == 0) | (F.abs(G.divide(at(r), self._at(slope, **{p: r}))) <= 1e-9 * (1 + F.abs(r)))), F.lit(False)), r).otherwise(otherwise))

        pair = F.struct(first.alias("a"), second.alias("b"))
        # a change of sign is no pole where the function is small at its end
        small = lambda q, r: F.abs(at(r)) <= 1e-3 * F.greatest(F.abs(at(q["a"])), F.abs(at(q["b"])))
        last = G.let(bracket(), lambda q: G.let(F.aggregate(F.sequence(F.lit(1), F.lit(200)), q, halve)["a"], lambda r: F.when(F.coalesce(small(q, r), F.lit(False)), r).otherwise(F.lit(math.nan))))
        return checked(F.aggregate(count, first, step), checked(F.aggregate(count, pair, chord)["b"], last))

    def _ode(self, name: str, args: tuple):
        from ..operators.ode import formula_call

        return formula_call(self, name, args)

    def _diffeqn(self, *args):
        return self._ode("diffeqn", args)

    def _diffeqnHO(self, *args):  # noqa: N802
        return self._ode("diffeqnHO", args)

    def _diffeqnPath(self, *args):  # noqa: N802
        return self._ode("diffeqnPath", args)

    def _diffeqnPathHO(self, *args):  # noqa: N802
        return self._ode("diffeqnPathHO", args)

    def _rot(self, *args):
        """Points (n x 3), or a line by two points, turned about the line through an origin along a direction: the points by rows."""
        from ..operators.geometry import rotate

        *what, angle, origin, direction = args
        o, d = (tuple(self.grids().grid(x).columns()) for x in (origin, direction))
        rows = [c for x in what for c in self.grids().grid(x).columns()]
        turned = [rotate(tuple(rows[i : i + 3]), self.number(angle), o, d, self.session.angle) for i in range(0, len(rows), 3)]
        return F.array(*(c for point in turned for c in point))

    def coefficients(self, f: Fn, degree: int) -> list[Column]:
        """Of the polynomial that f is, constant first, from its derivatives at 0."""
        return [self._at(self.session.derivative(f, k).body, **{f.params[0]: F.lit(0.0)}) / math.factorial(k) for k in range(degree + 1)]

    def _quadratic(self, f):
        from ..operators.roots import quadratic_roots

        c, b, a = self.coefficients(self._function(f), 2)
        return quadratic_roots(a, b, c)

    def _t_root(self, f):
        from ..operators.roots import depressed_cubic_roots

        c0, c1, _, c3 = self.coefficients(self._function(f), 3)
        return depressed_cubic_roots(c1 / c3, c0 / c3)
