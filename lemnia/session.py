"""A session: functions, matrices, constants, angle unit, and compilation of formulas."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.registry import BUILTIN
from .plans.antiderive import integral
from .plans.calculus import differentiate
from .plans.lexer import SyntaxProblem
from .plans.lower import SYMBOLIC, Lowering
from .plans.parser import parse, split_statements
from .plans.simplify import simplify
from .plans.tree import Call, Fn, Mat, Node, Num, Text, Var, rewrite, substitute, variables

#: Built-in constants.
CONSTANTS = {"pi": math.pi, "PI": math.pi, "π": math.pi, "e": math.e, "φ": (1 + math.sqrt(5)) / 2}
_ASSIGN = re.compile(r"^\s*([A-Za-z_$θ][\w$θπ]*(?:\s*,\s*[A-Za-z_$θ][\w$θπ]*)*)\s*(\([^=]*\))?\s*=(?!=)(.*)$", re.S)
#: Calls whose function arguments may be given by name.
TAKES_FUNCTION = {"diff", "autodiff", "autodiffN", "intg", "root", "quadratic", "t_root"}


class Session:
    """Holds what formulas may name.  Columns it makes are immutable and safe to use in any plan."""

    def __init__(self, angle: str = "RAD", division: str = "ieee"):
        if angle not in ("RAD", "DEG", "GRAD"):
            raise ValueError(angle)
        self.angle, self.division = angle, division
        self.constants: dict[str, Node] = {k: Num(v) for k, v in CONSTANTS.items()}
        self.functions: dict[str, Fn] = {}
        self.matrices: dict[str, Mat] = {}
        self.registered: dict[str, Callable[..., Column]] = {}
        self.text_methods: dict[str, Callable[..., Column]] = {}

    # -- definitions ------------------------------------------------------
    def register(self, name: str, build: Callable[..., Column]) -> None:
        """A host function of Columns; replaces a built-in of the same name."""
        self.registered[name] = build

    def register_text(self, name: str, build: Callable[..., Column]) -> None:
        """A host method that gets its arguments as formula texts, with this session first; it may compile, bind or read them."""
        self.text_methods[name] = build

    def unregister(self, name: str) -> None:
        self.registered.pop(name, None)
        self.text_methods.pop(name, None)

    def define(self, text: str) -> None:
        """Assignments only, separated by semicolons."""
        for s in split_statements(text):
            if not self._assign(s):
                raise SyntaxProblem(f"no assignment: {s!r}")

    def is_function(self, name: str) -> bool:
        return name in BUILTIN or name in self.functions or name in self.registered or name in self.text_methods

    def parse(self, text: str) -> Node:
        return parse(text, self.is_function)

    def _assign(self, statement: str) -> bool:
        m = _ASSIGN.match(statement)
        if not m:
            return False
        names, head, body = [n.strip() for n in m[1].split(",")], m[2], m[3]
        if head:
            params = [p.strip() for p in head[1:-1].split(",")]
            if all(re.fullmatch(r"\d+", p) for p in params):
                self.matrices[names[0]] = self.parse(f"@({','.join(params)}){body.strip()}")
            else:
                self.functions[names[0]] = Fn(tuple(params), self.bind(self.parse(body), set(params)))
            return True
        value = self.bind(self.parse(body))
        for n in names:
            for kind in (self.functions, self.matrices, self.constants):
                kind.pop(n, None)
            target = self.functions if isinstance(value, Fn) else self.matrices if isinstance(value, Mat) else self.constants
            target[n] = value
        return True

    # -- binding ----------------------------------------------------------
    def bind(self, node: Node, free: Iterable[str] = ()) -> Node:
        """Constants and user functions inlined, derivatives taken; free names stay variables."""
        free = set(free)

        def visit(x: Node) -> Node:
            if isinstance(x, Var) and x.name not in free:
                return self.constants.get(x.name, self.matrices.get(x.name, x))
            if isinstance(x, Call) and x.name not in self.registered and x.name not in self.text_methods:
                if x.name in self.functions:
                    return self.apply(self.functions[x.name], x.args)
                if x.name == "diff" and len(x.args) in (1, 2, 3):
                    return self._diff(x)
                if x.name == "intg" and len(x.args) == 1 and isinstance(x.args[0], Fn):
                    return self.antiderivative(x.args[0])
            return x

        def named(x: Node) -> Node:
            # the first argument of calculus calls names a function
            if isinstance(x, Call) and x.name in TAKES_FUNCTION and x.args and isinstance(x.args[0], Var | Text):
                key = x.args[0].name if isinstance(x.args[0], Var) else x.args[0].value
                if key in self.functions:
                    return Call(x.name, (self.functions[key], *x.args[1:]))
            return x

        return rewrite(rewrite(node, named), visit)

    @staticmethod
    def apply(fn: Fn, args: tuple) -> Node:
        if len(fn.params) != len(args):
            raise SyntaxProblem(f"{len(fn.params)} arguments wanted, {len(args)} given")
        return substitute(fn.body, dict(zip(fn.params, args, strict=True)))

    def _diff(self, x: Call) -> Node:
        f = x.args[0]
        if not isinstance(f, Fn):
            raise SyntaxProblem("diff needs a function")
        if len(x.args) == 3 and isinstance(x.args[1], Var | Text) and isinstance(x.args[2], Num) and not isinstance(x.args[1], Num):
            name = x.args[1].name if isinstance(x.args[1], Var) else x.args[1].value
            if isinstance(x.args[1], Text):
                self.functions[name] = self.derivative(f, int(x.args[2].value))
                return self.functions[name]
        n = int(x.args[-1].value) if len(x.args) > 1 else 1
        if len(x.args) == 3 and n > SYMBOLIC:
            return Call("autodiff", (f, x.args[1], Num(float(n))))
        d = self.derivative(f, n)
        return self.apply(d, (x.args[1],)) if len(x.args) == 3 else d

    @staticmethod
    def derivative(f: Fn, n: int = 1, param: str | None = None) -> Fn:
        body = f.body
        for _ in range(n):
            body = simplify(differentiate(body, param or f.params[0]))
        return Fn(f.params, body)

    def antiderivative(self, f: Fn | str) -> Fn:
        """A function whose derivative f is, by rules; raises ValueError where none applies."""
        f = self.functions[f] if isinstance(f, str) else f
        return Fn(f.params, integral(f.body, f.params[0]))

    # -- compilation ------------------------------------------------------
    def plan(self, text: str, columns: Iterable[str] = ()) -> Node:
        """Assignments run first; exactly one value statement is kept, none or several give 0."""
        values = [s for s in split_statements(text) if not self._assign(s)]
        if len(values) != 1:
            return Num(0.0)
        node = self.bind(self.parse(values[0]), columns)
        if isinstance(node, Call) and node.name in self.functions:
            node = self.bind(node, columns)
        return simplify(node)

    def compile(self, text: str, columns: Iterable[str] | None = None, values: dict[str, Column] | None = None) -> Column:
        """The formula as one Column; variables are columns of their name, unknown ones 0 if ``columns`` is given."""
        node = self.plan(text, columns or ())
        env = dict(values or {})
        for name in variables(node):
            if name not in env:
                env[name] = F.col(name).cast("double") if columns is None or name in set(columns) else F.lit(0.0)
        return Lowering(self, env, outer=True).column(node)

    def variables(self, text: str) -> list[str]:
        return variables(self.plan(text))

    # -- storage ----------------------------------------------------------
    def dump(self) -> str:
        """The definitions as JSON text."""
        return json.dumps({"angle": self.angle, "division": self.division, "functions": {k: _show(v) for k, v in self.functions.items()}, "matrices": {k: _show(v) for k, v in self.matrices.items()}, "constants": {k: _show(v) for k, v in self.constants.items() if k not in CONSTANTS}})

    @staticmethod
    def load(text: str) -> Session:
        d = json.loads(text)
        s = Session(d["angle"], d["division"])
        for kind in ("constants", "matrices", "functions"):
            for k, v in d[kind].items():
                s.define(f"{k}={v}")
        return s


def _show(node: Node) -> str:
    if isinstance(node, Num):
        return f"({node.value!r})"
    if isinstance(node, Var):
        return node.name
    if isinstance(node, Text):
        return f'"{node.value}"'
    if isinstance(node, Fn):
        return f"@({','.join(node.params)}){_show(node.body)}"
    if isinstance(node, Mat):
        return f"@({node.rows},{node.cols})({','.join(map(_show, node.items))})"
    if len(node.args) == 2 and not node.name[0].isalpha():
        return f"({_show(node.args[0])}{node.name}{_show(node.args[1])})"
    return f"{node.name}({','.join(map(_show, node.args))})"


show = _show
