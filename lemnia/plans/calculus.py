"""Symbolic derivatives on syntax trees."""

from __future__ import annotations

import math

from .simplify import ONE, ZERO, _step, drop_zero_products
from .tree import Call, Node, Num, Var, call, rewrite, variables


def _mul(a: Node, b: Node) -> Node:
    return call("*", a, b)


def _over(a: Node, b: Node) -> Node:
    return call("/", a, b)


def _neg(a: Node) -> Node:
    return _mul(Num(-1.0), a)


_SQ = lambda u: call("square", u)
_MINUS1 = lambda u: call("-", ONE, _SQ(u))
#: Derivative of each function of one argument, as a tree over that argument.
RULES = {
    "sin": lambda u: call("cos", u),
    "cos": lambda u: _neg(call("sin", u)),
    "tan": lambda u: _over(ONE, _SQ(call("cos", u))),
    "sec": lambda u: _mul(call("sec", u), call("tan", u)),
    "csc": lambda u: _neg(_mul(call("csc", u), call("cot", u))),
    "cot": lambda u: _neg(_over(ONE, _SQ(call("sin", u)))),
    "asin": lambda u: _over(ONE, call("sqrt", _MINUS1(u))),
    "acos": lambda u: _neg(_over(ONE, call("sqrt", _MINUS1(u)))),
    "atan": lambda u: _over(ONE, call("+", ONE, _SQ(u))),
    "sinh": lambda u: call("cosh", u),
    "cosh": lambda u: call("sinh", u),
    "tanh": lambda u: _over(ONE, _SQ(call("cosh", u))),
    "sech": lambda u: _neg(_mul(call("sech", u), call("tanh", u))),
    "csch": lambda u: _neg(_mul(call("csch", u), call("coth", u))),
    "coth": lambda u: _neg(_over(ONE, _SQ(call("sinh", u)))),
    "asinh": lambda u: _over(ONE, call("sqrt", call("+", _SQ(u), ONE))),
    "acosh": lambda u: _over(ONE, call("sqrt", call("-", _SQ(u), ONE))),
    "atanh": lambda u: _over(ONE, _MINUS1(u)),
    "exp": lambda u: call("exp", u),
    "ln": lambda u: _over(ONE, u),
    "lg": lambda u: _over(Num(1 / math.log(10)), u),
    "sqrt": lambda u: _over(Num(0.5), call("sqrt", u)),
    "cbrt": lambda u: _over(Num(1 / 3), _SQ(call("cbrt", u))),
    "square": lambda u: _mul(Num(2.0), u),
    "cube": lambda u: _mul(Num(3.0), _SQ(u)),
    "inverse": lambda u: _neg(_over(ONE, _SQ(u))),
    "abs": lambda u: _over(u, call("abs", u)),
    "erf": lambda u: _mul(Num(2 / math.sqrt(math.pi)), call("exp", _neg(_SQ(u)))),
}
ALIASES = {"ln-¹": "exp", "aln": "exp", "log": "lg", **{f"{f}-¹": f"a{f}" for f in ("sin", "cos", "tan", "sinh", "cosh", "tanh")}}


def register_rule(name: str, rule) -> None:
    """rule(argument) -> tree of the derivative by the argument."""
    RULES[name] = rule


def differentiate(node: Node, by: str) -> Node:
    return rewrite(rewrite(_d(node, by), drop_zero_products), lambda x: _step(drop_zero_products(_step(x))))


def _d(x: Node, by: str) -> Node:
    if isinstance(x, Var):
        return ONE if x.name == by else ZERO
    if by not in variables(x):
        return ZERO
    if not isinstance(x, Call):
        raise ValueError("only numeric expressions have derivatives")
    a = x.args
    name = ALIASES.get(x.name, x.name) if len(a) == 1 else x.name
    if name in ("+", "-"):
        return call(name, _d(a[0], by), _d(a[1], by))
    if name == "*":
        return call("+", _mul(_d(a[0], by), a[1]), _mul(a[0], _d(a[1], by)))
    if name == "/":
        return _over(call("-", _mul(_d(a[0], by), a[1]), _mul(a[0], _d(a[1], by))), _SQ(a[1]))
    if name in ("^", "pow"):
        if by not in variables(a[1]):
            return _mul(_mul(a[1], call("pow", a[0], _step(call("-", a[1], ONE)))), _d(a[0], by))
        grow = call("+", _mul(_d(a[1], by), call("ln", a[0])), _over(_mul(a[1], _d(a[0], by)), a[0]))
        return _mul(x, grow)
    if name == "log" and len(a) == 2:
        return _d(_over(call("ln", a[0]), call("ln", a[1])), by)
    if name == "atan2":
        return _over(call("-", _mul(a[1], _d(a[0], by)), _mul(a[0], _d(a[1], by))), call("+", _SQ(a[0]), _SQ(a[1])))
    if name == "hypot":
        return _over(call("+", _mul(a[0], _d(a[0], by)), _mul(a[1], _d(a[1], by))), x)
    if name == "if":
        return call("if", a[0], _d(a[1], by), _d(a[2], by))
    if name in RULES:
        return _mul(RULES[name](a[0]), _d(a[0], by))
    raise ValueError(f"no derivative rule for {name}")
