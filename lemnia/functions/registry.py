"""Names of all built-in functions."""

from __future__ import annotations

from ..plans.tree import MATRIX_CALLS
from .rounding import ECHO, ROUNDING
from .scalar import BACKWARD, FORWARD, HYPERBOLIC, SIMPLE
from .stats import LISTS, TRIMMED

#: Functions lowered from their syntax rather than from argument Columns.
SPECIAL = {"if", "diff", "autodiff", "autodiffN", "intg", "root", "quadratic", "t_root", "rnd", "now", "nanos", "det", "gt", "lt", "ge", "le", "eq", "ne", "rem", "mod", "print", "help", "eigpoly", "diffeqn", "diffeqnHO", "diffeqnPath", "diffeqnPathHO", "rot"} | MATRIX_CALLS
INVERSE_NAMES = {f"{f}-¹": f"a{f}" for f in (*FORWARD, "sinh", "cosh", "tanh", "sech", "csch", "coth")}
BUILTIN = {*FORWARD, *BACKWARD, *HYPERBOLIC, *SIMPLE, *ROUNDING, *ECHO, *LISTS, *TRIMMED, *SPECIAL, *INVERSE_NAMES} - {"^", "Č", "Р"}
