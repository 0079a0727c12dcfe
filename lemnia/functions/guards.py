"""IEEE arithmetic under ANSI mode: no formula raises for a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def divide(a: Column, b: Column, rule: str = "ieee") -> Column:
    """a / b; by zero: infinity of a's sign and NaN for 0/0, or always infinity under the "interpreter" rule."""
    zero = F.lit(INF) if rule == "interpreter" else a * F.lit(INF)
    return F.when(b == 0, zero).otherwise(a / b)


def remainder(a: Column, b: Column) -> Column:
    """Sign of the dividend; NaN by zero."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a % b)


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))


def compare(op: str, a: Column, b: Column, a_plain: bool = False, b_plain: bool = False) -> Column:
    """NaN is unequal to everything and compares false; plain sides can't be NaN."""
    raw = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    for side, plain in ((a, a_plain), (b, b_plain)):
        if not plain:
            raw = raw | F.isnan(side) if op == "!=" else raw & ~F.isnan(side)
    return raw


def number(flag: Column) -> Column:
    return F.when(flag, F.lit(1.0)).when(~flag, F.lit(0.0))
