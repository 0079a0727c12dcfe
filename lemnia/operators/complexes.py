"""Complex numbers as struct<re, im> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import divide, let, ln


def make(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def from_polar(size: Column, angle: Column) -> Column:
    return make(size * F.cos(angle), size * F.sin(angle))


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conjugate(a: Column) -> Column:
    return make(a["re"], -a["im"])


def divide_by(a: Column, b: Column) -> Column:
    """a / b; NaN or infinite by zero, as for real numbers."""
    d = b["re"] * b["re"] + b["im"] * b["im"]
    return let(multiply(a, conjugate(b)), lambda p: make(divide(p["re"], d), divide(p["im"], d)))


def size(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column) -> Column:
    """-pi to pi; 0 for 0."""
    return F.atan2(a["im"], a["re"])


def exp(a: Column) -> Column:
    return from_polar(F.exp(a["re"]), a["im"])


def log(a: Column) -> Column:
    """The principal logarithm."""
    return make(ln(size(a)), angle(a))


def sqrt(a: Column) -> Column:
    return from_polar(F.sqrt(size(a)), angle(a) / 2)


def power(a: Column, n: Column) -> Column:
    """a to a real power; 0 to a positive one is 0."""
    return F.when(size(a) == 0, make(F.pow(F.lit(0.0), n), F.lit(0.0))).otherwise(from_polar(F.pow(size(a), n), angle(a) * n))


def sin(a: Column) -> Column:
    return make(F.sin(a["re"]) * F.cosh(a["im"]), F.cos(a["re"]) * F.sinh(a["im"]))


def cos(a: Column) -> Column:
    return make(F.cos(a["re"]) * F.cosh(a["im"]), -F.sin(a["re"]) * F.sinh(a["im"]))


def tan(a: Column) -> Column:
    return divide_by(sin(a), cos(a))


def polynomial(coefficients: list[Column], z: Column) -> Column:
    """Of real coefficients, the highest power first, by Horner's rule."""
    out = make(coefficients[0].cast("double"), F.lit(0.0))
    for c in coefficients[1:]:
        out = add(multiply(out, z), make(c.cast("double"), F.lit(0.0)))
    return out
