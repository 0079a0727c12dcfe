"""Scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import INF, NAN, divide, let, ln, log10

#: Factors from an angle unit to radians.
UNIT = {"RAD": 1.0, "DEG": math.pi / 180, "GRAD": math.pi / 200}


def to_radians(x: Column, unit: str) -> Column:
    return x if unit == "RAD" else x * F.lit(UNIT[unit])


def from_radians(x: Column, unit: str) -> Column:
    return x if unit == "RAD" else x / F.lit(UNIT[unit])


def one_over(x: Column) -> Column:
    return divide(F.lit(1.0), x)


FORWARD = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "sec": lambda x: one_over(F.cos(x)), "csc": lambda x: one_over(F.sin(x)), "cot": lambda x: one_over(F.tan(x)),
}
BACKWARD = {
    "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "asec": lambda x: F.acos(one_over(x)), "acsc": lambda x: F.asin(one_over(x)), "acot": lambda x: F.atan(one_over(x)),
}


def asinh(x: Column) -> Column:
    return F.signum(x) * F.ln(F.abs(x) + F.sqrt(x * x + 1))


def acosh(x: Column) -> Column:
    return F.when(x >= 1, F.ln(F.greatest(x, F.lit(1.0)) + F.sqrt(F.greatest(x * x - 1, F.lit(0.0))))).when(x < 1, F.lit(NAN))


def atanh(x: Column) -> Column:
    return F.when(F.abs(x) < 1, 0.5 * F.ln((1 + x) / F.when(x == 1, F.lit(1.0)).otherwise(1 - x))).otherwise(F.lit(NAN))


HYPERBOLIC = {
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "sech": lambda x: one_over(F.cosh(x)), "csch": lambda x: one_over(F.sinh(x)), "coth": lambda x: one_over(F.tanh(x)),
    "asinh": asinh, "acosh": acosh, "atanh": atanh,
    "asech": lambda x: acosh(one_over(x)), "acsch": lambda x: asinh(one_over(x)), "acoth": lambda x: atanh(one_over(x)),
}

_FACT = [float(math.factorial(k)) for k in range(171)]
#: Lanczos coefficients for g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def fact(x: Column) -> Column:
    """Table for whole numbers to 170; gamma of x + 1 between; -inf for negative whole numbers, NaN for other negative ones."""
    whole = x == F.floor(x)
    table = F.element_at(F.array(*map(F.lit, _FACT)), F.least(F.greatest(x, F.lit(0.0)), F.lit(170.0)).cast("int") + 1)
    s = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        s = s + F.lit(c) / (F.greatest(x, F.lit(0.0)) + k)
    t = F.greatest(x, F.lit(0.0)) + 7.5
    gamma = math.sqrt(2 * math.pi) * F.exp((F.greatest(x, F.lit(0.0)) + 0.5) * F.ln(t) - t) * s
    return F.when(F.isnan(x), x).when(x > 170.6, F.lit(INF)).when(whole & (x < 0), F.lit(-INF)).when(x < 0, F.lit(NAN)).when(whole, table).otherwise(gamma)


def perm(n: Column, r: Column) -> Column:
    return divide(fact(n), fact(n - r))


def comb(n: Column, r: Column) -> Column:
    return divide(fact(n), fact(r) * fact(n - r))


def erf(x: Column) -> Column:
    """Series to |x| = 3, continued fraction beyond; 1e-14 or better."""

    def body(a):
        term, total = a, a
        for k in range(1, 60):
            term = term * (2.0 / (2 * k + 1))
            total = total + term
            term = term * a * a
        return total

    def series(v: Column) -> Column:
        # Horner form of 2 v / sqrt(pi) exp(-v^2) sum (2 v^2)^k / (3 5 .. 2k+1)
        p = F.lit(1.0)
        z = v * v
        for k in range(48, 0, -1):
            p = 1.0 + p * z * (2.0 / (2 * k + 1))
        return (2 / math.sqrt(math.pi)) * v * F.exp(-z) * p

    def tail(v: Column) -> Column:
        f = v
        for k in range(30, 0, -1):
            f = v + (k / 2) / f
        return 1 - F.exp(-v * v) / (math.sqrt(math.pi) * f)

    mag = F.abs(x)
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * let(mag, lambda v: F.when(v < 3, series(v)).when(v > 6, F.lit(1.0)).otherwise(tail(F.greatest(v, F.lit(3.0))))))


def fast_erf(x: Column) -> Column:
    """Rational approximation with five terms and one exponential."""
    #: Coefficients of the published approximation.
    a, p = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429), 0.3275911
    t = 1 / (1 + p * F.abs(x))
    poly = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def swish(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def fast_gelu(x: Column) -> Column:
    return 0.5 * x * (1 + fast_erf(x / math.sqrt(2)))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


SIMPLE = {
    "abs": F.abs, "sqrt": F.sqrt, "cbrt": F.cbrt, "square": lambda x: x * x, "cube": lambda x: x * x * x, "inverse": one_over,
    "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "pow": power, "^": power, "atan2": F.atan2, "hypot": F.hypot,
    "exp": F.exp, "ln-¹": F.exp, "aln": F.exp, "ln": ln, "lg": log10, "lg-¹": lambda x: F.pow(F.lit(10.0), x), "alg": lambda x: F.pow(F.lit(10.0), x),
    "log": lambda x, b=None: log10(x) if b is None else divide(ln(x), ln(b)), "log-¹": lambda x, b=None: F.pow(F.lit(10.0) if b is None else b, x), "alog": lambda x, b: F.pow(b, x),
    "fact": fact, "comb": comb, "perm": perm, "Č": comb, "Р": perm, "erf": erf, "gelu": gelu, "fast_gelu": fast_gelu, "swish": swish,
    "swiglu": lambda x, g=None: x * swish(x if g is None else g), "geglu": lambda x, g=None: x * gelu(x if g is None else g),
    "fma": lambda a, b, c: a * b + c, "vma": lambda a, b, c: a * b + c,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "relu": lambda x: F.when(x > 0, x).otherwise(x * 0.0),
    "silu": swish, "mish": lambda x: x * F.tanh(F.log1p(F.exp(x))),
    "elu": lambda x, a=None: F.when(x > 0, x).otherwise((F.lit(1.0) if a is None else a) * (F.exp(x) - 1)),
    "leaky_relu": lambda x, a=None: F.when(x > 0, x).otherwise((F.lit(0.01) if a is None else a) * x),
    "clip": lambda x, lo, hi: F.least(F.greatest(x, lo), hi),
}
