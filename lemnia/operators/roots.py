"""Closed-form polynomial roots."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import NAN, divide, let


def _bound(body, **values: Column) -> Column:
    """body of the values as doubles, each computed once."""
    return let(F.struct(*(v.cast("double").alias(k) for k, v in values.items())), lambda s: body(*(s[k] for k in values)))


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """[r1, r2] for real roots, [re, im, re, im, 1] for complex ones, [root, NaN] if a is 0."""

    def real(a: Column, b: Column, c: Column, d: Column) -> Column:
        return let(-0.5 * (b + F.when(b < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.sqrt(d)), lambda q: F.array(divide(q, a), divide(c, q)))

    def by(a: Column, b: Column, c: Column, d: Column) -> Column:
        complex_ = _bound(lambda re, im: F.array(re, im, re, -im, F.lit(1.0)), re=divide(-b, 2 * a), im=divide(F.sqrt(F.abs(d)), 2 * F.abs(a)))
        return F.when(F.abs(a) < 1e-300, F.array(divide(-c, b), F.lit(NAN))).when(d >= 0, real(a, b, c, d)).otherwise(complex_)

    return _bound(lambda a, b, c: let(b * b - 4 * a * c, lambda d: by(a, b, c, d)), a=a, b=b, c=c)


def depressed_cubic_roots(p: Column, q: Column) -> Column:
    """[re, im] x 3 and a flag (0: all real, 2: two complex) of x^3 + p x + q."""

    def one(u: Column, v: Column) -> Column:
        return F.array(u + v, F.lit(0.0), -(u + v) / 2, (u - v) * (math.sqrt(3) / 2), -(u + v) / 2, (v - u) * (math.sqrt(3) / 2), F.lit(2.0))

    def three(r: Column, angle: Column) -> Column:
        return F.array(*(x for k in range(3) for x in (2 * r * F.cos(angle - 2 * math.pi * k / 3), F.lit(0.0))), F.lit(0.0))

    def by(p: Column, q: Column, d: Column) -> Column:
        s = F.sqrt(F.greatest(d, F.lit(0.0)))
        angle = lambda r: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), divide(-q / 2, r * r * r)))) / 3
        real = let(F.sqrt(F.greatest(-p / 3, F.lit(0.0))), lambda r: let(angle(r), lambda w: three(r, w)))
        return F.when((p == 0) & (q == 0), F.array(*[F.lit(0.0)] * 7)).when(d > 0, _bound(one, u=F.cbrt(-q / 2 + s), v=F.cbrt(-q / 2 - s))).otherwise(real)

    return _bound(lambda p, q: let(q * q / 4 + p * p * p / 27, lambda d: by(p, q, d)), p=p, q=q)


def cubic_roots(a: Column, b: Column, c: Column, d: Column) -> Column:
    """[re, im] x 3 and the flag of depressed_cubic_roots of a x^3 + b x^2 + c x + d; of a quadratic, [re, im] x 2 and NaN, if a is 0."""

    def by(a: Column, b: Column, c: Column, d: Column) -> Column:
        p = divide(c, a) - divide(b * b, 3 * a * a)
        q = divide(2 * b * b * b, 27 * a * a * a) - divide(b * c, 3 * a * a) + divide(d, a)
        moved = let(divide(b, 3 * a), lambda shift: F.transform(depressed_cubic_roots(p, q), lambda v, i: F.when((i % 2 == 0) & (i < 6), v - shift).otherwise(v)))
        two = let(quadratic_roots(b, c, d), lambda r: F.when(F.size(r) == 5, F.concat(F.slice(r, 1, 4), F.array(F.lit(NAN), F.lit(NAN), F.lit(2.0)))).otherwise(F.array(F.get(r, F.lit(0)), F.lit(0.0), F.get(r, F.lit(1)), F.lit(0.0), F.lit(NAN), F.lit(NAN), F.lit(0.0))))
        return F.when(a == 0, two).otherwise(moved)

    return _bound(by, a=a, b=b, c=c, d=d)
