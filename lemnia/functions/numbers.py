"""Numbers in other bases, fractions and primes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import let

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def to_base(x: Column, base: int, places: int = 0) -> Column:
    """A number's text in a base of 2 to 36, with ``places`` digits after the point, the rest cut off; null for what a long can't hold."""
    if not 2 <= base <= 36:
        raise ValueError("bases are 2 to 36")
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    text = F.conv(F.when(size < 2.0**62, whole.cast("bigint")).cast("string"), 10, base)
    if places:
        step = lambda s, _: F.struct(F.concat(s["text"], F.substring(F.lit(DIGITS), (F.floor(s["rest"] * base) + 1).cast("int"), F.lit(1))).alias("text"), (s["rest"] * base - F.floor(s["rest"] * base)).alias("rest"))
        text = F.concat(text, F.lit("."), F.aggregate(F.sequence(F.lit(1), F.lit(places)), F.struct(F.lit("").alias("text"), (size - whole).alias("rest")), step)["text"])
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text)


def from_base(text: Column, base: int) -> Column:
    """The number that a text in a base of 2 to 36 stands for; null where a character is no digit of the base."""
    if not 2 <= base <= 36:
        raise ValueError("bases are 2 to 36")
    plain = F.upper(F.regexp_replace(text, "^[+-]", ""))
    head, tail = F.split_part(plain, F.lit("."), F.lit(1)), F.split_part(plain, F.lit("."), F.lit(2))
    digits = F.filter(F.split(F.concat(head, tail), ""), lambda c: c != "")
    value = F.aggregate(digits, F.lit(0.0), lambda a, c: a * base + (F.instr(F.lit(DIGITS), c) - 1))
    size = value / F.pow(F.lit(float(base)), F.length(tail))
    return F.when(plain.rlike(f"^[{DIGITS[:base]}]*(\\.[{DIGITS[:base]}]*)?$") & (F.size(digits) > 0), F.when(text.startswith("-"), -size).otherwise(size))


def rebase(text: Column, source: int, target: int, places: int = 0) -> Column:
    return to_base(from_base(text, source), target, places)


def is_prime(n: Column) -> Column:
    """Trial division by 2, 3 and what is not divisible by them, up to the root."""
    root = F.floor(F.sqrt(n.cast("double")))
    tried = lambda: ~F.exists(F.sequence(F.lit(5).cast("bigint"), F.greatest(F.lit(5).cast("bigint"), root), F.lit(6).cast("bigint")), lambda k: ((n % k == 0) & (k < n)) | ((n % (k + 2) == 0) & (k + 2 < n)))
    return F.when(n < 2, F.lit(False)).when(n < 4, F.lit(True)).when((n % 2 == 0) | (n % 3 == 0), F.lit(False)).otherwise(tried())


def fraction(x: Column, greatest: int = 1_000_000) -> Column:
    """struct<num, den>: the last convergent of x's continued fraction with a denominator of at most ``greatest``; null for NaN and the infinities."""

    def step(s: Column, _: Column) -> Column:
        a = F.floor(s["rest"])
        p, q = a * s["p1"] + s["p0"], a * s["q1"] + s["q0"]
        left = s["rest"] - a
        stop = s["done"] | (q > greatest)
        keep = lambda new, old: F.when(stop, old).otherwise(new)
        return F.struct(
            keep(F.when(left > 1e-11, 1 / F.when(left > 1e-11, left).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)), s["rest"]).alias("rest"), keep(s["p1"], s["p0"]).alias("p0"), keep(s["q1"], s["q0"]).alias("q0"),
            keep(p, s["p1"]).alias("p1"), keep(q, s["q1"]).alias("q1"), (stop | (left <= 1e-11)).alias("done"),
        )

    size = F.abs(x)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    start = F.struct(size.alias("rest"), zero.alias("p0"), one.alias("q0"), one.alias("p1"), zero.alias("q1"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step)
    return F.when(~F.isnan(x) & (size < 2.0**52), let(found, lambda s: F.struct((s["p1"] * F.signum(x).cast("bigint")).alias("num"), s["q1"].alias("den"))))
