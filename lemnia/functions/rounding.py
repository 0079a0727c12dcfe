"""Rounding and digit counts, from the shortest decimal text of a double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import let

#: Powers of ten that a long holds.
_TENS = 18


def decimal_parts(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(struct(m, k)): |x| is m * 10^k by its shortest decimal text; m is null for NaN and the infinities."""

    def by(t: Column) -> Column:
        # "1.0E20" has a zero that is no digit
        digits = F.rtrim(F.substring_index(t, "E", 1), F.lit("0"))
        exponent = F.when(F.instr(t, "E") > 0, F.substring_index(t, "E", -1).try_cast("int")).otherwise(F.lit(0))
        m = F.replace(digits, F.lit("."), F.lit("")).try_cast("bigint")
        point = F.instr(digits, ".")
        return let(F.struct(m.alias("m"), (exponent - F.when(point > 0, F.length(digits) - point).otherwise(F.lit(0))).alias("k")), body)

    return let(F.abs(x).cast("string"), by)


def _power(n: Column) -> Column:
    return F.get(F.array(*(F.lit(10**i).cast("bigint") for i in range(_TENS + 1))), F.greatest(F.lit(0), F.least(n, F.lit(_TENS))).cast("int"))


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, b)


def _joined(m: Column, k: Column, x: Column) -> Column:
    """m * 10^k with the sign of x, read as decimal text."""
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), m.cast("string"), F.lit("E"), k.cast("string")).cast("double")


def _scaled(x: Column, n: Column, mode: str, digits: bool = False) -> Column:
    """x at n decimals, or at n digits: half up, or towards a side.  Digits are dropped from the shortest decimal text, as binary fractions would shift them."""

    def by(p: Column) -> Column:
        # of a number with so many digits, all but n are dropped
        last = n - _length(p) - p["k"].cast("double") if digits else n
        return let(F.greatest(F.lit(-400.0), F.least(F.lit(400.0), -last)).cast("int") - p["k"], lambda drop: cut(p, drop))

    def cut(p: Column, drop: Column) -> Column:
        return let(_power(drop), lambda ten: F.when(p["m"].isNull() | (drop <= 0), x).otherwise(joined(p, drop, ten)))

    def joined(p: Column, drop: Column, ten: Column) -> Column:
        rest = F.when(drop > _TENS, p["m"]).otherwise(p["m"] % ten)
        whole = F.when(drop > _TENS, F.lit(0).cast("bigint")).otherwise(_div(p["m"], ten))
        up = {"half": (drop <= _TENS) & (2 * rest >= ten), "ceil": (rest > 0) & (x > 0), "floor": (rest > 0) & (x < 0)}[mode]
        return _joined(whole + up.cast("bigint"), p["k"] + drop, x)

    return decimal_parts(x, by)


def _length(p: Column) -> Column:
    """The digits of m; for 0 and what has none as many as set floor(log10) to 0."""
    return F.when(F.coalesce(p["m"], F.lit(0)) == 0, F.lit(1.0) - p["k"]).otherwise(F.length(p["m"].cast("string")).cast("double"))


def digits_before(x: Column) -> Column:
    """floor(log10 |x|), from the decimal text; 0 for 0."""
    return decimal_parts(x, lambda p: F.when(F.coalesce(p["m"], F.lit(0)) == 0, F.lit(0.0)).otherwise((F.length(p["m"].cast("string")) + p["k"] - 1).cast("double")))


def round_x(n: Column, x: Column) -> Column:
    """Half up, one digit at a time from the last one to n decimals."""

    def by(p: Column) -> Column:
        drop = F.greatest(F.lit(-400.0), F.least(F.lit(400.0), -n)).cast("int") - p["k"]
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(drop, F.lit(_TENS))))
        m = F.aggregate(steps, p["m"], lambda a, _: _div(a, F.lit(10)) + (a % 10 >= 5).cast("bigint"))
        return F.when(p["m"].isNull() | (drop <= 0), x).otherwise(_joined(m, p["k"] + drop, x))

    return decimal_parts(x, by)


def length_decimal(x: Column) -> Column:
    """Digits before the point; none for numbers under 1."""
    return decimal_parts(x, lambda p: F.when(F.abs(x) < 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.length(p["m"].cast("string")) + p["k"])).cast("double"))


def length_fractional(x: Column) -> Column:
    return decimal_parts(x, lambda p: F.when(p["m"] == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), -p["k"])).cast("double"))


ROUNDING = {
    "round": lambda x: F.round(x, 0),
    "roundN": lambda n, x: _scaled(x, n, "half"),
    "roundX": round_x,
    "roundDigitsN": lambda d, x: _scaled(x, d, "half", digits=True),
    "ceilN": lambda n, x: _scaled(x, n, "ceil"), "floorN": lambda n, x: _scaled(x, n, "floor"),
    "ceilDigitsN": lambda d, x: _scaled(x, d, "ceil", digits=True), "floorDigitsN": lambda d, x: _scaled(x, d, "floor", digits=True),
    "length": lambda x: length_decimal(x) + length_fractional(x), "lengthDecimal": length_decimal, "lengthFractional": length_fractional,
}


def _say(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "\\.0$", "")


ECHO = {
    "echo": lambda *a: F.concat_ws(" ", *map(_say, a)),
    "echon": lambda *a: F.concat_ws("\n", *map(_say, a)),
    "echoi": lambda *a: F.concat_ws(" ", *(F.concat(F.lit(f"{k}: "), _say(c)) for k, c in enumerate(a, 1))),
    "echoni": lambda *a: F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), _say(c)) for k, c in enumerate(a, 1))),
}
