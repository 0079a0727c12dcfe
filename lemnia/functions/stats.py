"""Statistics of argument lists (over an array in one row) and of groups (aggregates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import NAN, divide, let

_plus = lambda a, x: a + x
_times = lambda a, x: a * x


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), _plus)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), _times)


def count(a: Column) -> Column:
    return F.size(a).cast("double")


def _or(a: Column, least: int, empty: float, value: Column) -> Column:
    return F.when(F.size(a) < least, F.lit(empty)).otherwise(value)


def mean(a: Column) -> Column:
    return _or(a, 1, 0.0, total(a) / F.greatest(count(a), F.lit(1.0)))


def geom(a: Column) -> Column:
    return _or(a, 1, 0.0, F.pow(product(a), 1 / F.greatest(count(a), F.lit(1.0))))


def variance(a: Column) -> Column:
    """Sample variance; 0 for fewer than two values."""
    squares = let(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return _or(a, 2, 0.0, squares / F.greatest(count(a) - 1, F.lit(1.0)))


def deviation(a: Column) -> Column:
    return F.sqrt(variance(a))


def cov(a: Column) -> Column:
    """Coefficient of variation; NaN for means near 0."""
    m = mean(a)
    return F.when(F.size(a) < 2, F.lit(0.0)).when(F.abs(m) < 1e-15, F.lit(NAN)).otherwise(divide(deviation(a), m))


def lowest(a: Column) -> Column:
    return _or(a, 1, NAN, F.array_min(a))


def highest(a: Column) -> Column:
    """NaN is the greatest double to Spark, so it is left out unless nothing else is there."""
    return _or(a, 1, NAN, F.coalesce(F.array_max(F.filter(a, lambda x: ~F.isnan(x))), F.lit(NAN)))


def median(a: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    return _or(a, 1, -1.0, let(F.sort_array(a), middle))


def mode(a: Column) -> Column:
    """All values with the top frequency, ascending."""
    times = lambda s: F.transform(F.array_distinct(s), lambda v: F.struct(F.size(F.filter(s, lambda x: x == v)).alias("n"), v.alias("v")))
    return let(times(a), lambda t: F.array_sort(F.transform(F.filter(t, lambda x: x["n"] == F.array_max(t)["n"]), lambda x: x["v"])))


def trimmed(k: Column, a: Column) -> Column:
    """Sorted, without k values at each end, two values at least kept."""
    n = F.size(a)
    cut = F.least(F.greatest(F.round(k).cast("int"), F.lit(0)), F.greatest(F.floor((n - 1) / 2).cast("int"), F.lit(0)))
    cut = F.when((n - 2 * cut < 2) & (cut > 0), cut - 1).otherwise(cut)
    return F.slice(F.array_sort(a), cut + 1, n - 2 * cut)


LISTS = {
    "sum": total, "listsum": total, "prod": product, "gsum": lambda a: _or(a, 1, 0.0, product(a)), "mean": mean, "avg": mean, "listavg": mean,
    "geom": geom, "count": count, "min": lowest, "max": highest, "rng": lambda a: _or(a, 1, 0.0, highest(a) - lowest(a)), "mrng": lambda a: _or(a, 1, 0.0, (highest(a) + lowest(a)) / 2),
    "med": median, "median": median, "mode": mode, "rms": lambda a: F.sqrt(mean(F.transform(a, lambda x: x * x))), "s_d": deviation, "variance": variance,
    "st_err": lambda a: _or(a, 2, 0.0, deviation(a) / F.sqrt(F.greatest(count(a), F.lit(1.0)))), "cov": cov, "sort": F.array_sort,
}
TRIMMED = {"avgN": lambda k, a: mean(trimmed(k, a)), "geomN": lambda k, a: geom(trimmed(k, a))}


def _sample(value, least: int = 2):
    return lambda x: F.when(F.count(x) >= least, value(x)).otherwise(F.lit(0.0))


def _group_geom(x: Column) -> Column:
    """As for lists: 0 with a zero, NaN where the product is negative and there is more than one value."""
    odd = F.sum(F.when(x < 0, F.lit(1)).otherwise(F.lit(0))) % 2 == 1
    size = F.exp(F.avg(F.when(x != 0, F.ln(F.abs(x)))))
    return F.when(F.max(x == 0), F.lit(0.0)).when(odd & (F.count(x) == 1), F.max(x)).when(odd, F.lit(NAN)).otherwise(size)


#: Aggregates of one formula over a group; nulls are left out.
AGGREGATES = {
    "sum": F.sum, "listsum": F.sum, "prod": F.product, "gsum": F.product, "mean": F.avg, "avg": F.avg, "listavg": F.avg, "count": lambda x: F.count(x).cast("double"),
    "min": F.min, "max": F.max, "rng": lambda x: F.max(x) - F.min(x), "mrng": lambda x: (F.max(x) + F.min(x)) / 2, "med": F.median, "median": F.median,
    "geom": _group_geom, "rms": lambda x: F.sqrt(F.avg(x * x)), "s_d": _sample(F.stddev_samp), "variance": _sample(F.var_samp),
    "st_err": _sample(lambda x: F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))), "cov": _sample(lambda x: F.try_divide(F.stddev_samp(x), F.avg(x))),
}
