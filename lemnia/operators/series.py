"""Series-slice formulas over ordered points, as window frames.

L0 is the newest point at a row, Lk the k-th before it (the oldest where there is none), MN the
number of points so far.  ``..Lk``, ``Lk..`` and ``La..Lb`` are slices and stand as
the sole argument of a statistic, which becomes a window aggregate; L{expr} is a computed index.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import NAN
from ..functions.stats import AGGREGATES, LISTS
from ..plans.logical import compile_logical
from ..session import Session

_SLICE = re.compile(r"([A-Za-z_]\w*)\(\s*(?:L(\d+))?\s*\.\.\s*(?:L(\d+))?\s*\)")
_POINT = re.compile(r"\bL(\d+)\b")
_COUNT = re.compile(r"\bMN\b")
_COMPUTED = re.compile(r"\bL\{([^{}]*)\}")
#: Statistics that a frame computes without gathering its points.
FRAMED = set(AGGREGATES) - {"med", "median"}


def compile_series(text: str, value: Column, by: list[str], order: list[str], session: Session | None = None) -> Column:
    """A boolean Column for a logical series formula."""
    expanded, values, s = _bind(text, value, by, order, session)
    return compile_logical(expanded, s, list(values), values)


def compile_series_math(text: str, value: Column, by: list[str], order: list[str], session: Session | None = None) -> Column:
    """A double Column for a series formula that is plain math."""
    expanded, values, s = _bind(text, value, by, order, session)
    return s.compile(expanded, list(values), values)


def _bind(text, value, by, order, session):
    session = session or Session()
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    oldest = F.first(value).over(whole)
    values: dict[str, Column] = {}

    def name(c: Column) -> str:
        key = f"p_{len(values)}"
        values[key] = c
        return f" {key} "

    def at(k: int) -> Column:
        return value if k == 0 else F.coalesce(F.lag(value, k).over(w), oldest)

    def sliced(m: re.Match) -> str:
        stat, a, b = m[1], m[2], m[3]
        far, near = (max(int(a), int(b)), min(int(a), int(b))) if a and b else (int(a), 0) if a else (None, int(b or 0))
        frame = w.rowsBetween(Window.unboundedPreceding if far is None else -far, -near)
        if stat in FRAMED:
            # a frame before the first point stands for that point
            return name(F.when(F.count(value).over(frame) > 0, _over(stat, value, frame)).otherwise(LISTS[stat](F.array(oldest))))
        points = F.collect_list(value).over(frame)
        return name(LISTS[stat](F.when(F.size(points) > 0, points).otherwise(F.array(oldest))))

    def computed(m: re.Match) -> str:
        inner, inner_values, _ = _bind(m[1], value, by, order, session)
        k = session.compile(inner, list(inner_values), inner_values).cast("int")
        points = F.collect_list(value).over(whole)
        n = F.size(points)
        return name(F.element_at(points, F.greatest(F.lit(1), F.least(n, n - k))))

    text = _COMPUTED.sub(computed, text)
    text = _SLICE.sub(sliced, text)
    text = _POINT.sub(lambda m: name(at(int(m[1]))), text)
    text = _COUNT.sub(lambda m: name(F.count(F.lit(1)).over(whole).cast("double")), text)
    return text, values, session


def _over(stat: str, v: Column, frame) -> Column:
    """The statistic with each of its aggregates over the frame."""
    n = F.count(v).over(frame)
    mean = F.avg(v).over(frame)
    sd = F.when(n >= 2, F.stddev_samp(v).over(frame)).otherwise(F.lit(0.0))
    lo, hi = F.min(v).over(frame), F.max(v).over(frame)
    return {
        "prod": lambda: F.product(v).over(frame), "gsum": lambda: F.product(v).over(frame), "sum": lambda: F.sum(v).over(frame), "listsum": lambda: F.sum(v).over(frame), "mean": lambda: mean, "avg": lambda: mean, "listavg": lambda: mean, "count": lambda: n.cast("double"),
        "min": lambda: lo, "max": lambda: hi, "rng": lambda: hi - lo, "mrng": lambda: (hi + lo) / 2, "geom": lambda: F.when(lo == 0, F.lit(0.0)).when(lo > 0, F.exp(F.avg(F.when(v > 0, F.ln(v))).over(frame))).otherwise(LISTS["geom"](F.collect_list(v).over(frame))), "rms": lambda: F.sqrt(F.avg(v * v).over(frame)),
        "s_d": lambda: sd, "variance": lambda: sd * sd, "st_err": lambda: sd / F.sqrt(n.cast("double")), "cov": lambda: F.when(F.abs(mean) < 1e-15, F.lit(NAN)).otherwise(sd / F.when(mean == 0, F.lit(1.0)).otherwise(mean)),
    }[stat]()


def series(df: DataFrame, formulas: dict[str, str], value: str, by: list[str], order: list[str], session: Session | None = None) -> DataFrame:
    """df with a column per series formula: boolean where it compares, else double."""
    s = session or Session()
    v = F.col(value).cast("double")
    compares = re.compile(r"[<>=&|]|\b(?:and|or|xor|impl?|lt|gt|le|ge|eq)\b|!=")
    return df.select("*", *((compile_series if compares.search(t) else compile_series_math)(t, v, by, order, s).alias(k) for k, t in formulas.items()))


def expand(text: str, points: list[str]) -> str:
    """The text a formula stands for over given points, newest last, for display."""
    newest = points[::-1]
    n = len(newest)
    pick = lambda k: newest[min(max(k, 0), n - 1)]

    def between(a: int, b: int) -> str:
        a, b = min(a, n - 1), min(b, n - 1)
        return ",".join(pick(k) for k in (range(a, b - 1, -1) if a >= b else range(a, b + 1)))

    text = re.sub(r"L(\d+)\.\.L(\d+)", lambda m: between(int(m[1]), int(m[2])), text)
    text = re.sub(r"\.\.L(\d+)", lambda m: between(n - 1, int(m[1])), text)
    text = re.sub(r"L(\d+)\.\.", lambda m: between(int(m[1]), 0), text)
    text = _POINT.sub(lambda m: pick(int(m[1])), text)
    return _COUNT.sub(str(n), text)
