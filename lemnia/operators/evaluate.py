"""Evaluation of formulas over DataFrames: projection, predicate, group statistics, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import AGGREGATES
from ..plans.logical import compile_logical
from ..session import Session


def evaluate(df: DataFrame, formulas: dict[str, str], session: Session | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and one column per formula.  Works on streams too."""
    s = session or Session()
    columns = [s.compile(text, df.columns).alias(name) for name, text in formulas.items()]
    return df.select(*(keep if keep is not None else df.columns), *columns)


def where(df: DataFrame, condition: str, session: Session | None = None) -> DataFrame:
    """Rows for which a logical formula holds."""
    return df.filter(compile_logical(condition, session or Session(), df.columns))


def summarise(df: DataFrame, by: list[str], stats: dict[str, tuple[str, str]], session: Session | None = None) -> DataFrame:
    """Group statistics: alias -> (statistic, formula)."""
    s = session or Session()
    plain = {k: AGGREGATES[name](s.compile(text, df.columns)).cast("double").alias(k) for k, (name, text) in stats.items()}
    return df.groupBy(*by).agg(*plain.values())


def modes(df: DataFrame, by: list[str], formula: str, session: Session | None = None) -> DataFrame:
    """All values of a formula with the top frequency in each group, from counts, so no group is gathered whole."""
    counts = df.groupBy(*by, (session or Session()).compile(formula, df.columns).alias("value")).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max("n").alias("top"))
    return counts.join(top, by).where("n = top").select(*by, "value", "n")


def trimmed_mean(df: DataFrame, by: list[str], formula: str, k: int, session: Session | None = None) -> DataFrame:
    """Mean without the k least and k greatest values of each group.

    The k ends come from bounded per-group top lists, so a group is summed in parts rather than sorted whole.
    """
    v = (session or Session()).compile(formula, df.columns)
    values = df.select(*by, v.alias("v"))
    sums = values.groupBy(*by).agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    counts = values.groupBy(*by, "v").agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    low = F.sum("c").over(w.orderBy("v")) - F.col("c")
    high = F.sum("c").over(w.orderBy(F.desc("v"))) - F.col("c")
    ends = counts.withColumn("lo", F.greatest(F.lit(0), F.least(F.col("c"), k - low))).withColumn("hi", F.greatest(F.lit(0), F.least(F.col("c"), k - high)))
    cut = ends.groupBy(*by).agg(F.sum(F.col("v") * (F.col("lo") + F.col("hi"))).alias("cut"))
    return sums.join(cut, by).select(*by, ((F.col("s") - F.col("cut")) / (F.col("n") - 2 * k)).alias("trimmed_mean"))


def eval_range(spark: SparkSession, formula: str, low: float, high: float, step: float, session: Session | None = None, name: str = "x") -> DataFrame:
    """(x, y) at low, low + step .. high; swapped bounds are put in order; each point is computed on its own, so no drift adds up."""
    low, high = min(low, high), max(low, high)
    n = int((high - low) / abs(step) + 1e-9) + 1
    x: Column = F.lit(float(low)) + F.col("id") * F.lit(abs(float(step)))
    points = spark.range(n).select(x.alias(name))
    return points.select(F.col(name).alias("x"), (session or Session()).compile(formula, [name]).alias("y"))
