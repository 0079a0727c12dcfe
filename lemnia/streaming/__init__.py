"""Formulas over streams: compiled Columns hold no state, so they run unchanged on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import AGGREGATES
from ..operators.evaluate import evaluate, where
from ..session import Session

__all__ = ["evaluate", "read", "where", "windowed"]


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(df: DataFrame, time: str, length: str, late: str, by: list[str], stats: dict[str, tuple[str, str]], session: Session | None = None) -> DataFrame:
    """Statistics of formulas per time window and key; rows later than ``late`` behind the newest are left out."""
    s = session or Session()
    cols = [AGGREGATES[n](s.compile(t, df.columns)).cast("double").alias(k) for k, (n, t) in stats.items()]
    return df.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(*cols).select(F.col("window.start").alias("start"), *by, *stats)
