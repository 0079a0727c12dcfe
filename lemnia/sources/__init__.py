"""Inputs and stored sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import Session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save_session(spark: SparkSession, session: Session, path: str) -> None:
    """The session's definitions as a one-line text folder."""
    spark.createDataFrame([(session.dump(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_session(spark: SparkSession, path: str) -> Session:
    return Session.load(spark.read.text(path).first()[0])
