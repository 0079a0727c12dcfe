"""Bounded samples of labelled documents for the two trained classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(id_col.cast("string")) % mod


def training_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, rows: int, seed: str) -> tuple[list[str], list[int]]:
    """At most ``rows`` labelled texts outside the held-out fold, spread evenly by a hash of the id.

    The ids are chosen from the label table alone; rows without an id or a
    label are not used, and of repeated ids one is.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), mod) != held_out))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("id", F.lit(seed)), "id")
        .limit(rows)
    )
    # at most ``rows`` ids are broadcast
    got = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id", F.lit(seed)), "t").limit(rows).toPandas()
    return [t or "" for t in got["t"]], [int(y) for y in got["y"]]
