"""Connected components of a table of links, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables


def connected(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(cid, comp) of all ends of the links (a, b); comp is the least cid reachable.

    Each round hangs every label below the least label next to it, then halves
    the paths, so the rounds grow with the logarithm of the longest path.
    Hot nodes are summed before the shuffle.
    """
    labels = tables.write(links.select(F.explode(F.array("a", "b")).alias("cid")).distinct().withColumn("comp", F.col("cid")), f"{name}-l0")
    edges = tables.write(links.select("a", "b").where("a <> b").distinct(), f"{name}-e0")
    k = 0
    while edges.head(1):
        k += 1
        # edges are between roots: hang each root below its least neighbour
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        up = tables.write(up, f"{name}-u{k}")
        for j in (1, 2):  # pointer jumping
            far = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up = up.join(far, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
            up = tables.write(up, f"{name}-u{k}{j}")
        at = up.select(F.col("u").alias("comp"), F.col("p").alias("root"))
        labels = tables.write(labels.join(at, "comp", "left").select("cid", F.coalesce("root", "comp").alias("comp")), f"{name}-l{k}")
        a = up.select(F.col("u").alias("a"), F.col("p").alias("ra"))
        b = up.select(F.col("u").alias("b"), F.col("p").alias("rb"))
        edges = tables.write(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-e{k}")
    return labels
