"""Benchmark decontamination with SQL functions only.

Items are partitioned by their number of shingles.  The size fixes how many of
an item's least hashes (its bottom-k MinHash sketch) must be looked up so that
no document holding the least share of its shingles can miss them all.  Only the
sketches are searched for; the pairs they find are verified by the exact
count of shared shingles, which is taken from the documents found alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nativetext import ascii_lower, gram_hashes, words
from .store import Tables

WORDS, LEAST_SHARE = 5, 0.75
#: Rows of a list (items' shingles, pairs found) up to which it is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def _lowered(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), words(ascii_lower(F.col("text").cast("string"))).alias("w"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, width, hash, n_item, size_class, sketched) of the distinct shingles of all rows of an item; rows of fewer words are one shingle.

    An item of n shingles may lack n - ceil(share * n) of them, so one of its
    least n - ceil(share * n) + 1 hashes, its sketch, can't be missed.  Hence the size
    of an item, kept by powers of two, fixes how much of it is looked up.
    """
    w = F.col("w")
    width = F.least(F.size(w), F.lit(WORDS))
    hashes = gram_hashes(w, WORDS)
    for k in range(1, WORDS):
        hashes = F.when(F.size(w) == k, gram_hashes(w, k)).otherwise(hashes)
    rows = _lowered(items, "item_id").where(F.size(w) > 0).select("item_id", width.alias("width"), F.explode(hashes).alias("hash")).distinct()
    sets = rows.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("hash", "width"))).alias("h"))
    n = F.size("h")
    k = n - F.ceil(n * LEAST_SHARE) + 1
    at = sets.select("item_id", n.cast("long").alias("n_item"), k.alias("k"), F.posexplode("h").alias("p", "s"))
    return at.select("item_id", "s.width", "s.hash", "n_item", F.floor(F.log2("n_item")).cast("int").alias("size_class"), (F.col("p") < F.col("k")).alias("sketched"))


def doc_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, width, hash) of all shingles of the given widths."""
    w = F.col("w")
    base = _lowered(docs, "doc_id")
    if widths == [WORDS]:
        return base.select("doc_id", F.lit(WORDS).alias("width"), F.explode(gram_hashes(w, WORDS)).alias("hash"))
    sized = lambda k: F.transform(gram_hashes(w, k), lambda h: F.struct(F.lit(k).alias("width"), h.alias("hash")))
    return base.select("doc_id", F.explode(F.concat(*map(sized, widths))).alias("g")).select("doc_id", "g.width", "g.hash")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all pairs with containment of LEAST_SHARE or more.

    Words are lowered in A-Z.  Null and empty texts contain nothing and, as
    items, are contained in nothing; equal rows count once, rows that share an
    id are one document (or item); a null id matches nothing.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "contained")
    table = tables.write(item_shingles(items.where(F.col("item_id").isNotNull())), "items")
    stats = table.groupBy("size_class").agg(F.count("*").alias("n"), F.sum(F.col("sketched").cast("long")).alias("sketched"), F.collect_set("width").alias("widths")).collect()  # a row per power of two
    widths = sorted({w for r in stats for w in r["widths"]})
    if not widths:
        return spark.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    docs = docs.where(F.col("doc_id").isNotNull())
    # the search: all documents' shingles against the sketches, one size class beside the other
    sketches = _small(table.where("sketched").select("hash", "width", "size_class", "item_id"), sum(r["sketched"] for r in stats))
    found = tables.write(doc_shingles(docs, widths).join(sketches, ["hash", "width"]).select("doc_id", "item_id", "size_class").distinct(), "found")
    # the verification: the whole shingle sets of the pairs found, and of no others
    n_found = found.count()
    near = _small(found.select("doc_id").distinct(), n_found)
    rows = doc_shingles(docs.join(near, "doc_id", "left_semi"), widths)
    full = _small(table.select("hash", "width", "item_id", "n_item"), sum(r["n"] for r in stats))
    shared = rows.join(full, ["hash", "width"]).join(_small(found.select("doc_id", "item_id"), n_found), ["doc_id", "item_id"], "left_semi")
    pairs = shared.groupBy("doc_id", "item_id", "n_item", "hash", "width").agg(F.lit(1)).groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return pairs.where(F.col("n_shared") >= F.col("n_item") * LEAST_SHARE).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
