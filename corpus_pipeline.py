"""From raw documents to packed sequences, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemnia.llm.decontaminate import find_contained
from lemnia.llm.ngram_join import join_near_duplicates
from lemnia.llm.packing import pack_documents
from lemnia.llm.quality_rules import judge_quality
from lemnia.llm.secrets import redact_secrets
from lemnia.llm.store import Tables

#: Rows up to which a list of rejected rows' keys is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, a hash of all columns: ids may be null or shared, so each row is judged under its key."""
    cols = [F.col(c) for c in docs.columns]
    return docs.withColumn("row_key", F.xxhash64(*cols, *(c.isNull() for c in cols)))


def _under_key(keyed: DataFrame) -> DataFrame:
    """What an operator gets: the key in place of the id."""
    return keyed.withColumn("doc_id", F.col("row_key")).drop("row_key")


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose keys are not rejected (column bad), without the key."""
    bad = Tables(keyed.sparkSession, "rejected").write(rejected.distinct(), "keys")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return keyed.join(side, keyed["row_key"] == side["bad"], "left_anti").drop("row_key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed = _keyed(docs)
    return _without(keyed, judge_quality(_under_key(keyed)).where("not kept").select(F.col("doc_id").alias("bad")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, null last, of each group of linked ones; a row that is repeated as it is stays once."""
    keyed = _keyed(docs)
    found = Tables(spark, "linked").write(join_near_duplicates(_under_key(keyed)).select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("comp")).distinct(), "keys")
    # only groups of several rows are looked at further
    several = found.where("row_key <> comp").select("comp").distinct()
    members = found.join(several, "comp")
    ids = keyed.select("row_key", "doc_id").join(members, "row_key")
    best = ids.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))["row_key"].alias("row_key"))
    kept = _without(keyed, members.select("row_key").join(best, "row_key", "left_anti").select(F.col("row_key").alias("bad")))
    repeated = keyed.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates() if repeated else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    return _without(keyed, find_contained(_under_key(keyed), items).select(F.col("doc_id").alias("bad")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a marker and n_chars counted anew."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs


#: Packing and redaction are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None
