"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on a local master only, a temporary folder is set."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (
        jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    )
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lemnia-")
        spark.sparkContext.setCheckpointDir(found)
        found = jsc.getCheckpointDir().get()
        atexit.register(lambda d=found: __import__("shutil").rmtree(d.removeprefix("file:"), ignore_errors=True))
    return found


class Tables:
    """Tables written once, read by later jobs, and dropped when no longer needed.

    A written table cuts the lineage and survives the loss of any executor, so
    the shuffle files that made it go as soon as it is there.
    """

    #: Settings while a table is written: no shuffle files after it, few files side by side instead of a sort by folder, and no
    #: more tasks, and so files, than shuffled bytes are worth; many rounds write small tables.
    WRITING = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "8",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    }

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str, by: str | None = None, batch: int | None = None) -> DataFrame:
        """The table, read back; with ``by``, in a folder f"{name}/{by}={value}" for each value, which can be dropped alone; with ``batch``, by Arrow batches of so many rows."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        settings = self.WRITING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {})
        before = {k: conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                conf.set(k, v)
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables by name; all without one."""
        for name in names or ("",):
            self._remove(name)

    def _remove(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
