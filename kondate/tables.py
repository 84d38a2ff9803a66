"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task gets, about, of a table that is dealt by its counted rows.
TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where a local session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kondate-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def deal_rows(rows: DataFrame, counted: int, *keys: str) -> DataFrame:
    """Rows by keys in as many parts as `counted` rows need, at least one for each core.

    An aggregation by the keys then needs the memory of about TASK_ROWS rows a task, however many the table has; parts
    that Spark cuts by bytes hold millions of short rows, and a task keeps a buffer for each of their keys.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-counted // TASK_ROWS))
    return rows.repartition(parts, *keys)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that are still to be computed need them."""
    _delete(spark, _own_folder(spark))


class Scratch:
    """Intermediate tables of one run, written to the shared folder so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))
