"""The addresses that a collection has ever queued, in buckets on disk, so that joins with them move only what is new."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["store", "url"]


class SeenSet:
    """store, url, epoch in a folder, bucketed and sorted by store and url.

    The folder is a table with a location, known to a session under a name made from it; any session that opens the
    folder with the same number of buckets reads the same rows. Rows are only added. An anti-join deals the new rows to
    the buckets and reads each bucket where it lies: the seen rows, however many, are never shuffled.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.name = f"seen_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
        location = folder.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (store STRING, url STRING, epoch INT) USING parquet CLUSTERED BY (store, url) SORTED BY (store, url) INTO {buckets} BUCKETS LOCATION '{location}'")

    def add(self, rows: DataFrame, epoch: int) -> None:
        """Add rows (store, url) of an epoch; rows that are added again, as by a run that begins anew, change nothing."""
        new = rows.select(*KEYS, F.lit(epoch).cast("int").alias("epoch")).repartition(self.buckets, *KEYS)
        new.write.mode("append").insertInto(self.name)

    def rows(self, epoch: int | None = None) -> DataFrame:
        """store, url of all, or of those up to an epoch."""
        table = self.spark.table(self.name)
        return (table if epoch is None else table.where(F.col("epoch") <= epoch)).select(*KEYS)

    def unseen(self, rows: DataFrame, epoch: int | None = None) -> DataFrame:
        """The rows whose store and url aren't there; only these rows are shuffled."""
        return rows.repartition(self.buckets, *KEYS).join(self.rows(epoch).hint("merge"), KEYS, "left_anti")

    def close(self) -> None:
        """Forget the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
