"""What the operators share: intermediate tables in the shared folder and row filters by decision tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kondate import tables

#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 1000

#: Bytes of a counted table that may be broadcast.
BROADCAST_BYTES = 16 << 20


class Scratch(tables.Scratch):
    """Intermediate tables, written in small Arrow batches, as rows hold whole texts."""

    def table(self, df: DataFrame, name: str) -> DataFrame:
        key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", self.spark.conf
        before = conf.get(key)
        try:
            conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
            return super().table(df, name)
        finally:
            conf.set(key, before)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """A broadcast hint for a table of counted rows, of at most `row_bytes` each, within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Keys that may be broadcast because many rows have them.
HOT_KEYS = 4096


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner", most: int = HOT_KEYS) -> DataFrame:
    """rows joined (inner or left) with a table that has one narrow row per key, and in n how often rows have the key.

    Less than `most` keys, those with the largest n, are joined by broadcast, so no task gets the rows of a hot key; a
    key that is left to the shuffle has no more than 1 / `most` of all rows. Both inputs are read twice: written tables.
    """
    least = table.select(n).orderBy(F.desc(n)).limit(most).agg(F.count("*").alias("k"), F.min(n).alias("n")).first()
    if least["k"] < most:
        return rows.join(F.broadcast(table), keys, how)
    hot, cold = table.where(F.col(n) > least["n"]), table.where(F.col(n) <= least["n"])
    keyless = " or ".join(f"`{k}` is null" for k in keys)
    others = rows.where(f"not ({keyless})").join(F.broadcast(hot.select(keys)), keys, "left_anti")
    joined = rows.join(F.broadcast(hot), keys).unionByName(others.join(cold, keys, how))
    return joined.unionByName(rows.where(keyless), allowMissingColumns=True) if how == "left" else joined


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_HELD: dict[str, Any] = {}


def give_back() -> None:
    """Return this Python worker's free memory to the system, which else counts as its own until it ends."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """What this Python worker remembers from one task to the next, under one name at a time.

    Workers serve the tasks of many operators; asking for another name lets go of what the last one left.
    """
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        give_back()
        _HELD[name] = make()
    return _HELD[name]
