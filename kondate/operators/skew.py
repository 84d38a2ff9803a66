"""Equi-joins of rows of which one key may have most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be hot: each has more than one in so many of all rows, so there are fewer.
HOT_KEYS = 2000


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", most: int = HOT_KEYS) -> DataFrame:
    """rows joined (inner or left) with a table that has few rows per key; rows is read twice, so a written table.

    Rows of a key with more than a `most`-th of all rows are dealt to as many parts as that share is exceeded, by a hash
    of the whole row, and the table's rows of the key go to each part. The hot keys, fewer than `most`, are broadcast.
    """
    total = max(1, rows.count() // most)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > total).select(*keys, F.ceil(F.col("_n") / total).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), parts).cast("int")).drop("_parts")
    spread = table.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(spread, [*keys, "_part"], how).drop("_part")
