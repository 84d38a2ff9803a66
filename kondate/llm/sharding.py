"""Sharding by jump consistent hashing, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kondate.llm.common import broadcast_if_small

#: Multiplier of the published generator (key * A + 1 modulo 2**64).
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = (1 << 22) - 1, (1 << 20) - 1


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a 64-bit key among `shards`, and among `shards` + 1.

    The generator's state is held as limbs of 22, 22 and 20 bits, so that the products stay inside a long and ANSI
    arithmetic never overflows. The jumps for n and n + 1 shards are one sequence, so one walk gives both. A null key
    counts as 0.
    """
    a0, a1, a2 = MULTIPLIER & _LOW, MULTIPLIER >> 22 & _LOW, MULTIPLIER >> 44
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def state(shard, grown, jump, k0, k1, k2):
        return F.struct(shard.alias("shard"), grown.alias("grown"), jump.alias("jump"), k0.alias("k0"), k1.alias("k1"), k2.alias("k2"))

    def long(n: int) -> Column:
        return F.lit(n).cast("long")

    def step(s: Column, _: Column) -> Column:
        c0 = s["k0"] * a0 + 1
        c1 = s["k0"] * a1 + s["k1"] * a0 + F.shiftright(c0, 22)
        c2 = s["k0"] * a2 + s["k1"] * a1 + s["k2"] * a0 + F.shiftright(c1, 22)
        k0, k1, k2 = c0.bitwiseAND(long(_LOW)), c1.bitwiseAND(long(_LOW)), c2.bitwiseAND(long(_HIGH))
        top = F.shiftright(k1, 11) + k2 * 2048  # the state shifted right by 33
        jump = ((s["jump"] + 1) * (F.lit(float(1 << 31)) / (top + 1).cast("double"))).cast("long")
        moved = state(F.when(s["jump"] < shards, s["jump"]).otherwise(s["shard"]), s["jump"], jump, k0, k1, k2)
        return F.when(s["jump"] <= shards, moved).otherwise(s)

    zero = state(long(0), long(0), long(0), key.bitwiseAND(long(_LOW)), F.shiftrightunsigned(key, 22).bitwiseAND(long(_LOW)), F.shiftrightunsigned(key, 44))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), zero, step)
    return F.struct(walked["shard"].cast("int").alias("shard"), walked["grown"].cast("int").alias("grown"))


def assign_shards(rows: DataFrame, key: str, shards: int, order: list[str], buckets: int = 1024) -> DataFrame:
    """Add shard, grown_shard (with one shard more) and slot, a gapless place from 0 in the shard.

    rows: narrow rows; key: a column of integers. Appending a shard moves rows only into the new one. A shard is cut
    into hash buckets that are numbered by themselves; a table of shards x buckets counts, whose size is fixed by the
    two parameters and not by the data or the session, gives each bucket's first slot. Equal rows get different slots;
    a null key is sharded as 0; an empty table gives an empty result.
    """
    dealt = rows.withColumn("_jump", jump_shards(F.col(key), shards)).select(
        *rows.columns, F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard"), F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int").alias("_bucket")
    )
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "_bucket").count().select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order))
    return dealt.withColumn("_place", place).join(broadcast_if_small(first, shards * buckets), ["shard", "_bucket"]).select(*rows.columns, "shard", (F.col("_first") + F.col("_place") - 1).alias("slot"), "grown_shard")


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law `key`.

    size: UTF-8 bytes of the text (null: none) plus 8. Null and empty texts have size 8 and CRC 0. Rows that repeat a
    doc_id share its shard. Other columns are not read.
    """
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = assign_shards(narrow, "doc_id", shards, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
