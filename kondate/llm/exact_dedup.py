"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, broadcast_if_small, join_by_key


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), check (length and a second hash, to verify a digest)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("_t"))
    return rows.select("doc_id", F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("digest"), F.xxhash64(F.octet_length("_t"), "_t").alias("check"))


def rounds_for(partitions: int, radix: int) -> int:
    """Rounds after which radix ** rounds slots are as many as the partitions, or more."""
    rounds = 1
    while radix**rounds < partitions:
        rounds += 1
    return rounds


def tree_merge(rows: DataFrame, radix: int = 4, rounds: int | None = None) -> DataFrame:
    """digest, check, keep_id, group_size of every distinct text, from (doc_id, digest, check).

    Each scan partition is a run in one of radix ** rounds slots (as many as the session has shuffle partitions, or
    more). In round k the `radix` slots that differ only in digit k exchange their runs: a row goes to the slot whose
    digit k is that of its digest, every slot is a partition of its own, and the runs that meet there are sorted by
    digest and merged in one pass that keeps the smallest identifier among verified equals (digest and check both
    equal). So what round k hands on is merged already: a digest that a third of all rows have is spread over the
    slots by where it comes from in the first round, and is one row of a run from then on. After the last round every
    slot owns one range of digests.
    """
    rounds = rounds or rounds_for(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), radix)
    slots = radix**rounds
    runs = rows.select("digest", "check", F.struct(F.col("doc_id").isNull().alias("without"), "doc_id").alias("least"), F.lit(1).cast("long").alias("n"), F.pmod(F.spark_partition_id(), F.lit(slots)).alias("slot"))
    target = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int") % slots
    for k in range(rounds):
        weight = radix**k
        digit = lambda c, w=weight: F.floor(c / F.lit(w)).cast("int") % radix
        runs = runs.withColumn("slot", (F.col("slot") + (digit(target) - digit(F.col("slot"))) * weight).cast("int"))
        met = runs.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "digest", "check")
        runs = met.groupBy("slot", "digest", "check").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    return runs.select("digest", "check", F.col("least.doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too.

    Texts are equal when the same after `normalised`; the smallest doc_id of equal texts is kept. Null and empty texts
    are equal. Rows that repeat doc_id and text get the same answer each (``keep_first`` leaves one of them). A null
    doc_id is never the smallest unless the whole group has none. An empty table gives an empty result; columns beside
    doc_id and text are not read. Only digests are shuffled, never texts; those of large groups are joined back by
    broadcast, so no task gets a whole large group.
    """
    scratch = Scratch(documents.sparkSession, "exact-dedup")
    rows = scratch.table(digests(documents), "digests")
    groups = scratch.table(tree_merge(rows).where("group_size > 1"), "groups")
    out = join_by_key(rows, groups, ["digest", "check"], "group_size", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents without all but one of each group of equal texts; all columns, whatever their names, texts unchanged.

    The dropped identifiers are joined by broadcast while they are few (counted), by shuffle beyond that. Of rows that
    repeat both doc_id and normalised text any one is kept.
    """
    scratch = Scratch(documents.sparkSession, "exact-keep")
    decided = scratch.table(exact_groups(documents).where("group_size > 1").select(F.col("doc_id").alias("i"), F.unhex("text_sha256").alias("d"), "kept"), "decided")
    gone = scratch.table(decided.where("not kept").select("i", "d").distinct(), "gone")
    twice = scratch.table(decided.where("kept").groupBy("i", "d").count().where("count > 1").select("i", "d"), "twice")
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), digest_of(F.col("text")).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    left = keyed.join(broadcast_if_small(gone, gone.count()), same, "left_anti")
    if again := twice.count():
        small = broadcast_if_small(twice, again)
        once = left.join(small, same, "left_semi").dropDuplicates(["id", "digest"])
        left = left.join(small, same, "left_anti").unionByName(once)
    return left.select("row.*")
