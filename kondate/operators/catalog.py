"""Merging what was collected into a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kondate import dims, schema
from kondate.functions.html import spread
from kondate.functions.urls import canonical_url, once, task_key
from kondate.operators.quality import with_migrated_category
from kondate.operators.rank import last_wins
from kondate.tables import Scratch

FIELDS = [*schema.TEXTS, *schema.NUMBERS, "auto"]


def merge_catalog(catalog: DataFrame, incoming: DataFrame, stores: list[str] = dims.STORES, canonical=canonical_url) -> DataFrame:
    """catalog (FIELDS and ord) with the incoming rows (FIELDS and seq), by store and address.

    A catalog row goes by its canonical address (the last of equal ones is the target; rows without take no part), an
    incoming one by its own. What is new is appended. A collected row takes the incoming fields and keeps its id; a
    row edited by hand stays. Of incoming rows with one key the first makes a new row and the last has its fields.
    Appended rows come behind the catalog in order of seq.
    """
    # dealt to all cores and written, as a file that one task reads may hold all rows, and three steps need their keys
    addressed = once(spread(catalog), "_address", canonical(F.col("url")))
    keyed = Scratch(catalog.sparkSession, "merge").table(addressed.withColumn("_key", F.when(F.col("_address") != "", task_key(F.col("store"), F.col("_address")))).drop("_address"), "keyed")
    loose = keyed.where("_key is null").drop("_key")
    target = keyed.where("_key is not null")
    last = target.groupBy("_key").agg(F.max("ord").alias("_last"))
    target = target.join(last, "_key").withColumn("_is_target", F.col("ord") == F.col("_last"))
    rows = with_migrated_category(spread(incoming)).where(F.col("store").isin(stores)).withColumn("_key", task_key(F.col("store"), F.col("url")))
    ends = lambda f, name: f(F.struct("seq", *FIELDS)).alias(name)
    new = rows.groupBy("_key").agg(ends(F.min, "_first"), ends(F.max, "_new"))
    joined = target.where("_is_target").drop("_is_target", "_last").alias("t").join(new.alias("n"), "_key", "full_outer")
    here, replace = F.col("t.ord").isNotNull(), F.coalesce(F.col("t.auto"), F.lit(False)) & F.col("_new").isNotNull()
    # a new row is replaced by the later ones of its key only if it was collected itself
    added = lambda k: F.when(F.coalesce("_first.auto", F.lit(False)) & F.lit(k != "id"), F.col(f"_new.{k}")).otherwise(F.col(f"_first.{k}"))
    field = lambda k: F.when(~here, added(k)).when(replace & F.lit(k != "id"), F.col(f"_new.{k}")).otherwise(F.col(f"t.{k}")).alias(k)
    merged = joined.select(*[field(k) for k in FIELDS], F.col("t.ord").alias("ord"), F.col("_first.seq").alias("seq"))
    others = [x.select(*FIELDS, "ord", F.lit(None).cast("long").alias("seq")) for x in (loose, target.where("not _is_target"))]
    return merged.unionByName(others[0]).unionByName(others[1])


def upsert_latest(products: DataFrame, batch: DataFrame, by_seq: bool = False) -> DataFrame:
    """The newest row of each store and address; rows have seq, and the batch counts as newer.

    by_seq: rows go by seq wherever they are, and the batch is newer only where that is equal, as for batches of a log
    that come in any order. Rows of the old form, keyed by the address alone, are of the same store and address, so
    they go the same way.
    """
    both = products.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return last_wins(both, ["store", "url"], ["seq", "_new"] if by_seq else ["_new", "seq"]).drop("_new")


def replace_by_id(catalog: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited rows instead of those with their id; ord of an edit puts it at the end."""
    return catalog.join(edits.select("id"), "id", "left_anti").select(catalog.columns).unionByName(edits)


def auto_products(catalog: DataFrame) -> DataFrame:
    """The collected rows of a restored catalog, which go to the product store."""
    return catalog.where(F.coalesce("auto", F.lit(False)))
