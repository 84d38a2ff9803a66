"""Counters of a collection from its page outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kondate import dims
from kondate.operators.rank import top_k

STALE_SECONDS = 180


def count_by_store(catalog: DataFrame, stores: list[str] = dims.STORES) -> DataFrame:
    """Products of each chain, those without any included."""
    counts = catalog.groupBy("store").agg(F.count("*").alias("n"))
    return dims.stores(catalog.sparkSession, stores).join(counts, "store", "left").select("store", "store_ord", F.coalesce("n", F.lit(0)).alias("products"))


def _counters() -> list[Column]:
    kind = F.col("kind")
    return [
        F.count_if(kind.isin("detail", "generic")).alias("detail"),
        F.count_if(kind == "list").alias("lists"),
        F.count_if(F.col("outcome") == "added").alias("added"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(kind.isin("detail", "generic", "list")).alias("checked"),
    ]


def collection_progress(outcomes: DataFrame) -> DataFrame:
    """Counters per chain, and a row with store null for all, of one scan."""
    return outcomes.rollup("store").agg(*_counters())


def store_completion(progress: DataFrame, pending: DataFrame, current: str | None = None) -> DataFrame:
    """store, added, state: done without pending pages; the current chain (else the first pending) collects, others wait."""
    left = pending.groupBy("store").agg(F.min("seq").alias("seq"))
    first = left.agg(F.min_by("store", "seq").alias("first"))
    rows = progress.where("store is not null").select("store", "added").join(left, "store", "left").crossJoin(F.broadcast(first))  # one row
    active = F.coalesce(F.lit(current).cast("string"), F.col("first"))
    state = F.when(F.col("seq").isNull(), "done").when(F.col("store") == active, "collecting").otherwise("waiting")
    return rows.select("store", "added", state.alias("state"))


def completion_summary(completion: DataFrame, order: DataFrame) -> DataFrame:
    """One row: stores, done, active, position (from 1, 0 without), empty (a run that ended with nothing)."""
    placed = completion.join(order, "store")
    active = F.col("state") == "collecting"
    before = placed.agg(F.count("*").alias("stores"), F.count_if(F.col("state") == "done").alias("done"), F.max(F.when(active, F.col("store"))).alias("active"), F.max(F.when(active, F.col("store_ord"))).alias("_at"), F.collect_list("store_ord").alias("_all"), F.sum("added").alias("_added"))
    position = F.when(F.col("_at").isNull(), 0).otherwise(F.size(F.filter("_all", lambda x: x <= F.col("_at"))))
    return before.select("stores", "done", "active", position.alias("position"), ((F.col("done") == F.col("stores")) & (F.col("_added") == 0)).alias("empty"))


def recent_errors(outcomes: DataFrame, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """The last n of all, and of each chain."""
    errors = outcomes.where("reason is not null and reason <> ''")
    overall = errors.orderBy(F.desc("seq"), F.desc("url")).limit(n)
    return overall, top_k(errors, ["store"], [F.desc("seq"), F.desc("url")], n)


def reject_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'skipped'").groupBy("store", "reason").agg(F.count("*").alias("rejects"))


def heartbeat_status(beats: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """job, last, status, may_start. beats: job, ts. A running job silent for longer is interrupted; one is blocked from starting again only before that."""
    last = beats.groupBy("job").agg(F.max("ts").alias("last"))
    silent = F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.select("job", "last", F.when(silent > seconds * 1_000_000, "interrupted").otherwise("running").alias("status"), (silent >= seconds * 1_000_000).alias("may_start"))
