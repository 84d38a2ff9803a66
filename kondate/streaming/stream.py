"""The collection as streams: upserts, counters, heartbeats and extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kondate import dims
from kondate.functions.extract import extract_products
from kondate.operators.progress import STALE_SECONDS, _counters
from kondate.sources import log
from kondate.sources.io import typed_lines
from kondate.streaming.store import ProductStore


def read_log_stream(spark: SparkSession, path: str, stores: list[str] = dims.STORES, per_trigger: int | None = None) -> DataFrame:
    """Typed rows of a growing log; lines that can't be used are skipped."""
    reader = spark.readStream.schema("value string")
    return typed_lines((reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).text(path), stores)


def read_growing_log(spark: SparkSession, path: str, stores: list[str] = dims.STORES) -> DataFrame:
    """As ``read_log_stream``, also of files that grow: what comes behind a file's last whole line is read when its line ends."""
    log.register(spark)
    return typed_lines(spark.readStream.format(log.NAME).load(path), stores)


def stream_upsert(rows: DataFrame, store: ProductStore, checkpoint: str) -> StreamingQuery:
    """Every batch of rows goes into the store once."""
    return rows.writeStream.foreachBatch(store.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_progress(outcomes: DataFrame, name: str, checkpoint: str, seconds: int = 3, available_now: bool = False) -> StreamingQuery:
    """Counters per chain, kept up to date in a table in memory; the state is one row per chain."""
    counted = outcomes.groupBy("store").agg(*_counters())
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
    return counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def heartbeat_sessions(beats: DataFrame, seconds: int = STALE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """job, start, last, beats: spells of a job without a silence of more than `seconds`. Works on batches and streams."""
    spells = beats.withWatermark("ts", late).groupBy("job", F.session_window("ts", f"{seconds} seconds").alias("spell")).agg(F.count("*").alias("beats"))
    return spells.select("job", F.col("spell.start").alias("start"), (F.col("spell.end") - F.expr(f"interval {seconds} seconds")).alias("last"), "beats")


JOB_EVENT = "job string, at timestamp, what string"


def job_events(arriving: DataFrame, seconds: int = STALE_SECONDS) -> DataFrame:
    """job, at, what (JOB_EVENT) from a stream of job, ts, kind (beat, start or stop): what becomes of each job.

    started: a start while nothing runs, or `seconds` and more after the last sign of life; refused: a start before that.
    resumed: a beat of a job that isn't running. interrupted: more than `seconds` went by without a sign, at the moment
    when they were over; ended: a stop. Between two rows that come in, a silence is seen from their times, wherever
    batches are cut; one that nothing ends is seen by a timer, once the watermark has passed its end. The state is one
    row per job; a job's rows of a batch are sorted in its task, so a trigger bounds them. Rows of a batch go by
    time; those that come in a later batch than newer ones of any job are late and are left out.
    """
    silence = seconds * 1_000_000

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, running = state.get if state.exists else (None, False)
        out: list[tuple[int, str]] = []
        if state.hasTimedOut:
            out.append((last + silence, "interrupted"))
            running = False
        else:
            rows = pd.concat(list(parts))
            micros = rows["ts"].astype("datetime64[us]").astype("int64")
            for at, kind in sorted(zip(micros, rows["kind"], strict=True)):
                at = at if last is None else max(at, last)
                if running and at - last > silence:
                    out.append((last + silence, "interrupted"))
                    running = False
                if kind == "start" and running and at - last < silence:
                    out.append((at, "refused"))
                    continue
                if kind == "stop":
                    if running:
                        out.append((at, "ended"))
                    last, running = at, False
                    continue
                if kind == "start" or not running:
                    out.append((at, "started" if kind == "start" else "resumed"))
                last, running = at, True
        if last is not None:
            state.update((last, running))
        if running:
            state.setTimeoutTimestamp(max(-(-(last + silence) // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"job": [key[0]] * len(out), "at": pd.Series([a for a, _ in out], dtype="int64").astype("datetime64[us]"), "what": [w for _, w in out]})

    events = arriving.withWatermark("ts", "0 seconds").groupBy("job")
    return events.applyInPandasWithState(follow, JOB_EVENT, "last long, running boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_job_events(arriving: DataFrame, folder: str, checkpoint: str, seconds: int = STALE_SECONDS) -> StreamingQuery:
    """``job_events`` as rows in a folder of Parquet files."""
    found = job_events(arriving, seconds)
    return found.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_extract(pages: DataFrame, run_date: str, rejects: str, store: ProductStore, checkpoint: str) -> StreamingQuery:
    """Products of arriving pages (url, html) into the store, rejected pages to a folder."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = extract_products(batch, run_date).drop("page").persist()
        found.where("reason <> ''").select("url", "reason").write.mode("overwrite").parquet(f"{rejects}/{batch_id}")
        store.upsert(found.where("reason = ''").select("product.*", F.lit(batch_id).cast("long").alias("seq")), batch_id)
        found.unpersist()

    return pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
