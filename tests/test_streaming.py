"""Streams against their batch forms, and batches that run twice."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from kondate import schema
from kondate.operators.progress import heartbeat_status
from kondate.sources import io, log
from kondate.streaming import stream
from kondate.streaming.store import Conflict, ProductStore


def line(seq, url, name, price=None):
    return json.dumps({**dict.fromkeys(schema.TEXTS, ""), "store": "ポプラ", "url": url, "name": name, "price": price, "seq": seq}, ensure_ascii=False)


KIND = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema.PRODUCT)}, seq long"


def products(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", KIND).alias("x")).select("x.*")


def named(df):
    return {r["url"]: r["name"] for r in df.collect()}


def test_split_log_equals_replay(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for i in range(4):
        rows = [line(10 * i + j, f"u{(i + j) % 5}", f"n{i}{j}", float(j)) for j in range(3)]
        (log / f"part-{i}.txt").write_text("\n".join([*rows, "{broken", '{"store": "ポプラ"}']))
    store = ProductStore(spark, str(tmp_path / "store"))
    arriving = stream.read_log_stream(spark, str(log), per_trigger=1)
    stream.stream_upsert(arriving, store, str(tmp_path / "state")).awaitTermination()
    assert named(store.read()) == named(io.replay_observations(spark, str(log))) == named(io.replay_log(spark, str(log)))
    assert store._manifest()["batches"] == [[0, 3]]


def test_a_batch_twice_changes_nothing(spark, tmp_path):
    store = ProductStore(spark, str(tmp_path / "store"))
    store.upsert(products(spark, line(1, "a", "one"), line(2, "b", "two")), 0)
    for _ in range(2):
        store.upsert(products(spark, line(3, "a", "three")), 1)
        assert named(store.read()) == {"a": "three", "b": "two"}
    store.upsert(products(spark), 2)
    assert named(store.read()) == {"a": "three", "b": "two"} and named(ProductStore(spark, str(tmp_path / "none")).read()) == {}


def test_store_against_a_model(spark, tmp_path):
    rng, store, model, earlier = random.Random(2), ProductStore(spark, str(tmp_path / "store"), keep=3), {}, None
    for batch in range(11):
        rows = [(rng.randrange(50), f"u{rng.randrange(12)}", f"n{batch}-{i}") for i in range(rng.choice([1, 5, 20]))]
        rows = list({(s, u): (s, u, n) for s, u, n in rows}.values())  # within a batch one row of each seq and address
        store.upsert(products(spark, *(line(*r) for r in rows)), batch)
        for seq, url, name in rows:
            if seq >= model.get(url, (-1, ""))[0]:
                model[url] = (seq, name)
        assert named(store.read()) == {u: n for u, (_, n) in model.items()}
        if batch == 8:
            earlier, before = store.versions()[-1], dict(model)
    assert named(store.read(earlier)) == {u: n for u, (_, n) in before.items()} if earlier in store.versions() else len(store.versions()) == 3
    runs = store._manifest()["runs"]
    assert len(runs) <= 6 and sum(r["tier"] == 0 for r in runs) < 4
    assert {f"runs/{x.name}" for x in (tmp_path / "store" / "runs").iterdir() if x.is_dir()} == {r["path"] for v in store.versions() for r in store._manifest(v)["runs"]}
    assert named(store.lookup([("ポプラ", "u3"), ("ポプラ", "none")])) == {"u3": model["u3"][1]}


def test_a_batch_writes_itself_and_not_the_store(spark, tmp_path):
    store = ProductStore(spark, str(tmp_path / "store"))
    store.upsert(products(spark, *(line(i, f"u{i}", "x" * 50) for i in range(3000))), 0)
    large = store._manifest()["runs"][0]
    store.upsert(products(spark, line(9999, "u5", "new")), 1)
    small = next(r for r in store._manifest()["runs"] if r["path"] != large["path"])
    assert large in store._manifest()["runs"] and small["rows"] == 1 and small["bytes"] < large["bytes"]
    assert named(store.lookup([("ポプラ", "u5")])) == {"u5": "new"}


def test_a_second_writer_fails(spark, tmp_path):
    store = ProductStore(spark, str(tmp_path / "store"))
    store.upsert(products(spark, line(1, "a", "one")), 0)
    stale = store._manifest(store.versions()[-1]) | {"version": store.versions()[-1] - 1}
    with pytest.raises(Conflict):
        store._commit(stale, [], [])
    assert named(store.read()) == {"a": "one"}


def test_log_source_over_files_cut_anywhere(spark, tmp_path, monkeypatch):
    text = "".join(line(0, f"u{i % 7}", f"n{i}") + ("\r\n" if i % 3 else "\n") for i in range(40)) + line(0, "u3", "last, without an end")
    (tmp_path / "log.txt").write_text(text)
    whole = [(x["at"], x["value"]) for x in _lines(spark, tmp_path / "log.txt")]
    assert [v for _, v in whole] == [x.rstrip("\r") for x in text.split("\n")] and all(text.encode()[at:].startswith(v.encode()) for at, v in whole)
    files, _ = log._files(str(tmp_path / "log.txt"))
    for size in (1, 7, 100, 333, len(text.encode())):
        monkeypatch.setattr(log, "PART", size)
        parts = log._parts(files, {}, {str(tmp_path / "log.txt"): len(text.encode())})
        assert [(at, x.removesuffix(b"\r").decode()) for p in parts for at, x in log.read_lines(files, p)] == whole
    assert named(io.replay_log(spark, str(tmp_path / "log.txt"))) == named(io.replay_observations(spark, str(tmp_path / "log.txt")))


def _lines(spark, path):
    log.register(spark)
    return spark.read.format(log.NAME).load(str(path)).orderBy("at").collect()


def test_log_that_grows_within_its_files(spark, tmp_path):
    folder, store = tmp_path / "log", ProductStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    rows = [line(i, f"u{i % 5}", f"n{i}") for i in range(30)]
    data = ("\n".join(rows) + "\n").encode()
    for begin, end in ((0, 100), (100, 1500), (1500, 1501), (1501, len(data))):
        with (folder / "a.txt").open("ab") as out:
            out.write(data[begin:end])
        stream.stream_upsert(stream.read_growing_log(spark, str(folder)), store, str(tmp_path / "state")).awaitTermination()
        lines = data[:end].rpartition(b"\n")[0].decode().split("\n") if b"\n" in data[:end] else []
        assert named(store.read()) == {json.loads(x)["url"]: json.loads(x)["name"] for x in lines}


def test_job_events_and_their_edges(spark, tmp_path):
    at = lambda x: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=round(x * 1e6))
    batches = [
        [("a", 0, "start"), ("a", 179.999, "start"), ("b", 0, "start"), ("c", 5, "beat"), ("d", 0, "start"), ("e", 0, "stop")],
        [("a", 180, "start"), ("b", 180.001, "start"), ("c", 180.5, "stop"), ("c", 100, "beat"), ("d", 180, "beat")],
        [("a", 200, "stop"), ("a", 201, "start"), ("f", 1000, "start")],
        [("d", 2000, "beat"), ("g", 2400, "beat")],
    ]
    schema_, folder = "job string, ts timestamp, kind string", tmp_path / "in"
    for rows in batches:
        spark.createDataFrame([(j, at(t), k) for j, t, k in rows], schema_).coalesce(1).write.mode("append").parquet(str(folder))
        arriving = spark.readStream.schema(schema_).parquet(str(folder))
        stream.stream_job_events(arriving, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = sorted((r["job"], (r["at"] - at(0)).total_seconds(), r["what"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == sorted([
        ("a", 0.0, "started"), ("a", 179.999, "refused"), ("a", 180.0, "started"), ("a", 200.0, "ended"), ("a", 201.0, "started"), ("a", 381.0, "interrupted"),
        ("b", 0.0, "started"), ("b", 180.0, "interrupted"), ("b", 180.001, "started"), ("b", 360.001, "interrupted"),
        ("c", 5.0, "resumed"), ("c", 180.5, "ended"), ("d", 0.0, "started"), ("d", 360.0, "interrupted"), ("d", 2000.0, "resumed"), ("d", 2180.0, "interrupted"),
        ("f", 1000.0, "started"), ("f", 1180.0, "interrupted"), ("g", 2400.0, "resumed"),
    ])


def test_heartbeat_edges(spark):
    beats = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00.000001"), ("c", "2023-12-31 23:59:59.999999")], "job string, ts string").withColumn("ts", F.to_timestamp("ts"))
    found = {r["job"]: (r["status"], r["may_start"]) for r in heartbeat_status(beats, F.lit("2024-01-01 00:03:00").cast("timestamp")).collect()}
    assert found == {"a": ("running", True), "b": ("running", False), "c": ("interrupted", True)}
