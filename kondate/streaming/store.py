"""A product store of sorted runs: a batch writes only itself, reads merge, and runs of a tier are compacted into one."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kondate import schema
from kondate.functions.urls import task_key
from kondate.operators.rank import last_wins

ROWS = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema.PRODUCT)}, seq long, batch long, key string"
COLUMNS = [*schema.PRODUCT.names, "seq"]
#: Rows of a file of a run, about; a larger run has more files, each with a range of keys of its own.
FILE_ROWS = 1_000_000
#: Runs of a tier that are merged into one of the next.
FAN = 4


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


class ProductStore:
    """Products by store and address, the row with the largest seq each (of equal ones, that of the later batch).

    A run is a folder of Parquet files that are sorted by key, with the keys' range in its entry and in the files' footers, and Bloom
    filters of the keys. A version is a small file that names the runs that count and the batches that are in; it is
    written last, and under a name that can be taken once, so readers see whole batches, a batch that comes again changes
    nothing, and a second writer fails instead of losing rows. A reader keeps to the version that it began with; runs go
    when none of the last `keep` versions names them. A batch is a run of the first tier and four runs of a tier become one of
    the next, so a row is written again log4(batches) times in all, whatever part of the store a batch touches. One
    writer at a time is meant.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 8):
        self.spark, self.folder, self.keep = spark, folder, keep

    # -- versions

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, (self.folder, *parts))))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        files, path = self._files(), self._path("versions")
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(x) for x in names if x.isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        version = version if version is not None else max(self.versions(), default=-1)
        if version < 0:
            return {"version": -1, "runs": [], "batches": []}
        opened = self._files().open(self._path("versions", version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def _commit(self, before: dict, runs: list[dict], batches: list[list[int]]) -> dict:
        """Write the next version under a name of its own and rename it: that succeeds once."""
        after = {"version": before["version"] + 1, "runs": runs, "batches": batches}
        draft, final, files = self._path("versions", f"draft-{uuid.uuid4().hex}"), self._path("versions", after["version"]), self._files()
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(after), "utf-8"))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"version {after['version']} is there already")
        return after

    # -- runs

    def _write_run(self, rows: DataFrame, tier: int = 0) -> dict | None:
        """A sorted run of the newest rows of each key; None if there are none."""
        name = f"runs/{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        rows.select([c.split()[0] for c in ROWS.split(", ")]).write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(FILE_ROWS)).parquet(path)
        ends = self.spark.read.schema(ROWS).parquet(path).agg(F.count("*").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last")).first()
        if not ends["rows"]:
            self._files().delete(self._path(name), True)
            return None
        size = self._files().getContentSummary(self._path(name)).getLength()
        return {"path": name, "tier": tier, "rows": ends["rows"], "first": ends["first"], "last": ends["last"], "bytes": size}

    def _sorted(self, rows: DataFrame, count: int) -> DataFrame:
        return rows.repartitionByRange(max(1, math.ceil(count / FILE_ROWS)), "key").sortWithinPartitions("key")

    def _rows(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(*[f"{self.folder}/{r['path']}" for r in runs]) if runs else self.spark.createDataFrame([], ROWS)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return last_wins(rows, ["key"], ["seq", "batch"])

    # -- use

    def read(self, version: int | None = None) -> DataFrame:
        """The products (and seq) of the newest version, or of an earlier one that is still kept."""
        return self._newest(self._rows(self._manifest(version)["runs"])).select(COLUMNS)

    def lookup(self, keys: list[tuple[str, str]], version: int | None = None) -> DataFrame:
        """The products of some (store, url): only runs whose range holds one are read, and of these, by footer and filter, few row groups."""
        names = sorted(f"{store}|{url}" for store, url in keys)
        runs = [r for r in self._manifest(version)["runs"] if any(r["first"] <= x <= r["last"] for x in names)]
        return self._newest(self._rows(runs).where(F.col("key").isin(names))).select(COLUMNS)

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch (products and seq) as a run. A batch that is in already changes nothing."""
        now = self._manifest()
        if any(low <= batch_id <= high for low, high in now["batches"]):
            return
        keyed = rows.select(COLUMNS).withColumns({"batch": F.lit(batch_id).cast("long"), "key": task_key(F.col("store"), F.col("url"))})
        run = self._write_run(self._newest(keyed).sortWithinPartitions("key"))
        now = self._commit(now, [*now["runs"], *([run] if run else [])], _with_batch(now["batches"], batch_id))
        while merged := self._compact(now):
            now = merged
        self._retire()

    def _compact(self, now: dict) -> dict | None:
        """Merge the runs of the lowest tier that has as many as it may hold; None if there is none."""
        tiers: dict[int, list[dict]] = {}
        for run in now["runs"]:
            tiers.setdefault(run["tier"], []).append(run)
        for tier, runs in sorted(tiers.items()):
            if len(runs) >= FAN:
                count = sum(r["rows"] for r in runs)
                merged = self._write_run(self._sorted(self._newest(self._rows(runs)), count), tier + 1)
                gone = {r["path"] for r in runs}
                return self._commit(now, [*(r for r in now["runs"] if r["path"] not in gone), merged], now["batches"])
        return None

    def _retire(self) -> None:
        """Remove versions but the last ones, and the runs that none of these names."""
        versions = self.versions()
        for version in versions[: -self.keep]:
            self._files().delete(self._path("versions", version), False)
        named = {r["path"] for v in versions[-self.keep :] for r in self._manifest(v)["runs"]}
        for x in self._files().listStatus(self._path("runs")) if self._files().exists(self._path("runs")) else []:
            if (name := f"runs/{x.getPath().getName()}") not in named:
                self._files().delete(self._path(name), True)


def _with_batch(batches: list[list[int]], batch: int) -> list[list[int]]:
    """Ranges of batches with one more: batches come nearly in order, so ranges stay few."""
    out: list[list[int]] = []
    for low, high in sorted([*batches, [batch, batch]]):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out
