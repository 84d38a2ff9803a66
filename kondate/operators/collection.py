"""Collections over stored pages that can be stopped and go on: queue, addresses, counters and visits in epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kondate import dims, schema
from kondate.functions.extract import extract_products, shared_host_guard
from kondate.functions.html import spread
from kondate.functions.urls import canonical_url, original_host, page_kind
from kondate.operators.frontier import MOST_ADDED, MOST_DEPTH, MOST_DETAIL, MOST_LISTS, MOST_PENDING, extract_links, next_frontier, skip_recent, visit_budget
from kondate.operators.seen import SeenSet
from kondate.tables import Scratch

COUNTED = ("added", "detail", "lists", "skipped", "errors")
COUNTS = "store string, " + ", ".join(f"{c} long" for c in COUNTED)
KEEPS = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.PRODUCT)
VISITS = f"store string, url string, depth int, seq long, kind string, outcome string, reason string, product struct<{KEEPS}>"


class Collection:
    """A collection in a folder, which holds an epoch for each level that was done.

    An epoch is a folder with the queue after it (pending), its visits, and the counters of all chains so far, and counts
    once its mark is written, after the tables: a run that ends in between leaves the last whole epoch, from which any
    later run goes on, in another session or with more chains. What was ever queued stands in a set in buckets
    (``SeenSet``), to which a level is added before it is visited, so nothing is queued twice.

    pages: url, html; hosts: store, host of each chain; products: store, url, checked. A level's pages are looked up,
    extracted and held to their chain (``shared_host_guard``); pages whose product is of the run date are left out, and
    the budget of a chain, carried from level to level, says which of the others are visited. Links of visited pages
    that could be read come behind the level in the queue, as far as it has room. The outcome of a visit is added, skipped
    (with a reason), list, or error: an address without a stored page, or a page that can't be parsed (with its fault).
    """

    def __init__(
        self, folder: str, pages: DataFrame, hosts: DataFrame | None, products: DataFrame, run_date: str, most_depth: int = MOST_DEPTH,
        limits: tuple[int, int, int] = (MOST_ADDED, MOST_DETAIL, MOST_LISTS), most_pending: int = MOST_PENDING, canonical=canonical_url, kind_of=page_kind, original=original_host, buckets: int = 32,
    ):
        self.spark, self.folder, self.run_date, self.products = pages.sparkSession, folder, run_date, products
        self.hosts = dims.hosts(self.spark).select("store", "host") if hosts is None else hosts
        self.most_depth, self.limits, self.most_pending, self.kind_of, self.original, self.canonical = most_depth, limits, most_pending, kind_of, original, canonical
        self.scratch, self.seen = Scratch(self.spark, "collect"), SeenSet(self.spark, f"{folder}/seen", buckets)
        # dealt by their content, as a file that one task reads may hold them all; addresses are made canonical behind that
        dealt = pages.select("url", "html").repartition(3 * self.spark.sparkContext.defaultParallelism, "url", "html")
        self.stored = self.scratch.table(dealt.groupBy(canonical(F.col("url")).alias("url")).agg(F.min("html").alias("html")).where("url <> ''"), "pages")

    # -- epochs

    def _file(self, *parts: object):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, (self.folder, *parts))))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def epoch(self) -> int:
        """The last whole epoch; -1 before a start."""
        path, files = self._file()
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return max((int(x) for x in names if x.isdigit() and files.exists(self._file(x, "COMMITTED")[0])), default=-1)

    def _read(self, kind: str, what: str, *epochs: int) -> DataFrame:
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{e}/{what}" for e in epochs])

    def _commit(self, epoch: int, pending: DataFrame, visits: DataFrame, counts: DataFrame) -> None:
        for what, table in (("pending", pending), ("visits", visits), ("counts", counts)):
            table.write.mode("overwrite").parquet(f"{self.folder}/{epoch}/{what}")
        path, files = self._file(epoch, "COMMITTED")
        files.create(path, True).close()

    def pending(self) -> DataFrame:
        """store, url, depth, seq of what waits."""
        return self._read(schema.FRONTIER, "pending", self.epoch())

    def counts(self) -> DataFrame:
        """store and its counters, of all chains that have been started."""
        return self._read(COUNTS, "counts", self.epoch())

    def visits(self) -> DataFrame:
        """VISITS of all epochs; the products added are what ``catalog.upsert_latest`` takes."""
        return self._read(VISITS, "visits", *range(self.epoch() + 1))

    # -- running

    def start(self, seeds: DataFrame) -> None:
        """Queue the seeds (store, url, depth, seq) of chains that have no counters yet; on resuming those are the new ones."""
        epoch = self.epoch()
        rows = seeds.where("url <> ''").groupBy("store", "url").agg(F.min(F.struct("seq", "depth")).alias("x")).select("store", "url", F.col("x.depth").cast("int").alias("depth"), F.col("x.seq").cast("long").alias("seq"))
        if epoch >= 0:
            rows = rows.join(self.counts().select("store"), "store", "left_anti")
            if not rows.limit(1).count():
                return
        zero = rows.select("store").distinct().select("store", *[F.lit(0).cast("long").alias(c) for c in COUNTED])
        pending, counts = (rows, zero) if epoch < 0 else (rows.unionByName(self.pending()), zero.unionByName(self.counts()))
        self._commit(epoch + 1, pending, self.spark.createDataFrame([], VISITS), counts)

    def step(self) -> bool:
        """Visit what waits, one level of every chain, and commit what came of it; False if nothing waits."""
        epoch = self.epoch()
        level, counts = self.pending(), self.counts()
        if not level.limit(1).count():
            return False
        self.seen.add(level, epoch)
        name = f"{epoch}-{self.scratch.root[-8:]}"
        # written, as every filter on a kind would work it out again; the level is dealt to all cores first
        kinds = self.scratch.table(spread(level).withColumn("kind", self.kind_of(F.col("url"))), f"kinds-{name}").where("kind <> ''")
        due = kinds.where("kind = 'list'").unionByName(skip_recent(kinds.where("kind <> 'list'"), self.products, self.run_date))
        found = extract_products(due.join(self.stored, "url", "left").withColumn("stored", F.col("html").isNotNull()), self.run_date, None, self.original)
        held = shared_host_guard(found, self.hosts).withColumn("product", F.when(F.col("stored") & (F.col("kind") != "list"), F.col("product")))
        held = self.scratch.table(held.withColumn("gains", F.col("product").isNotNull().cast("int")), f"extracted-{name}")
        here = self.scratch.table(visit_budget(held, counts.select("store", "added", "detail", "lists"), self.limits), f"visited-{name}")
        broken = ~F.col("stored") | F.col("page.fault").isNotNull()
        outcome = F.when(broken, "error").when(F.col("kind") == "list", "list").when(F.col("gains") == 1, "added").otherwise("skipped")
        reason = F.when(outcome == "skipped", F.col("reason")).when((outcome == "error") & F.col("stored"), F.col("page.fault")).otherwise("")
        visits = self.scratch.table(here.select("store", "url", "depth", "seq", "kind", outcome.alias("outcome"), reason.alias("reason"), "product"), f"outcomes-{name}")
        links = extract_links(here.where(F.col("stored") & (F.col("depth") < self.most_depth)), self.hosts, self.canonical, self.kind_of, self.original)
        is_list, is_outcome = F.col("kind") == "list", lambda x: F.col("outcome") == x
        new = visits.groupBy("store").agg(F.count_if(is_outcome("added")).alias("added"), F.count_if(~is_list).alias("detail"), F.count_if(is_list).alias("lists"), F.count_if(is_outcome("skipped")).alias("skipped"), F.count_if(is_outcome("error")).alias("errors"))
        self._commit(epoch + 1, next_frontier(links, level, self.seen, self.most_pending), visits, counts.unionByName(new).groupBy("store").agg(*[F.sum(c).alias(c) for c in COUNTED]))
        return True

    def run(self, levels: int | None = None) -> str:
        """Go on for so many levels, or to the end: paused, done, or empty (nothing was added)."""
        done = 0
        while (levels is None or done < levels) and self.step():
            done += 1
        if self.pending().limit(1).count():
            return "paused"
        return "done" if self.counts().where("added > 0").limit(1).count() else "empty"


def collect_pages(
    pages: DataFrame, seeds: DataFrame, hosts: DataFrame | None, products: DataFrame, run_date: str, most_depth: int = MOST_DEPTH,
    limits: tuple[int, int, int] = (MOST_ADDED, MOST_DETAIL, MOST_LISTS), most_pending: int = MOST_PENDING, canonical=canonical_url, kind_of=page_kind, original=original_host, buckets: int = 4,
) -> DataFrame:
    """VISITS of a whole collection from the seeds, in a folder of this application."""
    folder = Scratch(pages.sparkSession, "collection").path("epochs")
    whole = Collection(folder, pages, hosts, products, run_date, most_depth, limits, most_pending, canonical, kind_of, original, buckets)
    whole.start(seeds)
    whole.run()
    whole.seen.close()
    return whole.visits()
