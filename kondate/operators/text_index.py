"""An inverted index of short runs of characters, and sorted runs in blocks: what searches of many requests read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kondate.tables import Scratch

#: Characters of the longest grams; a shorter word is a gram itself.
LONGEST = 3
#: Products of a posting block, and rows of a block of a run.
POSTING, BLOCK = 4096, 128


def _grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of n characters."""
    width = F.lit(n) if isinstance(n, int) else n
    starts = F.sequence(F.lit(1), F.length(text) - width + 1)
    return F.when(F.length(text) >= width, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, width)))).otherwise(F.array().cast("array<string>"))


def word_grams(word: Column) -> Column:
    """The grams that a text with the word has: its own of three characters, or the word, if it is shorter."""
    return _grams(word, F.least(F.lit(LONGEST), F.length(word)))


class TextIndex:
    """Posting lists of the grams of search_text, in blocks by product number, as a written table.

    catalog: ord (a number that names a product) and search_text. A gram that all products have makes a block of 4,096
    numbers for each 4,096 products, so lists of any length are many short rows.
    """

    def __init__(self, catalog: DataFrame, scratch: Scratch):
        self.rows, self.scratch = catalog, scratch
        grams = F.flatten(F.array(*[_grams(F.col("search_text"), n) for n in range(1, LONGEST + 1)]))
        each = catalog.select(F.floor(F.col("ord") / POSTING).alias("block"), "ord", F.explode(grams).alias("gram"))
        self.postings = scratch.table(each.groupBy("gram", "block").agg(F.sort_array(F.collect_list("ord")).alias("ords")), "postings")

    def bounds(self, words: DataFrame) -> DataFrame:
        """word, most: how many products can have it at most, by its rarest gram; 0 for a gram that none has."""
        grams = words.select("word", F.explode(word_grams(F.col("word"))).alias("gram"))
        needed = self.postings.join(grams.select("gram").distinct(), "gram", "left_semi")
        sizes = needed.groupBy("gram").agg(F.sum(F.size("ords")).alias("n"))
        return grams.join(sizes, "gram", "left").groupBy("word").agg(F.min(F.coalesce("n", F.lit(0))).alias("most"))

    def candidates(self, words: DataFrame) -> DataFrame:
        """word, ord of the products that have all grams of a word, by intersecting its lists block by block."""
        grams = words.select("word", F.explode(word_grams(F.col("word"))).alias("gram"))
        met = grams.join(self.postings, "gram").groupBy("word", "block").agg(F.collect_list("ords").alias("lists"))
        whole = met.join(words.select("word", F.size(word_grams(F.col("word"))).alias("grams")), "word").where(F.size("lists") == F.col("grams"))
        common = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)
        return whole.select("word", F.explode(common).alias("ord"))


class Runs:
    """The rows of each chain in each order, sorted and cut into blocks of which the first key is known, as written tables.

    keyed: store, run (the order's name), key (a struct that orders), and what searches test. Ranges are sorted side by
    side; a block has no more than `BLOCK` rows of one chain and order.
    """

    def __init__(self, keyed: DataFrame, scratch: Scratch):
        ranges = keyed.repartitionByRange("store", "run", "key").sortWithinPartitions("store", "run", "key")
        rows = scratch.table(ranges.withColumn("_piece", F.floor(F.monotonically_increasing_id() / BLOCK)), "sorted")
        pieces = rows.groupBy("store", "run", "_piece").agg(F.min("key").alias("first"))
        number = F.row_number().over(Window.partitionBy("store", "run").orderBy("first")) - 1
        self.blocks = scratch.table(pieces.withColumn("block", number), "blocks")
        self.rows = scratch.table(rows.join(self.blocks.select("store", "run", "_piece", "block"), ["store", "run", "_piece"]).drop("_piece"), "runs")


def first_matches(runs: Runs, searches: DataFrame, fits: Column, wanted: int, scratch: Scratch, first_blocks: int = 2) -> tuple[DataFrame, DataFrame]:
    """search, key, ord of the first rows, in order, that fit each search, `wanted` at most; and reads (search, blocks).

    searches: search, run, _stores, wanted and what `fits` compares rows with. Blocks are read in order, four times as
    many in each round; a chain is done with for a search when as many rows as it wants have keys below the chain's
    next block, which then can't hold one of them, or when it has no more blocks.
    """
    chains = scratch.table(searches.select("*", F.explode(F.array_distinct("_stores")).alias("_store")), "chains")
    found, reads, low, high, active = None, None, 0, first_blocks, chains.select("search", "_store")
    while True:
        asking = chains.join(active, ["search", "_store"], "left_semi")
        rows = runs.rows.where((F.col("block") >= low) & (F.col("block") < high))
        met = rows.join(asking, (rows["store"] == asking["_store"]) & (rows["run"] == asking["run"]))
        new = met.where(fits).select("search", "wanted", "key", "ord")
        new = new if found is None else new.unionByName(found)
        place = F.row_number().over(Window.partitionBy("search").orderBy("key"))
        found = scratch.table(new.withColumn("_n", place).where((F.col("_n") <= wanted) & (F.col("_n") <= F.col("wanted"))).drop("_n"), f"found-{high}")
        read = active.withColumn("to", F.lit(high))
        reads = read if reads is None else reads.unionByName(read)
        last = found.groupBy("search").agg(F.count("*").alias("_have"), F.max("key").alias("_last"))
        following = runs.blocks.where(F.col("block") == high).select(F.col("store").alias("_store"), "run", "first")
        left = asking.join(following, ["_store", "run"]).join(last, "search", "left")
        open_ = F.coalesce(F.col("_have"), F.lit(0)) < F.col("wanted")
        active = scratch.table(left.where(open_ | (F.col("first") < F.col("_last"))).select("search", "_store"), f"active-{high}")
        if not active.limit(1).count():
            return found, reads.groupBy("search", "_store").agg(F.max("to").alias("blocks"))
        low, high = high, high * 4

