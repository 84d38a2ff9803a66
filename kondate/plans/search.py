"""Workloads that users call: search and recommend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kondate import dims
from kondate.functions.html import spread
from kondate.functions.text import norm_text
from kondate.operators.cart import favorites_only
from kondate.operators.filters import filter_items, with_search_text
from kondate.operators.metrics import eligible, is_balanced, pfc_distance, pfc_ratios, protein_per_100yen
from kondate.operators.rank import SORTS, paginate, sort_catalog, top_k
from kondate.operators.text_index import Runs, TextIndex, first_matches
from kondate.tables import Scratch

TARGET = (20.0, 25.0, 55.0)


def search(catalog: DataFrame, stores: list[str], query: str = "", category: str = dims.ANY, minp: float = 0, maxf: float = 0, maxk: float = 0, budget: float = 0, sort: str = "category", tp: float = 20, tf: float = 25, page: int = 1, favorites: DataFrame | None = None) -> DataFrame:
    """A page of the sorted products that fit. Protein and fat must leave room for carbohydrate in the target."""
    if tp + tf >= 100:
        raise ValueError("protein and fat must stay below 100 percent")
    found = filter_items(catalog, stores, query, category, minp, maxf, maxk, budget)
    if favorites is not None:
        found = favorites_only(found, favorites)
    return paginate(sort_catalog(found, sort, (tp, tf, 100 - tp - tf)), page)


REQUEST = "request_id string, stores array<string>, query string, category string, minp double, maxf double, maxk double, budget double, sort string, tp double, tf double, page int"


#: Rows that an index may give a search, as a multiple of what it wants, before it reads sorted runs instead.
INDEXED = 32


def _asked(requests: DataFrame) -> tuple[DataFrame, list[str]]:
    """The requests with clean columns, and the names of those by which equal searches are one."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(norm_text(F.coalesce("query", F.lit(""))), r"(?U)\s+"), lambda w: w != "")))
    asked = requests.where("tp + tf < 100").select(
        "request_id", "page", F.array_sort(F.array_distinct("stores")).alias("_stores"), words.alias("_words"), F.coalesce("category", F.lit(dims.ANY)).alias("_category"),
        "minp", "maxf", "maxk", F.col("budget").alias("_budget"), "sort", F.when(F.col("sort") == "balance", F.col("tp")).otherwise(0.0).alias("tp"), F.when(F.col("sort") == "balance", F.col("tf")).otherwise(0.0).alias("tf"),
    )
    return asked, [c for c in asked.columns if c not in ("request_id", "page")]


def _fits() -> Column:
    """Whether a product (store, p, f, kcal, price, category, search_text) fits a search."""
    within = lambda c, limit, least=False: F.coalesce((F.col(limit) == 0) | ((F.col(c) >= F.col(limit) if least else F.col(c) <= F.col(limit)) & ~F.isnan(c)), F.lit(False))
    fits = within("p", "minp", True) & within("f", "maxf") & within("kcal", "maxk") & within("price", "_budget")
    return fits & (F.col("_category").isin(dims.ANY) | (F.col("category") == F.col("_category"))) & F.forall("_words", lambda w: F.contains(F.col("search_text"), w))


def _runs(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """store, run, key and what searches test, of the rows that each order (run, sort, tp, tf) shows."""
    each = rows.crossJoin(F.broadcast(orders))  # the orders that are asked for: five, and one more for each target
    value, sort = protein_per_100yen(), F.col("sort")
    far = pfc_distance((F.col("tp"), F.col("tf"), 100 - F.col("tp") - F.col("tf")))
    shown = F.when(sort == "value", value.isNotNull()).when(sort == "balance", pfc_ratios()[0].isNotNull()).otherwise(True)
    number = F.when(sort == "category", F.array_position(F.array(*map(F.lit, dims.CATEGORIES)), F.col("category")).cast("double")).when(sort == "value", -value).when(sort == "balance", far)
    number = number.when(sort == "price", F.coalesce("price", F.lit(float("inf")))).otherwise(-F.coalesce("p", F.lit(-1.0)))
    key = F.struct(number.alias("number"), F.when(sort == "category", F.col("name")).otherwise("").alias("name"), F.col("ord").alias("ord"))
    return each.where(shown).select("store", "run", key.alias("key"), "ord", "p", "f", "kcal", "price", "category", "search_text")


MOST_TARGETS = 1000


def search_requests(catalog: DataFrame, requests: DataFrame, size: int = 20) -> DataFrame:
    """request_id, place and the catalog's columns: the page that each of many requests asks for (columns of REQUEST).

    A bound of 0 is off and a null category or query asks for nothing. Equal searches are answered once, whatever pages
    are asked for. A search with a rare word takes its candidates from an inverted index (``TextIndex``); any other reads
    its chains in its order, block by block, until no block can hold one of its rows (``first_matches``). So neither
    meets the whole catalog. There is a sorted run for each order, and one for each target of a balance: up to 1,000 of
    those, else ValueError. Requests whose target leaves no room for carbohydrate get nothing.
    """
    scratch = Scratch(catalog.sparkSession, "search")
    # requests and catalog are dealt to all cores: words and grams cost much, and a file that one task reads may hold them all
    asked, same = _asked(spread(requests))
    asked = scratch.table(asked.withColumn("search", F.sha2(F.to_json(F.struct(*same)), 256)), "asked")
    run = F.concat_ws(":", "sort", F.when(F.col("sort") == "balance", F.concat_ws(":", "tp", "tf")))
    searches = scratch.table(asked.groupBy("search").agg((F.max("page") * size).alias("wanted"), *[F.first(c).alias(c) for c in same]).withColumn("run", run), "searches")
    wanted = searches.agg(F.max("wanted")).first()[0] or 0
    rows = scratch.table(with_search_text(spread(catalog)).select("store", "ord", "name", "p", "f", "c", "kcal", "price", "unit", "category", "search_text"), "rows")
    index = TextIndex(rows.select("ord", "search_text"), scratch)
    words = scratch.table(searches.select("search", "wanted", F.explode("_words").alias("word")), "words")
    bounds = scratch.table(index.bounds(words.select("word").distinct()), "bounds")
    rarest = words.join(bounds, "word").groupBy("search", "wanted").agg(F.min(F.struct("most", "word")).alias("x"))
    rare = scratch.table(rarest.where(F.col("x.most") <= F.col("wanted") * INDEXED).select("search", "x.word"), "rare")

    orders = searches.select("run", "sort", "tp", "tf").distinct()
    if orders.limit(MOST_TARGETS + len(SORTS)).count() >= MOST_TARGETS + len(SORTS):
        raise ValueError(f"more than {MOST_TARGETS} targets")
    keyed = _runs(rows, orders)
    candidates = index.candidates(rare.select("word").distinct()).join(rare, "word").join(searches, "search")
    kept = keyed.join(candidates.withColumnsRenamed({"ord": "_ord", "run": "_run"}), (F.col("ord") == F.col("_ord")) & (F.col("run") == F.col("_run")) & F.array_contains("_stores", F.col("store")))
    by_index = kept.where(_fits()).select("search", "wanted", "key", "ord")

    others = searches.join(rare.select("search"), "search", "left_anti")
    runs = Runs(keyed.join(others.select("run").distinct(), "run", "left_semi"), scratch)
    by_runs, _ = first_matches(runs, others, _fits(), wanted, scratch)
    place = F.row_number().over(Window.partitionBy("search").orderBy("key"))
    placed = scratch.table(by_index.unionByName(by_runs).withColumn("place", place).where((F.col("place") <= wanted) & (F.col("place") <= F.col("wanted"))).select("search", "place", "ord"), "placed")
    pages = asked.select("request_id", "search", "page").join(placed, "search").where((F.col("place") <= F.col("page") * size) & (F.col("place") > (F.col("page") - 1) * size))
    return pages.select("request_id", "place", "ord").join(catalog, "ord").select("request_id", "place", *catalog.columns)


def recommend(catalog: DataFrame, target: tuple[float, float, float] = TARGET, tolerance: float = 10, k: int = 20, category: str = dims.ANY) -> DataFrame:
    """Per chain the k products within the tolerance with most protein for the money; filters come before the shuffle."""
    value = protein_per_100yen()
    rows = catalog.where(eligible() & is_balanced(target, tolerance) & value.isNotNull())
    if category != dims.ANY:
        rows = rows.where(F.col("category") == category)
    ranked = rows.withColumns({"value": value, "distance": pfc_distance(target)})
    return top_k(ranked, ["store"], [F.desc("value"), F.asc("ord")], k)
