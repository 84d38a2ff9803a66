"""Ranking, sorting, last-wins and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kondate import dims
from kondate.operators.metrics import pfc_distance, pfc_ratios, protein_per_100yen

SORTS = ("category", "value", "protein", "balance", "price")


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark prunes by rank before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key. A maximum of structs combines before the shuffle, unlike a window."""
    rest = [x for x in df.columns if x not in keys]
    newest = F.max(F.struct(*order, *[x for x in rest if x not in order])).alias("_last")
    return df.groupBy(*keys).agg(newest).select(*[F.col(k) if k in keys else F.col(f"_last.{k}") for k in df.columns])


def sort_keys(catalog: DataFrame, mode: str, target: tuple[float, float, float] = (20, 25, 55), names: list[str] = dims.CATEGORIES) -> tuple[DataFrame, list[Column]]:
    """The rows that a mode shows and its order, which ends in ord."""
    last = F.asc("ord")
    if mode == "category":
        place = F.array_position(F.array(*map(F.lit, names)), F.col("category"))
        return catalog, [F.asc(place), F.asc("name"), last]
    if mode == "value":
        return catalog.where(protein_per_100yen().isNotNull()), [F.desc(protein_per_100yen()), last]
    if mode == "balance":
        return catalog.where(pfc_ratios()[0].isNotNull()), [F.asc(pfc_distance(target)), last]
    if mode == "price":
        return catalog, [F.asc_nulls_last("price"), last]
    return catalog, [F.desc(F.coalesce("p", F.lit(-1.0))), last]


def sort_catalog(catalog: DataFrame, mode: str, target: tuple[float, float, float] = (20, 25, 55)) -> DataFrame:
    rows, order = sort_keys(catalog, mode, target)
    return rows.orderBy(*order)


def paginate(ordered: DataFrame, page: int, size: int = 20) -> DataFrame:
    """A page of a sorted DataFrame; with its sort it becomes a top-n, not a full sort."""
    return ordered.limit(page * size).offset((page - 1) * size)


def page_count(found: DataFrame, size: int = 20) -> DataFrame:
    return found.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("long").alias("pages"))


def _before(df: DataFrame, group: str, order: list[str], values: dict[str, Column], fold: Callable, both: Callable, parts: int) -> DataFrame:
    """Adds what a fold gives for values over the rows of the group before each row. The first of `order` is a number.

    A group may hold most of the rows, so it is cut into ranges of the first order column, each of which is a window
    of its own; a table of groups x parts folds gives what stands before a range. One pass finds the ends of the ranges.
    """
    first = order[0]
    ends = df.agg(F.min(first).alias("low"), F.max(first).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    ranged = df.withColumn("_range", F.least(F.lit(parts - 1), F.floor((F.col(first) - low) * parts / F.lit(float(high - low + 1)))).cast("int"))
    whole = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(group, "_range").agg(*[fold(v).alias(f"_fold_{n}") for n, v in values.items()])
    sums = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), *[fold(f"_fold_{n}").over(whole).alias(f"_before_{n}") for n in values])
    within = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({f"_in_{n}": fold(v).over(within) for n, v in values.items()})
    rows = rows.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return rows.select(*df.columns, *[both(F.col(f"_in_{n}"), F.col(f"_before_{n}")).alias(n) for n in values])


def sums_before(df: DataFrame, group: str, order: list[str], values: dict[str, Column], parts: int = 64) -> DataFrame:
    """Adds the sums of values over the rows of the group before each row, 0 where there are none."""
    return _before(df, group, order, values, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), parts)


def mins_before(df: DataFrame, group: str, order: list[str], values: dict[str, Column], parts: int = 64) -> DataFrame:
    """Adds the least of values over the rows of the group before each row, null where there are none."""
    return _before(df, group, order, values, F.min, F.least, parts)


def running(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """The sum of a value over the rows of the group before each row."""
    return sums_before(df, group, [order], {name: value})
