"""Filters of the catalog search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kondate import dims
from kondate.functions.text import norm_text, normalised_word


def with_search_text(catalog: DataFrame) -> DataFrame:
    """Adds search_text, normalised name and note; computed once for a catalog, not for each query."""
    return catalog.withColumn("search_text", norm_text(F.concat("name", F.lit(" "), "note")))


def keyword_match(query: str, text: str = "search_text") -> Column:
    """Every word of the query stands somewhere in the text; an empty query matches all."""
    out = F.lit(True)
    for word in normalised_word(query).split():
        out = out & F.contains(text, F.lit(word))
    return out


def bound(name: str, limit: float, least: bool = False) -> Column:
    """An inclusive bound that is off at 0; else an unknown value fails it."""
    if limit == 0:
        return F.lit(True)
    met = F.col(name) >= limit if least else F.col(name) <= limit
    return F.coalesce(met & ~F.isnan(name), F.lit(False))


def filter_items(catalog: DataFrame, stores: list[str], query: str = "", category: str = dims.ANY, minp: float = 0, maxf: float = 0, maxk: float = 0, budget: float = 0) -> DataFrame:
    met = F.col("store").isin(stores) & bound("p", minp, True) & bound("f", maxf) & bound("kcal", maxk) & bound("price", budget)
    if category != dims.ANY:
        met = met & (F.col("category") == category)
    if normalised_word(query).split():
        catalog = catalog if "search_text" in catalog.columns else with_search_text(catalog)
        met = met & keyword_match(query)
    return catalog.where(met)


def known_store(catalog: DataFrame, stores: list[str] = dims.STORES) -> DataFrame:
    return catalog.where(F.col("store").isin(stores))


def empty_result_cause(catalog: DataFrame, found: DataFrame, stores: list[str]) -> DataFrame:
    """One row: found, registered, cause (found, filtered or unregistered)."""
    hits = found.agg(F.count("*").alias("found"))
    known = catalog.where(F.col("store").isin(stores)).agg(F.count("*").alias("registered"))
    cause = F.when(F.col("found") > 0, "found").when(F.col("registered") > 0, "filtered").otherwise("unregistered")
    return hits.crossJoin(known).withColumn("cause", cause)  # one row by one row


def valid_position(lat: Column, lon: Column) -> Column:
    met = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(met, F.lit(False))
