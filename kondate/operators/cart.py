"""Carts and favorites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kondate import schema
from kondate.operators.metrics import pfc_ratios

MOST, LEAST = 100.0, 0.25


def cart_lines(cart: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lines with their product's numbers; unknown products fall away."""
    return cart.join(catalog.select(F.col("id").alias("product_id"), *schema.NUMBERS), "product_id")


def cart_totals(lines: DataFrame) -> DataFrame:
    """Per cart the five sums of quantity times value, each null if any value is; the ratios of the sums, and whether any is missing."""
    known = lambda n: F.count_if(F.col(n).isNull()) == 0
    sums = [F.when(known(n), F.sum(F.col("qty") * F.col(n))).alias(n) for n in schema.NUMBERS]
    missing = F.count_if(F.greatest(*[F.col(n).isNull().cast("int") for n in schema.NUMBERS]) > 0) > 0
    totals = lines.groupBy("cart_id").agg(*sums, missing.alias("missing"))
    return totals.withColumns(dict(zip(("p_pct", "f_pct", "c_pct"), pfc_ratios(), strict=True)))


def favorites_only(catalog: DataFrame, favorites: DataFrame) -> DataFrame:
    return catalog.join(favorites.select(F.col("product_id").alias("id")), "id", "left_semi")


def favorites_of_users(catalog: DataFrame, favorites: DataFrame) -> DataFrame:
    """user_id and the products that are a favorite of each user."""
    return favorites.select("user_id", F.col("product_id").alias("id")).distinct().join(catalog, "id")


def prune_orphans(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cart lines or favorites whose product exists."""
    return rows.join(catalog.select(F.col("id").alias("product_id")), "product_id", "left_semi").select(rows.columns)


def add_to_cart(cart: DataFrame, added: DataFrame) -> DataFrame:
    """One more of each added (cart_id, product_id), never more than MOST."""
    more = added.groupBy("cart_id", "product_id").agg(F.count("*").cast("double").alias("more"))
    both = cart.join(more, ["cart_id", "product_id"], "full_outer")
    qty = F.least(F.lit(MOST), F.coalesce("qty", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)))
    return both.select("cart_id", "product_id", F.when(F.col("more").isNull(), F.col("qty")).otherwise(qty).alias("qty"))


def set_quantities(cart: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: cart_id, product_id, new_qty; a null removes the line, others are held to LEAST..MOST."""
    marked = changes.withColumn("changed", F.lit(True))
    both = cart.join(marked, ["cart_id", "product_id"], "full_outer")
    held = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("new_qty")))
    qty = F.when(F.col("changed"), F.when(F.col("new_qty").isNotNull(), held)).otherwise(F.col("qty"))
    return both.select("cart_id", "product_id", qty.alias("qty")).where("qty is not null")


def toggle_favorites(favorites: DataFrame, toggles: DataFrame) -> DataFrame:
    """Favorites after each (user_id, product_id) has been toggled as often as it comes."""
    odd = toggles.groupBy("user_id", "product_id").agg((F.count("*") % 2 == 1).alias("odd")).where("odd")
    both = favorites.withColumn("had", F.lit(True)).join(odd, ["user_id", "product_id"], "full_outer")
    return both.where(F.coalesce("had", F.lit(False)) != F.coalesce("odd", F.lit(False))).select("user_id", "product_id")


def apply_meal_to_cart(meals: DataFrame, cart_id: str = "request_id") -> DataFrame:
    """A meal as a new cart with one of each item."""
    return meals.select(F.col(cart_id).cast("string").alias("cart_id"), F.explode("items").alias("item")).select("cart_id", F.col("item.id").alias("product_id"), F.lit(1.0).alias("qty"))
