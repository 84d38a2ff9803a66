"""Checks of catalog rows, carts, favorites and edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kondate import dims, schema
from kondate.functions.text import migrate_category
from kondate.functions.urls import safe_link
from kondate.operators.metrics import finite

MOST_TEXT, MOST_NUMBER, MOST_ROWS = 2000, 100_000, 40_000
#: Addresses that are safe links, or none, at a glance; others may be, too.
_PLAIN_LINK = r"^(https://[A-Za-z0-9.-]+(/[A-Za-z0-9/._~%-]*)?)?\z"


class InvalidCatalog(ValueError):
    """A strict check failed."""


def with_migrated_category(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("category", migrate_category(F.col("name"), F.col("category")))


def violations(stores: list[str] = dims.STORES, names: list[str] = dims.CATEGORIES, get: Callable[[str], Column] = F.col, category: Column | None = None) -> Column:
    """The rules that a row breaks, apart from the one that looks at other rows. get: its fields, if they are no columns; category: its category, if not its field."""
    broken = [F.when(get(k).isNull() | (F.length(get(k)) > MOST_TEXT), f"text:{k}") for k in schema.TEXTS if k != "category" or category is None]
    category = get("category") if category is None else category
    broken += [F.when(~F.coalesce(get("store").isin(stores), F.lit(False)), "store"), F.when(~F.coalesce(category.isin(names), F.lit(False)), "category")]
    broken.append(F.when((F.coalesce(get("url"), F.lit("")) != "") & ~safe_link(get("url")), "url"))
    broken += [F.when(get(k).isNotNull() & ~(finite(get(k)) & get(k).between(0, MOST_NUMBER)), f"number:{k}") for k in schema.NUMBERS]
    return F.array_compact(F.array(*broken))


def surely_right(rows: Column, stores: list[str] = dims.STORES, names: list[str] = dims.CATEGORIES) -> Column:
    """Whether an array of products breaks none of the ``violations``, repeats no id, lacks no field but numbers and needs no other category.

    False only says that the rules themselves have to tell. It looks at the arrays of the fields by functions that Spark compiles;
    what stands in a lambda is interpreted for each row, which takes many times as long for all the rules.
    """
    texts = F.flatten(F.array(*[rows[k] for k in schema.TEXTS]))
    numbers = F.flatten(F.array(*[rows[k] for k in schema.NUMBERS]))
    listed = lambda k, known: F.size(F.array_except(rows[k], F.array(*map(F.lit, known)))) == 0
    # null, and so not right, where any text is null
    there = ~F.array_contains(texts, F.lit("\0"))
    short = (F.length(F.array_join(texts, "")) <= MOST_TEXT) | F.forall(texts, lambda t: F.length(t) <= MOST_TEXT)
    in_range = F.coalesce((F.array_min(numbers) >= 0) & (F.array_max(numbers) <= MOST_NUMBER), F.lit(True))
    unlike = (F.size(rows) <= MOST_ROWS) & (F.size(F.array_distinct(rows["id"])) == F.size(rows))
    right = listed("store", stores) & listed("category", names) & listed("auto", (True, False)) & there & short & in_range & unlike & F.forall(rows["url"], lambda u: u.rlike(_PLAIN_LINK))
    return F.coalesce(right, F.lit(False))


def validate(catalog: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """The rows, categories migrated, with the names of the rules they break; every row of an id that repeats breaks one.

    key: what is to be unique, such as owner and id where rows of many catalogs come together. Identifiers are counted by a grouped sum that combines before its shuffle, and only those that repeat are joined.
    """
    rows = with_migrated_category(catalog).withColumn("broken", violations())
    twice = rows.groupBy(*key).count().where("count > 1 and id is not null").select(*key, F.lit(True).alias("_twice"))
    joined = rows.join(twice, [*key], "left")
    return joined.withColumn("broken", F.when(F.col("_twice"), F.concat("broken", F.array(F.lit("duplicate id")))).otherwise(F.col("broken"))).drop("_twice")


def quarantine(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with what they break."""
    checked = validate(catalog)
    return checked.where(F.size("broken") == 0).drop("broken"), checked.where(F.size("broken") > 0)


def strict(catalog: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """All rows, or InvalidCatalog."""
    checked = validate(catalog)
    sums = checked.agg(F.count("*").alias("n"), F.count_if(F.size("broken") > 0).alias("bad")).first()
    if sums["n"] > most_rows or sums["bad"]:
        raise InvalidCatalog(f"{sums['n']} rows, {sums['bad']} of them break a rule")
    return checked.drop("broken")


def typed_variant(item: Column) -> Column:
    """A product from a variant with strict types: struct of product and wrong (the fields of another type).

    A variant keeps true, "3" and 3 apart, which a JSON schema does not. It and the types of its fields are bound values,
    so that JSON is parsed once and each type is looked up once.
    """
    names = [*schema.NUMBERS, *schema.TEXTS, "auto"]
    kinds = lambda v: F.struct(v.alias("v"), *[F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")).alias(n) for n in names])

    def build(x: Column) -> Column:
        v = x["v"]
        is_number = lambda n: x[n].isin("BIGINT", "DOUBLE") | x[n].startswith("DECIMAL")
        number = [F.when(is_number(n), F.try_variant_get(v, f"$.{n}", "double")).alias(n) for n in schema.NUMBERS]
        text = [F.when(x[n] == "STRING", F.try_variant_get(v, f"$.{n}", "string")).alias(n) for n in schema.TEXTS]
        auto = F.coalesce(F.when(x["auto"] == "BOOLEAN", F.try_variant_get(v, "$.auto", "boolean")), F.lit(False)).alias("auto")
        wrong = [F.when(x[n].isNotNull() & (x[n] != "VOID") & ~is_number(n), n) for n in schema.NUMBERS]
        wrong += [F.when(x[n].isNotNull() & (x[n] != "STRING"), n) for n in schema.TEXTS]
        return F.when(v.isNotNull(), F.struct(F.struct(*text, *number, auto).alias("product"), F.array_compact(F.array(*wrong)).alias("wrong")))

    return F.element_at(F.transform(F.transform(F.array(item), kinds), build), 1)


def typed_product(line: Column) -> Column:
    """``typed_variant`` of JSON text."""
    return typed_variant(F.try_parse_json(line))


def cart_is_valid(qty: Column) -> Column:
    return F.coalesce(finite(qty) & (qty > 0) & (qty <= 100), F.lit(False))


def edit_row_check(name: Column, unit: Column, confirmed: Column) -> Column:
    return F.coalesce((F.trim(name) != "") & (F.trim(unit) != "") & confirmed, F.lit(False))
