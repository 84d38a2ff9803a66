"""Bundles, observation logs, product stores, pages and points of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kondate import dims, schema
from kondate.functions.text import migrate_category
from kondate.operators.cart import prune_orphans
from kondate.operators.quality import MOST_ROWS, InvalidCatalog, cart_is_valid, strict, surely_right, typed_product, typed_variant, validate, violations
from kondate.operators.rank import last_wins
from kondate.sources import log
from kondate.tables import Scratch, deal_rows

MOST_LOG_BYTES, MOST_BUNDLE_BYTES = 100_000_000, 20_000_000
#: Comparisons of favorites and lines with products up to which a bundle's orphans are found in its row.
MOST_LOOKS = 1_000_000


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("v", path, "variant"))


def _well_formed() -> Column:
    """Whether the parts of a bundle (variant v) are a list, a list of texts and an object."""
    fav, cart = _kind("$.favorites"), _kind("$.cart")
    fine = _kind("$.catalog").startswith("ARRAY") & F.coalesce(fav.isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"), F.lit(True)) & F.coalesce(cart.startswith("OBJECT"), F.lit(True))
    return F.coalesce(fine, F.lit(False))


def _as_written(value: Column, typed: Column) -> Column:
    """Whether a line is letter by letter what its typed values are written as: then its types are right, as "3" and 3 differ. Keys that repeat are left to the variant."""
    cart = typed["cart"]
    return F.coalesce((F.to_json(typed, {"ignoreNullFields": "false"}) == value) & typed["favorites"].isNotNull() & (F.size(F.array_distinct(F.map_keys(cart))) == F.size(cart)), F.lit(False))


def _bundle_items(whole: DataFrame, *carried: str) -> DataFrame:
    items = whole.select(*carried, F.posexplode(F.try_variant_get("v", "$.catalog", "array<variant>")).alias("ord", "item"))
    return items.select(*carried, F.col("ord").cast("long").alias("ord"), typed_variant(F.col("item")).alias("x"))


def _bundle_favorites(whole: DataFrame, *carried: str) -> DataFrame:
    return whole.select(*carried, F.explode(F.try_variant_get("v", "$.favorites", "array<string>")).alias("product_id"))


def _bundle_lines(whole: DataFrame, *carried: str) -> DataFrame:
    lines = whole.select(*carried, F.explode(F.try_variant_get("v", "$.cart", "map<string,variant>")).alias("product_id", "q"))
    return lines.select(*carried, "product_id", _quantity(F.col("q")).alias("qty"))


def _quantity(q: Column) -> Column:
    number = F.schema_of_variant(q).isin("BIGINT", "DOUBLE") | F.schema_of_variant(q).startswith("DECIMAL")
    return F.when(number, F.try_variant_get(q, "$", "double"))


def read_catalog_bundle(spark: SparkSession, path: str, stores: list[str] = dims.STORES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """catalog, favorites (product_id), cart (product_id, qty) of one JSON document, or InvalidCatalog.

    A bundle is one person's file and is read by one task; its size and rows are bounded. Many of them are read by
    ``read_catalog_bundles``. Rows of unknown chains go before the check; favorites and cart lines whose product isn't
    there, after.
    """
    text = spark.read.text(path, wholetext=True).select("value")
    if (size := text.agg(F.max(F.octet_length("value"))).first()[0] or 0) > MOST_BUNDLE_BYTES:
        raise InvalidCatalog(f"{size} bytes")
    whole = text.select(F.try_parse_json("value").alias("v"))
    if not whole.agg(F.coalesce(F.min(_well_formed()), F.lit(False))).first()[0]:
        raise InvalidCatalog("the bundle's parts are of the wrong form")
    known = _bundle_items(whole).where(F.col("x.product.store").isin(stores))
    if known.where(F.size("x.wrong") > 0).limit(1).count():
        raise InvalidCatalog("a field has the wrong type")
    catalog = strict(known.select("x.product.*", "ord"))
    lines = _bundle_lines(whole)
    if lines.where(~cart_is_valid(F.col("qty"))).limit(1).count():
        raise InvalidCatalog("a quantity is out of range")
    return catalog, prune_orphans(_bundle_favorites(whole), catalog), prune_orphans(lines, catalog)


def _judged(x: Column, stores: list[str]) -> Column:
    """A bundle's rows of known chains (catalog), as they are kept, and the reason against them (null, if there is none)."""
    product = lambda i: i["product"]
    moved = lambda i: migrate_category(product(i)["name"], product(i)["category"])
    ids = F.filter(F.transform(x, lambda i: product(i)["id"]), lambda i: i.isNotNull())
    broken = F.exists(x, lambda i: F.size(violations(stores, get=lambda k: product(i)[k], category=moved(i))) > 0) | (F.size(F.array_distinct(ids)) < F.size(ids))
    reason = F.when(F.exists(x, lambda i: F.size(i["wrong"]) > 0), "type").when(broken, "rule").when(F.size(x) > MOST_ROWS, "rows")
    return F.struct(reason.alias("reason"), F.transform(x, lambda i: product(i).withField("category", moved(i))).alias("catalog"))


def read_catalog_bundles(spark: SparkSession, path: str, stores: list[str] = dims.STORES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """catalog, favorites, cart, each with owner, and rejected (owner, reason), of bundles with an owner, one on a line.

    A bundle passes or fails as a whole, by the rules of ``read_catalog_bundle``; bundles are checked side by side.
    A line is judged, and its orphans dropped, where it is read: nothing but owners is shuffled. What lines of one owner
    say is put together before it is judged, and large bundles find their orphans by joins. Lines as the writer writes them
    that surely break no rule are read by a schema; the others are read as variants, which keep types apart, and judged by each rule.
    """
    scratch = Scratch(spark, "bundles")
    whole = spark.read.text(path).select("value", F.octet_length("value").alias("bytes"))
    typed = whole.select("value", "bytes", F.when(F.col("bytes") <= MOST_BUNDLE_BYTES, F.from_json("value", schema.BUNDLE)).alias("typed"))
    plain = typed.select("value", "bytes", F.when(_as_written(F.col("value"), F.col("typed")) & surely_right(F.col("typed.catalog"), stores), F.col("typed")).alias("plain"))
    other = plain.select("bytes", "plain", F.when(F.col("plain").isNull(), F.try_parse_json("value")).alias("v"))
    form = F.when(F.col("plain").isNull(), F.when(F.col("bytes") > MOST_BUNDLE_BYTES, "size").when(~_well_formed(), "form"))
    get = lambda at, kind: F.when(form.isNull(), F.try_variant_get("v", at, kind))
    known = F.filter(F.transform(get("$.catalog", "array<variant>"), typed_variant), lambda x: x["product"]["store"].isin(stores))
    owner = F.when(F.col("plain").isNull(), F.try_variant_get("v", "$.owner", "string")).otherwise(F.col("plain.owner"))
    read = other.select("plain", owner.alias("owner"), form.alias("form"), known.alias("known"), F.coalesce("plain.favorites", get("$.favorites", "array<string>")).alias("favorites"), get("$.cart", "map<string,variant>").alias("cart"))
    line = lambda quantity: lambda e: F.struct(e["key"].alias("product_id"), quantity(e["value"]).alias("qty"))
    lines = F.coalesce(F.transform(F.map_entries("plain.cart"), line(lambda q: q)), F.transform(F.map_entries("cart"), line(_quantity)))
    judged = read.select("owner", "form", "favorites", lines.alias("lines"), F.transform(F.array("known"), lambda x: _judged(x, stores))[0].alias("x"), F.col("plain.catalog").alias("catalog"))
    judged = judged.select("owner", "form", "favorites", "lines", "x.reason", F.coalesce("catalog", "x.catalog").alias("catalog"))
    quantity = F.when(F.exists("lines", lambda e: ~F.coalesce(cart_is_valid(e["qty"]), F.lit(True))), "quantity")
    reason = F.array_min(F.array_compact(F.array("form", quantity, "reason")))
    there = F.array_except("catalog.id", F.array(F.lit(None).cast("string")))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    large = (count("favorites") + count("lines")) * count("catalog") > MOST_LOOKS
    judged = judged.select("owner", "favorites", "lines", "catalog", reason.alias("reason"), large.alias("large"), F.when(reason.isNull() & ~large, there).alias("there"))
    kept = lambda rows, key: F.when(F.col("there").isNotNull(), F.filter(rows, lambda r: F.array_contains("there", key(r))))
    favorites, cart = kept("favorites", lambda r: r), kept("lines", lambda r: r["product_id"])
    bundles = scratch.table(judged.select("owner", "reason", "large", F.when(F.col("reason").isNull(), F.col("catalog")).alias("catalog"), favorites.alias("favorites"), cart.alias("cart")), "judged")
    several = scratch.table(bundles.groupBy("owner").agg(F.count("*").alias("n"), F.max("large").alias("large")).where("n > 1 or large or owner is null").select("owner"), "several")
    rows = bundles.select("owner", F.posexplode("catalog").alias("ord", "x")).select("owner", "x.*", F.col("ord").cast("long").alias("ord"))
    parts = [rows, bundles.select("owner", F.explode("favorites").alias("product_id")), bundles.select("owner", F.explode("cart").alias("x")).select("owner", "x.*"), bundles.where("reason is not null").select("owner", "reason")]
    if not several.limit(1).count():
        return parts[0], parts[1], parts[2], parts[3]
    same = F.col("owner").eqNullSafe(F.col("_owner"))
    named = several.withColumnRenamed("owner", "_owner")
    whole = whole.select("bytes", F.try_parse_json("value").alias("v")).withColumn("owner", F.try_variant_get("v", "$.owner", "string"))
    together = _read_together(whole.join(named, same, "left_semi"), scratch, stores)
    both = [part.join(named, same, "left_anti").unionByName(more.select(part.columns)) for part, more in zip(parts, together, strict=True)]
    return both[0], both[1], both[2], both[3]


def _read_together(whole: DataFrame, scratch: Scratch, stores: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same of owners with several lines or large ones, by joins."""
    form = F.when(F.col("bytes") > MOST_BUNDLE_BYTES, "size").when(~_well_formed(), "form")
    items = scratch.table(_bundle_items(whole.where(form.isNull()), "owner").where(F.col("x.product.store").isin(stores)), "items")
    checked = scratch.table(validate(items.select("owner", "x.product.*", "ord", F.size("x.wrong").alias("wrong")), ("owner", "id")), "checked")
    lines = scratch.table(_bundle_lines(whole.where(form.isNull()), "owner"), "lines")
    sums = checked.groupBy("owner").agg(F.count("*").alias("n"), F.max(F.col("wrong") > 0).alias("wrong"), F.max(F.size("broken") > 0).alias("broken"))
    faults = [
        whole.select("owner", form.alias("reason")),
        sums.select("owner", F.when(F.col("wrong"), "type").when(F.col("broken"), "rule").when(F.col("n") > MOST_ROWS, "rows").alias("reason")),
        lines.where(~cart_is_valid(F.col("qty"))).select("owner", F.lit("quantity").alias("reason")),
    ]
    rejected = scratch.table(faults[0].unionByName(faults[1]).unionByName(faults[2]).where("reason is not null").groupBy("owner").agg(F.min("reason").alias("reason")), "rejected")
    catalog = checked.drop("wrong", "broken").join(rejected, "owner", "left_anti")
    there = catalog.select("owner", F.col("id").alias("product_id"))
    favorites = _bundle_favorites(whole.where(form.isNull()), "owner").join(there, ["owner", "product_id"], "left_semi")
    return catalog, favorites, lines.join(there, ["owner", "product_id"], "left_semi"), rejected


def write_catalog_bundle(catalog: DataFrame, favorites: DataFrame, cart: DataFrame, path: str) -> None:
    """One JSON document with explicit nulls. For a person's bundle, of as many rows as it may hold; a catalog of any size goes to ``write_catalog``."""
    for part in (catalog, favorites, cart):
        if part.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            raise InvalidCatalog(f"more than {MOST_ROWS} rows")
    order = "ord" if "ord" in catalog.columns else "id"
    products = catalog.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*schema.TEXTS, *schema.NUMBERS, "auto").alias("r")))), lambda x: x["r"]).alias("catalog"))
    ids = favorites.agg(F.sort_array(F.collect_list("product_id")).alias("favorites"))
    lines = cart.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("product_id", "qty")))).alias("cart"))
    whole = products.crossJoin(ids).crossJoin(lines)  # one row each
    whole.select(F.to_json(F.struct("catalog", "favorites", "cart"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_catalog_bundles(catalog: DataFrame, favorites: DataFrame, cart: DataFrame, path: str, person: str = "owner") -> None:
    """One line of JSON per owner, explicit nulls included, in gzipped files. catalog and cart have a column owner.

    favorites are an owner's, or those of a `person` with several bundles: then catalog and cart have that column too, and
    each bundle of a person gets all of their favorites where it is written. Rows are shuffled once, by person.
    What goes into one value is checked before: no owner may have more rows of a kind than a bundle may hold.
    """
    keys, counted = list(dict.fromkeys((person, "owner"))), 0
    for part, key in ((catalog, "owner"), (favorites, person), (cart, "owner")):
        n, most = part.groupBy(key).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if most > MOST_ROWS:
            raise InvalidCatalog(f"an owner has more than {MOST_ROWS} rows")
        counted += n
    order = "ord" if "ord" in catalog.columns else "id"
    row = F.struct(F.col(order).alias("_o"), F.struct(*schema.TEXTS, *schema.NUMBERS, "auto").alias("r")).alias("row")
    rows = catalog.select(*keys, row).unionByName(cart.select(*keys, F.struct("product_id", "qty").alias("line")), allowMissingColumns=True)
    liked = favorites.select(person, F.col("product_id").alias("liked"))
    rows = rows.unionByName(liked, allowMissingColumns=True) if person == "owner" else rows.withColumn("liked", F.lit(None).cast("string"))
    gathered = deal_rows(rows, counted, person).groupBy(*keys).agg(F.collect_list("row").alias("rows"), F.collect_list("line").alias("lines"), F.sort_array(F.collect_list("liked")).alias("favorites"))
    if person != "owner":
        theirs = deal_rows(liked, counted, person).groupBy(person).agg(F.sort_array(F.collect_list("liked")).alias("favorites"))
        # hashed, as the bundles, which are wide, would be sorted to be merged
        gathered = gathered.drop("favorites").join(theirs.hint("shuffle_hash"), person, "left").withColumn("favorites", F.coalesce("favorites", F.array().cast("array<string>")))
    whole = gathered.select("owner", F.sort_array("rows")["r"].alias("catalog"), "favorites", F.map_from_entries(F.sort_array("lines")).alias("cart"))
    whole.select(F.to_json(F.struct("owner", "catalog", "favorites", "cart"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path, compression="gzip")


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").partitionBy("store").parquet(path)


def append_observations(rows: DataFrame, path: str) -> None:
    """One compact JSON line per row, nulls included."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def replay_observations(spark: SparkSession, path: str, stores: list[str] = dims.STORES, newest_only: bool = False) -> DataFrame:
    """The last row of each chain and address in a log; lines that are no JSON or lack store, url or name are skipped.

    All files of a log count, whatever their size. newest_only: of several whole backups only the newest file within
    the size limit counts. Rows with a seq go by it; without, later files and later lines of a file win: a piece of a
    file is read by one task, so its first byte and then the order in the task are the order of the file's lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    if newest_only:
        newest = lines.where(F.col("_size") <= MOST_LOG_BYTES).agg(F.max(F.struct("_time", "_file")).alias("x")).select("x._file")
        lines = lines.join(F.broadcast(newest), "_file", "left_semi")
    rows = typed_lines(lines.drop("_size"), stores)
    order = ["_time", "_file", "_block", "_line"]
    return last_wins(rows.select(*schema.PRODUCT.names, "seq", *order), ["store", "url"], ["seq", *order]).drop(*order)


def typed_lines(lines: DataFrame, stores: list[str] = dims.STORES) -> DataFrame:
    """The product, seq and other columns of lines (value); those that can't be used are left out."""
    typed = lines.withColumn("x", typed_product(F.col("value"))).withColumn("seq", F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.seq", "long"), F.lit(0).cast("long")))
    rows = typed.where(F.col("x.product.store").isin(stores) & F.col("x.product.url").isNotNull() & F.col("x.product.name").isNotNull())
    return rows.select("x.product.*", "seq", *[c for c in lines.columns if c != "value"])


def replay_log(spark: SparkSession, path: str, stores: list[str] = dims.STORES) -> DataFrame:
    """As ``replay_observations``, read by the source of ``sources.log``: rows go by seq, then by file and place in it."""
    log.register(spark)
    rows = typed_lines(spark.read.format(log.NAME).load(path), stores)
    return last_wins(rows, ["store", "url"], ["seq", "file", "at"]).drop("file", "at")


def read_product_store(rows: DataFrame) -> DataFrame:
    """(url, data) rows as typed products."""
    return rows.select(F.from_json("data", schema.PRODUCT).alias("d")).select("d.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("url", "html")


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    """The elements of an answer, or of many in a folder: file, seq (the order in it) and fields; ValueError if one has no elements.

    ids may be numbers or text. An answer is a file of its own, so many are read side by side.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    if whole.where(~F.coalesce(_kind("$.elements").startswith("ARRAY"), F.lit(False))).limit(1).count():
        raise ValueError("elements is no array")
    items = whole.select("file", F.posexplode(F.try_variant_get("v", "$.elements", "array<variant>")).alias("seq", "e"))
    get = lambda p, t: F.try_variant_get("e", p, t)
    center = F.struct(get("$.center.lat", "double").alias("lat"), get("$.center.lon", "double").alias("lon"))
    return items.select("file", F.col("seq").cast("long").alias("seq"), get("$.type", "string").alias("type"), get("$.id", "string").alias("id"), get("$.lat", "double").alias("lat"), get("$.lon", "double").alias("lon"), center.alias("center"), get("$.tags", "map<string,string>").alias("tags"))


def log_if_missing(products: DataFrame, path: str, exists: bool) -> DataFrame:
    """An empty store is filled from its log; a store without a log is written to one."""
    spark = products.sparkSession
    if not products.limit(1).count():
        return replay_observations(spark, path) if exists else products
    if not exists:
        append_observations(products, path)
    return products
