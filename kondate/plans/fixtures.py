"""Views of the given tables in the shape of the catalog: each once in Spark and once in SQL, in the same arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kondate import dims
from kondate.functions.html import spread
from kondate.functions.urls import host
from kondate.tables import deal_rows

RUN_DATE = "2024-01-31"
URLS = "https://www.daily-yamazaki.jp/goods/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(k: Column, factor: int, mod: int, scale: float, without: int, plus: float = 0.0) -> Column:
    return F.when(k % without != 0, ((k * factor) % mod) / F.lit(scale) + plus)


def chain(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, dims.STORES)), (k % 10 + 1).cast("int"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products from part."""
    part = table(spark, sf_dir, "part")
    k, kind = F.col("p_partkey"), F.col("p_type")
    category = F.when(kind.rlike("ECONOMY|LARGE"), "主食").when(kind.rlike("STANDARD|MEDIUM"), "副菜").when(kind.rlike("SMALL"), "おやつ").when(kind.rlike("PROMO"), "飲み物").otherwise("その他")
    unit = F.when(k % 7 < 5, "1包装").when(k % 7 == 5, "100g").otherwise("公式掲載単位（要確認）")
    return part.select(
        F.concat(F.lit("p"), k).alias("id"), chain(k).alias("store"), F.col("p_name").alias("name"), category.alias("category"), unit.alias("unit"), F.concat(F.lit(URLS), k, F.lit("/")).alias("url"),
        F.when(k % 5 == 0, RUN_DATE).otherwise("2024-01-01").alias("checked"), F.col("p_brand").alias("note"),
        _every(k, 7, 400, 10.0, 11).alias("p"), _every(k, 13, 250, 10.0, 13).alias("f"), _every(k, 17, 700, 10.0, 17).alias("c"), _every(k, 19, 800, 1.0, 19, 50.0).alias("kcal"), _every(k, 23, 420, 1.0, 23, 80.0).alias("price"),
        (k % 3 != 0).alias("auto"), k.alias("ord"),
    )


_LIST = "[" + ", ".join(f"'{s}'" for s in dims.STORES) + "]"
CATALOG = f"""catalog AS (
  SELECT 'p' || p_partkey AS id, {_LIST}[p_partkey % 10 + 1] AS store, p_name AS name,
    CASE WHEN regexp_matches(p_type, 'ECONOMY|LARGE') THEN '主食' WHEN regexp_matches(p_type, 'STANDARD|MEDIUM') THEN '副菜'
         WHEN regexp_matches(p_type, 'SMALL') THEN 'おやつ' WHEN regexp_matches(p_type, 'PROMO') THEN '飲み物' ELSE 'その他' END AS category,
    CASE WHEN p_partkey % 7 < 5 THEN '1包装' WHEN p_partkey % 7 = 5 THEN '100g' ELSE '公式掲載単位（要確認）' END AS unit,
    '{URLS}' || p_partkey || '/' AS url, CASE WHEN p_partkey % 5 = 0 THEN '{RUN_DATE}' ELSE '2024-01-01' END AS checked, p_brand AS note,
    CASE WHEN p_partkey % 11 <> 0 THEN ((p_partkey * 7) % 400) / 10.0::DOUBLE + 0.0::DOUBLE END AS p,
    CASE WHEN p_partkey % 13 <> 0 THEN ((p_partkey * 13) % 250) / 10.0::DOUBLE + 0.0::DOUBLE END AS f,
    CASE WHEN p_partkey % 17 <> 0 THEN ((p_partkey * 17) % 700) / 10.0::DOUBLE + 0.0::DOUBLE END AS c,
    CASE WHEN p_partkey % 19 <> 0 THEN ((p_partkey * 19) % 800) / 1.0::DOUBLE + 50.0::DOUBLE END AS kcal,
    CASE WHEN p_partkey % 23 <> 0 THEN ((p_partkey * 23) % 420) / 1.0::DOUBLE + 80.0::DOUBLE END AS price,
    p_partkey % 3 <> 0 AS auto, p_partkey AS ord
  FROM part)"""
#: Ratios, distance and value of catalog rows, for targets 20, 25, 55.
METRICS = """ratios AS (
  SELECT *, CASE WHEN t <> 0 THEN 4 * p / t * 100 END AS p_pct, CASE WHEN t <> 0 THEN 9 * f / t * 100 END AS f_pct, CASE WHEN t <> 0 THEN 4 * c / t * 100 END AS c_pct
  FROM (SELECT *, 4 * p + 9 * f + 4 * c AS t FROM catalog)),
metrics AS (
  SELECT *, abs(p_pct - 20) + abs(f_pct - 25) + abs(c_pct - 55) AS distance,
    CASE WHEN p_pct IS NOT NULL THEN greatest(abs(p_pct - 20), abs(f_pct - 25), abs(c_pct - 55)) END AS deviation,
    CASE WHEN p > 0 AND price > 0 AND NOT contains(unit, '要確認') THEN 100 * p / price END AS value,
    coalesce(p_pct IS NOT NULL AND p >= 0 AND f >= 0 AND c >= 0 AND kcal > 0 AND price > 0 AND NOT contains(unit, '要確認') AND regexp_matches(unit, '1(包装|食|個|本|袋|商品|パック)'), false) AS eligible
  FROM ratios)"""


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    # dealt first, as nearly all pairs differ and sums before the shuffle would hold each row of a file's part
    lines = deal_rows(rows.select("l_orderkey", "l_partkey", "l_quantity"), rows.count(), "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return lines.select(F.col("l_orderkey").cast("string").alias("cart_id"), F.concat(F.lit("p"), "l_partkey").alias("product_id"), F.least(F.col("q"), F.lit(100.0)).alias("qty"))


CARTS = "carts AS (SELECT l_orderkey::VARCHAR AS cart_id, 'p' || l_partkey AS product_id, least(sum(l_quantity), 100.0::DOUBLE) AS qty FROM lineitem GROUP BY l_orderkey, l_partkey)"


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").cast("string").alias("user_id"), F.concat(F.lit("p"), "l_partkey").alias("product_id")).distinct()


FAVORITES = "favorites AS (SELECT DISTINCT o_custkey::VARCHAR AS user_id, 'p' || l_partkey AS product_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def requests(spark: SparkSession) -> DataFrame:
    rows = [(f"{i}-{b}-{k}", s, float(b), float(k), 20.0, 25.0, 55.0, 10.0) for i, s in enumerate(dims.STORES) for b in (500, 750, 1000) for k in (400, 600, 800)]
    return spark.createDataFrame(rows, "request_id string, store string, budget double, calories double, tp double, tf double, tc double, tolerance double")


REQUESTS = f"""requests AS (
  SELECT i || '-' || b || '-' || k AS request_id, {_LIST}[i + 1] AS store, b::DOUBLE AS budget, k::DOUBLE AS calories, 20.0::DOUBLE AS tp, 25.0::DOUBLE AS tf, 55.0::DOUBLE AS tc, 10.0::DOUBLE AS tolerance
  FROM range(10) AS r(i), (VALUES (500), (750), (1000)) AS x(b), (VALUES (400), (600), (800)) AS y(k))"""


def _placed(k: Column) -> tuple[Column, Column]:
    return 35 + ((k * 37) % 1000) / F.lit(5000.0), 139 + ((k * 53) % 1000) / F.lit(5000.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = _placed(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), lat.alias("lat"), lon.alias("lon"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = _placed(F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("poi_id"), chain(F.col("s_suppkey")).alias("store"), F.col("s_name").alias("name"), lat.alias("lat"), lon.alias("lon"))


POINTS = f"""points AS (SELECT c_custkey AS point_id, 35 + ((c_custkey * 37) % 1000) / 5000.0::DOUBLE AS lat, 139 + ((c_custkey * 53) % 1000) / 5000.0::DOUBLE AS lon FROM customer),
pois AS (SELECT s_suppkey AS poi_id, {_LIST}[s_suppkey % 10 + 1] AS store, s_name AS name, 35 + ((s_suppkey * 37) % 1000) / 5000.0::DOUBLE AS lat, 139 + ((s_suppkey * 53) % 1000) / 5000.0::DOUBLE AS lon FROM supplier)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes from events."""
    return to_outcomes(table(spark, sf_dir, "events"))


def to_outcomes(events: DataFrame) -> DataFrame:
    event = F.col("event_type")
    outcome = F.when(event == "error", "error").when(event == "purchase", "added").when(event == "view", "list").otherwise("skipped")
    kind = F.when(event == "view", "list").when(event == "click", "generic").otherwise("detail")
    reason = F.when(event.isin("error", "click", "signup"), F.concat(F.lit("reason "), F.col("event_id") % 4)).otherwise("")
    return events.select(chain(F.col("user_id")).alias("store"), F.concat(F.lit("u"), "event_id").alias("url"), kind.alias("kind"), outcome.alias("outcome"), reason.alias("reason"), F.col("event_id").alias("seq"))


OUTCOMES = f"""outcomes AS (
  SELECT {_LIST}[user_id % 10 + 1] AS store, 'u' || event_id AS url,
    CASE event_type WHEN 'view' THEN 'list' WHEN 'click' THEN 'generic' ELSE 'detail' END AS kind,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'added' WHEN 'view' THEN 'list' ELSE 'skipped' END AS outcome,
    CASE WHEN event_type IN ('error', 'click', 'signup') THEN 'reason ' || (event_id % 4) ELSE '' END AS reason, event_id AS seq
  FROM events)"""


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTML page of each product, with the numbers that are known."""
    return catalog(spark, sf_dir).select("url", "store", page_of_product().alias("html"))


def page_of_product(head: Column | None = None, more: Column | None = None, protein_scale: float | Column = 1.0) -> Column:
    """The page of a catalog row. head: the text of the heading, if not the name; more: HTML behind the table of nutrients."""
    number = lambda label, c, unit: F.when(c.isNotNull(), F.concat(F.lit(f"<li>{label}："), F.format_string("%.1f", c), F.lit(f"{unit}</li>"))).otherwise("")
    price = F.when(F.col("price").isNotNull(), F.concat(F.lit("<p>税込 "), F.format_string("%.0f", F.col("price")), F.lit("円</p>"))).otherwise("")
    table_ = F.concat(number("たんぱく質", F.col("p") * protein_scale, "g"), number("脂質", F.col("f"), "g"), number("炭水化物", F.col("c"), "g"), number("熱量", F.col("kcal"), "kcal"))
    unit = F.when(F.col("unit") == "1包装", "1包装当たり").when(F.col("unit") == "100g", "100g当たり").otherwise("")
    more = F.lit("") if more is None else more
    return F.concat(F.lit("<html><head><title>"), F.col("name"), F.lit("｜x</title><script>var a='<b>';</script></head><body><h1>"), F.col("name") if head is None else head, F.lit("</h1>"), price, F.lit("<h3>栄養成分</h3><p>"), unit, F.lit("</p><ul>"), table_, F.lit("</ul>"), more, F.lit("<p>保存方法</p></body></html>"))


def named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages of which every fourth names its chain."""
    more = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("<p>"), F.col("store"), F.lit("</p>"))).otherwise("")
    return catalog(spark, sf_dir).select("url", "store", page_of_product(more=more).alias("html"))


def faulty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages of which some lack a name, repeat the table, hold too much protein or have too long a name."""
    k = F.col("ord") % 6
    head = F.when(k == 1, "商品一覧").when(k == 2, F.concat("name", F.repeat(F.lit("x"), 200))).otherwise(F.col("name"))
    titled = F.when(k.isin(1, 2), head).otherwise(F.col("name"))
    more = F.when(k == 3, "<p>たんぱく質 1.0g</p>").otherwise("")
    rows = catalog(spark, sf_dir).withColumn("name", titled)
    return rows.select("url", "store", page_of_product(more=more, protein_scale=F.when(k == 4, 1e6).otherwise(1.0)).alias("html"))


#: A declaration that no parser reads, and what it says of it.
BROKEN, FAULT = "<![foo[x]]>", "unknown status keyword 'foo' in marked section"


def broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages of which every third is broken before or behind its table of nutrients, and every fourth has a sound section of data."""
    k = F.col("ord")
    more = F.when(k % 6 == 4, F.lit(BROKEN)).when(k % 4 == 0, "<![CDATA[x]]>").otherwise("")
    page = page_of_product(more=more)
    return catalog(spark, sf_dir).select("url", "store", F.when(k % 6 == 1, F.concat(F.lit(BROKEN), page)).otherwise(page).alias("html"))


def linked_pages(spark: SparkSession, sf_dir: str, broken: Column | None = None) -> DataFrame:
    """Product pages of one chain that link to the pages of twice their number and the next; some broken in between."""
    link = lambda n: F.concat(F.lit('<a href="/goods/'), n, F.lit('/">チキン</a>'))
    more = F.concat(F.lit("<p>デイリーヤマザキ</p>"), link(2 * F.col("ord")), link(2 * F.col("ord") + 1), F.lit('<a href="/news/1/">x</a><a href="/goods/9/">ビール</a>'))
    if broken is not None:
        more = F.when(broken, F.concat(more, F.lit(BROKEN))).otherwise(more)
    return spread(catalog(spark, sf_dir).where("ord > 0")).select("url", page_of_product(more=more).alias("html"))


def link_offers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A level of waiting pages (orders, most of them of one chain), their links (parts ordered) and what was seen (every fifth part)."""
    store = F.element_at(F.array(*map(F.lit, dims.STORES)), (F.least(F.lit(9), F.col("o_custkey") % 40) + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select(store.alias("store"), F.concat(F.lit("o"), "o_orderkey").alias("url"), F.col("o_orderkey").alias("seq"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("parent"), F.concat(F.lit("p"), "l_partkey").alias("url"), F.lit("generic").alias("kind"), (F.col("l_linenumber") % 2).alias("priority"), F.lit(1).alias("depth"))
    links = lines.join(orders.select("store", F.col("url").alias("parent")), "parent")
    parts = table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("url"))
    return orders, links, parts.crossJoin(dims.stores(spark).select("store"))


def example_host(url_host: Column) -> Column:
    return url_host.rlike(r"\.example\.(com|net|org)$")


def never(url_host: Column) -> Column:
    return F.lit(False) & url_host.isNotNull()


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each host of pages."""
    hosts = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("host")).distinct()
    return hosts.select(chain(F.length("host")).alias("store"), "host")
