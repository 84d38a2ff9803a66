"""Dimensions: chains, hosts, categories, aliases and seeds. All functions take them as parameters with these defaults."""

from __future__ import annotations

from urllib.parse import urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession

from kondate import schema

# Names, hosts, addresses and words that results must agree on.
STORES = ["セブンイレブン", "ローソン", "ファミリーマート", "ナチュラルローソン", "ローソンストア100", "ミニストップ", "デイリーヤマザキ", "NewDays", "セイコーマート", "ポプラ"]
CATEGORIES = ["飲み物", "主食", "副菜", "おやつ", "その他"]
OTHER = "その他"
ANY = "すべて"
LEGACY_CATEGORIES = {
    "肉・サラダチキン": "副菜",
    "魚・魚介": "副菜",
    "卵・大豆": "副菜",
    "サラダ": "副菜",
    "ご飯・麺・パン": "主食",
    "ヨーグルト・乳製品": "おやつ",
    "飲料": "飲み物",
    "お菓子・バー": "おやつ",
    "その他": "その他",
}
ORIGINAL_HOSTS = {"www.sej.co.jp": "セブンイレブン", "www.lawson.co.jp": "ローソン", "mldata.lawson.co.jp": "ローソン", "www.family.co.jp": "ファミリーマート"}
SEED_KEYWORDS = ["たんぱく質", "チキン", "サラダ", "おにぎり", "魚", "豆腐", "ヨーグルト"]
SEED_URLS = {
    "ローソン": ["https://www.lawson.co.jp/recommend/original/select/salad/index.html", "https://www.lawson.co.jp/recommend/original/rice/"],
    "ファミリーマート": ["https://www.family.co.jp/goods/sidedishes.html", "https://www.family.co.jp/goods.html"],
    "ナチュラルローソン": ["https://natural.lawson.co.jp/"],
    "ローソンストア100": ["https://store100.lawson.co.jp/"],
    "ミニストップ": ["https://www.ministop.co.jp/"],
    "デイリーヤマザキ": ["https://www.daily-yamazaki.jp/"],
    "NewDays": ["https://retail.jr-cross.co.jp/newdays/"],
    "セイコーマート": ["https://www.seicomart.co.jp/"],
    "ポプラ": ["https://www.poplar-cvs.co.jp/"],
}
CHAIN_ALIASES = [
    ("ナチュラルローソン", ["ナチュラルローソン", "natural lawson"]),
    ("ローソンストア100", ["ローソンストア100", "lawson store 100", "lawson 100"]),
    ("セブンイレブン", ["セブンイレブン", "7-eleven", "7‐eleven", "seven eleven"]),
    ("ファミリーマート", ["ファミリーマート", "familymart", "family mart"]),
    ("デイリーヤマザキ", ["デイリーヤマザキ", "daily yamazaki"]),
    ("ミニストップ", ["ミニストップ", "ministop", "mini stop"]),
    ("セイコーマート", ["セイコーマート", "seicomart", "seico mart"]),
    ("NewDays", ["newdays", "new days"]),
    ("ポプラ", ["ポプラ", "poplar"]),
    ("ローソン", ["ローソン", "lawson"]),
]
SEED_PRODUCTS = [
    ("s1", "セブンイレブン", "７プレミアム サラダチキン プレーン", "副菜", 24.1, None, 0.0, 114.0, 278.64, "公式掲載単位（店頭表示で要確認）", "https://www.sej.co.jp/products/a/item/250701/", "脂質・栄養表示の単位は未確認。公式ページに情報表示不可の文言もあるため取扱いを要確認。"),
    ("s2", "セブンイレブン", "たんぱく質が摂れる鶏むね肉サラダ", "副菜", 21.8, 10.9, 4.4, 199.0, 483.84, "1食", "https://www.sej.co.jp/products/a/item/104758", "地域限定。公式ページに情報表示不可の文言もあるため取扱いを要確認。"),
    ("l1", "ローソン", "たんぱく質30.3g サラダチキン プレーン", "副菜", 30.3, 2.1, 0.2, 141.0, 279.0, "1包装（110g）", "https://mldata.lawson.co.jp/recommend/original/detail/1507463_1996.html", ""),
    ("f1", "ファミリーマート", "たんぱく質22.6g 国産鶏のサラダチキン 3種のハーブ＆スパイス", "副菜", 22.6, None, None, None, 298.0, "1商品（商品名に記載）", "https://www.family.co.jp/goods/sidedishes/2230566.html", "Pは商品名から確認。F・C・カロリーは未確認。"),
    ("f2", "ファミリーマート", "たんぱく質10.6g サラダチキンバー 3種のチーズ", "副菜", 10.6, None, None, None, None, "1商品（商品名に記載）", "https://www.family.co.jp/goods/sidedishes/2230696.html", "Pは商品名から確認。他の栄養値・価格は未確認。"),
]
SEED_DATE = "2026-09-06"
# End of the fixed values.


def seed_urls() -> dict[str, list[str]]:
    first = ["https://www.sej.co.jp/products/a/itemresult/?" + urlencode({"key": k, "limit": 100, "p": 1}) for k in SEED_KEYWORDS]
    return {STORES[0]: first, **SEED_URLS}


def store_hosts() -> dict[str, set[str]]:
    """Hosts of each chain: those of its seeds, and for chains with a root of their own the usual www alias."""
    out = {}
    for store, urls in seed_urls().items():
        hosts = {urlsplit(u).hostname for u in urls}
        if not hosts & ORIGINAL_HOSTS.keys():
            for host in list(hosts):
                if host.startswith("www."):
                    hosts.add(host.removeprefix("www."))
                elif host.count(".") == 1 or host.endswith(".co.jp"):
                    hosts.add(f"www.{host}")
        out[store] = hosts
    return out


def domains() -> dict[str, str]:
    """Host to chain; a host that two chains share belongs to the first."""
    out = dict(ORIGINAL_HOSTS)
    for store, hosts in store_hosts().items():
        for host in sorted(hosts):
            out.setdefault(host, store)
    return out


def stores(spark: SparkSession, names: list[str] = STORES) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(names)], "store string, store_ord int")


def hosts(spark: SparkSession) -> DataFrame:
    """store, host, is_original: every chain's own hosts."""
    return spark.createDataFrame([(s, h, h in ORIGINAL_HOSTS) for s, hs in store_hosts().items() for h in sorted(hs)], "store string, host string, is_original boolean")


def categories(spark: SparkSession, names: list[str] = CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(names)], "category string, cat_ord int")


def seed_products(spark: SparkSession) -> DataFrame:
    rows = [(i, s, n, c, u, url, SEED_DATE, note, p, f, carb, k, price, None) for i, s, n, c, p, f, carb, k, price, u, url, note in SEED_PRODUCTS]
    return spark.createDataFrame(rows, schema.PRODUCT)
