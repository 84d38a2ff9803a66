"""Golden cases of text, addresses and extraction."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kondate import dims
from kondate.functions import extract, html, patterns, text, urls
from kondate.operators import metrics


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def many(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_hosts_have_their_www_alias():
    hosts = dims.store_hosts()
    assert hosts["NewDays"] == {"retail.jr-cross.co.jp", "www.retail.jr-cross.co.jp"}
    assert hosts["ポプラ"] == {"www.poplar-cvs.co.jp", "poplar-cvs.co.jp"}
    assert hosts["ローソン"] == {"www.lawson.co.jp"}


CANONICAL = {
    "https://www.sej.co.jp/products/a/item/104758?x=1": "https://www.sej.co.jp/products/a/item/104758/",
    "https://mldata.lawson.co.jp/sp/recommend/original/detail/1_2.html#a": "https://www.lawson.co.jp/recommend/original/detail/1_2.html",
    "https://www.sej.co.jp/products/a/itemresult?p=2&limit=100&e=&key=%E9%AD%9A": "https://www.sej.co.jp/products/a/itemresult/?key=%E9%AD%9A&limit=100&p=2",
    "HTTPS://WWW.Ministop.co.jp:443": "https://www.ministop.co.jp/",
    "https://ministop.co.jp/a;x=1?utm_source=a&b=~+c*&a=1": "https://ministop.co.jp/a?a=1&b=~+c%2A",
    "https://www.ministop.co.jp:8443/": "",
    "https://www.ministop.co.jp:x/": "",
    "https://user@www.ministop.co.jp/": "",
    "http://www.ministop.co.jp/": "",
    "https://example.com/": "",
}


def test_canonical_url(spark):
    assert many(spark, list(CANONICAL), urls.canonical_url) == list(CANONICAL.values())


KINDS = {
    "https://www.sej.co.jp/products/a/item/12/": "detail",
    "https://www.sej.co.jp/products/a/cat/3/": "list",
    "https://www.sej.co.jp/company/": "",
    "https://www.lawson.co.jp/recommend/original/detail/1_2.html": "detail",
    "https://www.lawson.co.jp/recommend/original/rice/": "list",
    "https://www.family.co.jp/goods/sidedishes/2230566.html": "detail",
    "https://www.family.co.jp/goods/daily.html": "",
    "https://www.family.co.jp/goods.html": "list",
    "https://www.topvalu.net/items/detail/12/": "detail",
    "https://www.topvalu.net/items/": "list",
    "https://www.ministop.co.jp/a.PDF": "",
    "https://www.ministop.co.jp/recruit/": "",
    "https://www.ministop.co.jp/syohin/products/": "generic",
    "https://www.ministop.co.jp/x/": "list",
    "https://example.com/goods/": "",
}


def test_page_kind(spark):
    assert many(spark, list(KINDS), urls.page_kind) == list(KINDS.values())


def test_safe_link(spark):
    links = ["https://a.b/", "HTTPS://a.b", "https://", "https://@a.b/", "https://u@a.b/", "https://:p@a.b/", "http://a.b/", "", None, "https://[a"]
    assert many(spark, links, urls.safe_link) == [True, True, False, True, False, False, False, False, False, False]


def test_general_format(spark):
    values = [24.1, 0.0, 56.25, 100.0, 1234567.0, 0.0001, 0.00001234, 278.64, 999999.5, -2.5, 123456.0]
    assert many(spark, values, text.general_format, "double") == [f"{v:g}" for v in values]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=30, max_size=200))
def test_fixed_is_exact(spark, values):
    values += [0.05, 0.15, 0.25, 2.5, 56.25, 24.15]
    assert many(spark, values, lambda v: text.fixed(v, 1), "double") == [f"{v:.1f}" for v in values]


def test_norm_and_categories(spark):
    assert many(spark, ["ＡＢＣ ｶﾞ", "Straße", None], text.norm_text) == ["abc ガ", "strasse", None]
    assert many(spark, ["サラダチキン", "たまごサンド", "飲むヨーグルト", "チョコバー", "x"], text.guess_category) == ["副菜", "主食", "飲み物", "おやつ", "その他"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.none() | st.floats(0, 500)] * 3), min_size=1, max_size=30))
def test_metrics_against_plain_python(spark, rows):
    def ratios(p, f, c):
        if None in (p, f, c) or not (total := p * 4 + f * 9 + c * 4):
            return None
        return [4 * p / total * 100, 9 * f / total * 100, 4 * c / total * 100]

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p double, f double, c double")
    found = df.select("i", *metrics.pfc_ratios(), metrics.pfc_distance((20, 25, 55)), metrics.is_balanced((20, 25, 55), 10)).orderBy("i").collect()
    for row, values in zip(found, rows, strict=True):
        wanted = ratios(*values)
        assert list(row[1:4]) == (wanted or [None] * 3)
        far = sum(abs(a - b) for a, b in zip(wanted, (20, 25, 55), strict=True)) if wanted else float("inf")
        assert row[4] == pytest.approx(far)
        assert row[5] == bool(wanted and all(abs(a - b) <= 10 + 1e-8 for a, b in zip(wanted, (20, 25, 55), strict=True)))


HEAD = "<title>サラダ｜店</title><h1>サラダ</h1>"
TABLE = "<p>栄養成分 1包装当たり 熱量：100kcal たんぱく質：２０．５g 脂質 3g 炭水化物 5 g</p>"
PAGES = {
    "https://www.ministop.co.jp/goods/1": (HEAD + "<p>税込 1,234円</p>" + TABLE, "", 20.5, 1234.0),
    "https://www.ministop.co.jp/goods/2": (HEAD + TABLE + "<p>税込 300円</p>", "", 20.5, None),
    "https://www.ministop.co.jp/goods/3": (HEAD + TABLE + "たんぱく質 3g", "複数の栄養表示があり単位を特定できません", None, None),
    "https://www.ministop.co.jp/goods/4": (HEAD, "たんぱく質量の公開表示を取得できません", None, None),
    "https://www.ministop.co.jp/goods/5": ("<title>a</title><h1>b</h1><h1>c</h1>", "商品見出しを特定できません", None, None),
    "https://www.ministop.co.jp/goods/6": ("<h1>商品情報</h1>", "商品名を特定できません", None, None),
    "https://www.ministop.co.jp/goods/7": ("<h1>たんぱく質 12.5g バー</h1>", "", 12.5, None),
    "https://www.ministop.co.jp/goods/8": (HEAD + "栄養成分 たんぱく質 200000g", "栄養値が範囲外です", None, None),
    "https://www.ministop.co.jp/goods/9": (HEAD + "栄養成分 100g当たり たんぱく質 2g", "", 2.0, None),
    "https://www.ministop.co.jp/goods/10": (None, "商品見出しを特定できません", None, None),
}


def test_extraction(spark):
    pages = spark.createDataFrame([(u, h) for u, (h, *_) in PAGES.items()], "url string, html string")
    found = {r["url"]: r for r in extract.extract_products(pages, "2024-01-31").collect()}
    for url, (_, reason, protein, price) in PAGES.items():
        row = found[url]
        assert row["reason"] == reason, url
        if not reason:
            assert (row["product"]["p"], row["product"]["price"], row["product"]["store"]) == (protein, price, "ミニストップ"), url
    assert "100g/ml" in found["https://www.ministop.co.jp/goods/9"]["product"]["note"]
    assert found["https://www.ministop.co.jp/goods/7"]["product"]["unit"] == "1商品（商品名に記載）"


BROKEN = ["<![ CDATA[y]]>", "<![FOO[x]]>", "<![<b>", "a <![1]> b", "<![CDATA[x]]>y", "<!", "<!-", "<![", "</", "<a href='", "<!DOCTYPE [", "<?x", "&#x110000;", "&#xD800;", "<p <p>", None, ""]


def test_broken_markup_costs_only_its_page(spark):
    rng = random.Random(1)
    bits = ["<!", "[", "]", "]]>", "CDATA", "if", "--", ">", "<a href=", "<h1>", "</h1>", "&#", ";", "x", "'", '"', "<script>", "<title>", "0", "\x00"]
    pages = BROKEN + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    found = many(spark, [f"<h1>n</h1>{x}" if x is not None else None for x in pages], html.parse_html)
    assert len(found) == len(pages) and all(r["headings"][0]["text"] == "n" for r, x in zip(found, pages, strict=True) if x is not None)
    faults = [r["fault"] for r in found]
    assert faults[1] == "unknown status keyword 'FOO' in marked section" and faults[4] is None and all(faults[i] for i in (0, 2, 3))
    rows = spark.createDataFrame([(f"u{i}", x) for i, x in enumerate(pages)], "url string, html string")
    reasons = {r["url"]: r["reason"] for r in extract.extract_products(rows, "2024-01-31").collect()}
    assert all(reasons[f"u{i}"] == f for i, f in enumerate(faults) if f)


def test_sections_in_linear_time(spark):
    rng = random.Random(2)
    bits = ["栄養成分", "たんぱく質", "たんぱく質 1.5", "保存方法", "x" * 300, "x" * 699, "😀", " "]
    bodies = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(400)]

    def first(body):
        for m in re.finditer(extract.SECTION, body):
            window = re.split(extract.SECTION_END, body[m.end() : m.end() + 700], maxsplit=1)[0]
            if re.search(extract.PROTEIN_NUMBER.removeprefix("(?U)"), window):
                return window
        return ""

    assert many(spark, bodies, extract.nutrition_section) == [first(b) for b in bodies]
    began = time.time()
    assert many(spark, ["栄養成分 " * 40_000 + "たんぱく質 1"], extract.nutrition_section)[0].endswith("1")
    assert time.time() - began < 2


def test_many_words_at_once(spark):
    rng = random.Random(3)
    words = ["", "a", "ab", "b", "ba", "ab", "ñ", "😀x"] + ["".join(rng.choice("ab😀x") for _ in range(4)) for _ in range(50)]
    texts = [None, ""] + ["".join(rng.choice("abñ😀x ") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    assert many(spark, texts, lambda c: patterns.words_in(c, words)) == [None if t is None else [i for i, w in enumerate(words) if w in t] for t in texts]
    aliases = [(f"s{i}", [f"name{i:05d}x", f"other{i}y"]) for i in range(5000)]
    found = many(spark, ["a name00007x name00003x", "other4999y", "nothing", None], lambda c: text.chain_from_text(c, aliases))
    assert found == ["s3", "s4999", None, None]
