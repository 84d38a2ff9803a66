"""Products from parsed pages: heading, nutrition table, unit, price and note, as column expressions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kondate import dims
from kondate.functions.html import page_text, parse_html, spread
from kondate.functions.text import general_format, guess_category, norm_text
from kondate.functions.urls import host, host_store, original_host, stable_id, task_key
from kondate.operators.metrics import finite

# Words, patterns and messages that results must agree on.
TITLE_END = r"[|｜]| -イオン| - イオン"
NO_NAMES = ["商品情報", "商品一覧"]
BODY_END = "その他の商品|関連商品|商品のご案内へ戻る|の評判・口コミ|チルド惣菜一覧"
SECTION = "栄養成分"
SECTION_LENGTH = 700
SECTION_END = "賞味期限|アレルギー情報|原材料名|保存方法|お問い合わせ"
PROTEIN = "(?:たんぱく質|たん白質|タンパク質)"
PROTEIN_NUMBER = rf"(?U){PROTEIN}\s*[:：]?\s*[\d.]"
NUTRIENTS = [("p", PROTEIN, "g"), ("f", "脂質", "g"), ("c", "炭水化物", "g"), ("kcal", "(?:熱量|エネルギー)", "kcal")]
UNIT = r"(?U)((?:100\s*(?:g|ml)|1\s*(?:包装|袋|個|本|食|カップ|パック|枚|粒|食分))[^。:：]{0,45}?(?:当たり|あたり))"
UNIT_UNSURE = "公式掲載単位（要確認）"
UNIT_FROM_NAME = "1商品（商品名に記載）"
NAME_PROTEIN = r"(?U)たんぱく質\s*(\d+(?:\.\d+)?)\s*g"
PRICES = [r"(?U)税込(?:価格)?\s*(\d[\d,]*(?:\.\d+)?)\s*円", r"(?U)(\d[\d,]*(?:\.\d+)?)\s*円\s*[（(]税込"]
PRICED_UNIT = r"(?U)^1\s*(?:包装|袋|個|本|カップ|パック)"
NOTE = "公式ページから自動取得。取扱い・販売地域・最新表示は店頭で確認してください。"
NOTE_NAME = " Pは商品名の表示値。"
NOTE_PRICE = (" 商品税込価格 ", "円（栄養表示単位との対応未確認）。")
NOTE_100 = " 栄養値は100g/ml当たりです。1包装当たりではありません。"
NOTE_STATE = " 販売状況は要確認。"
STATE = "現在この商品の情報を表示できません|販売を終了しました"
REASONS = {"heading": "商品見出しを特定できません", "name": "商品名を特定できません", "tables": "複数の栄養表示があり単位を特定できません", "protein": "たんぱく質量の公開表示を取得できません", "range": "栄養値が範囲外です", "chain": "対象チェーンでの取扱いを確認できません"}
PREVIEW = [("p", "たんぱく質"), ("f", "脂質"), ("c", "炭水化物"), ("kcal", "(?:熱量|エネルギー)")]
# End of the fixed values.
_PROTEIN_NUMBER = re.compile(PROTEIN_NUMBER.removeprefix("(?U)"))


def _before(text: Column, pattern: str) -> Column:
    """The text up to the first match."""
    return F.element_at(F.split(text, pattern, 2), 1)


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def pick_product_heading(parsed: DataFrame, original=original_host) -> DataFrame:
    """Adds heading: the first that is the title, else the only h1 on hosts whose titles differ from their headings."""
    texts = F.concat(F.array(F.regexp_replace(_before(F.coalesce("page.title", F.lit("")), TITLE_END), r"(?U)^\s+|\s+$", "")), F.transform("page.headings", lambda h: h["text"]))
    folded = parsed.withColumn("_texts", F.split(norm_text(F.array_join(texts, "\u0001")), "\u0001", -1))
    title = F.element_at("_texts", 1)
    numbered = F.arrays_zip(F.col("page.headings").alias("h"), F.slice("_texts", 2, F.size("page.headings")).alias("t"))
    matches = F.filter(numbered, lambda x: (x["h"]["text"] != "") & ((title == "") | (x["t"] == title)))
    h1 = F.filter("page.headings", lambda h: h["kind"] == "h1")
    only = F.when(~original(host(F.col("url"))) & (F.size(h1) == 1), F.element_at(h1, 1))
    heading = F.when(F.size(matches) > 0, F.try_element_at(matches, F.lit(1))["h"]).otherwise(only)
    return folded.withColumn("heading", heading).drop("_texts")


def section_of(body: str) -> str:
    """The first table of nutrients that has a number for protein; ''. Every occurrence of its word is placed by search among the numbers and ends of the text, found once."""
    numbers = [m.span() for m in _PROTEIN_NUMBER.finditer(body)]
    if not numbers:
        return ""
    begins, ends = [b for b, _ in numbers], [m.span() for m in re.finditer(SECTION_END, body)]
    for m in re.finditer(SECTION, body):
        begin, number = m.end(), bisect_left(begins, m.end())
        last = min(begin + SECTION_LENGTH, len(body))
        if number == len(numbers) or numbers[number][1] > last:
            continue
        end = bisect_left(ends, (begin, 0))
        if end < len(ends) and ends[end][1] <= last:
            last = ends[end][0]
        if numbers[number][1] <= last:
            return body[begin:last]
    return ""


@F.pandas_udf(T.StringType())
def _sections(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in bodies:
        yield part.map(section_of, na_action="ignore")


def nutrition_section(body: Column) -> Column:
    """The first table of nutrients that has a number for protein; ''. A page costs as much as it is long, however often it repeats the word."""
    return F.coalesce(_sections(F.when(F.contains(body, F.lit(SECTION)), body)), F.lit(""))


def extract_price(body: Column) -> Column:
    """The price with tax that stands before the first table."""
    before = _before(body, SECTION)
    found = F.coalesce(*[F.nullif(F.regexp_extract(before, p, 1), F.lit("")) for p in PRICES])
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def extract_products(pages: DataFrame, run_date: str, hosts: dict[str, str] | None = None, original=original_host) -> DataFrame:
    """Per page (url, html, and others that are carried along): product, reason ('' if there is one), page.

    Pages are dealt to all cores. Each is parsed once; everything after that is one projection. A page that can't be parsed has its fault as reason.
    """
    rows = pick_product_heading(spread(pages).withColumn("page", parse_html("html")).drop("html"), original)
    body = _before(F.array_join(F.slice("page.texts", F.coalesce("heading.offset", F.lit(0)) + 1, F.size("page.texts")), " "), BODY_END)
    rows = rows.withColumns({"_name": F.col("heading.text"), "_body": F.when(F.col("heading").isNull() | (F.size("page.texts") <= F.col("heading.offset")), "").otherwise(body)})
    rows = rows.withColumn("_section", nutrition_section(F.col("_body")))
    for name, label, unit in NUTRIENTS:
        rows = rows.withColumn(f"_{name}", _number(F.col("_section"), rf"(?iU){label}\s*[:：]?\s*(\d+(?:\.\d+)?)\s*{unit}"))
    found_unit = F.nullif(F.regexp_extract("_section", UNIT, 1), F.lit(""))
    rows = rows.withColumns({"_found_unit": found_unit, "_from_name": F.when(F.col("_p").isNull(), _number(F.col("_name"), NAME_PROTEIN)), "_package": extract_price(F.col("_body"))})
    rows = rows.withColumn("_unit", F.when(F.col("_from_name").isNotNull(), UNIT_FROM_NAME).otherwise(F.coalesce("_found_unit", F.lit(UNIT_UNSURE))))
    priced = F.col("_found_unit").isNotNull() & F.col("_unit").rlike(PRICED_UNIT)
    price = F.when(priced, F.col("_package"))
    p = F.coalesce("_p", "_from_name")
    note = F.concat(
        F.lit(NOTE),
        F.when(F.col("_from_name").isNotNull(), NOTE_NAME).otherwise(""),
        F.when(F.col("_package").isNotNull() & price.isNull(), F.concat(F.lit(NOTE_PRICE[0]), general_format(F.col("_package")), F.lit(NOTE_PRICE[1]))).otherwise(""),
        F.when(F.col("_unit").contains("100"), NOTE_100).otherwise(""),
        F.when(F.col("_body").rlike(STATE), NOTE_STATE).otherwise(""),
    )
    outside = F.lit(False)
    for value in (p, F.col("_f"), F.col("_c"), F.col("_kcal")):
        outside = outside | F.coalesce(~(finite(value) & value.between(0, 100_000)) & value.isNotNull(), F.lit(False))
    reason = F.when(F.col("page.fault").isNotNull(), F.col("page.fault")).when(F.col("heading").isNull(), REASONS["heading"]).when((F.length("_name") > 180) | F.col("_name").isin(NO_NAMES), REASONS["name"])
    reason = reason.when(F.regexp_count("_section", F.lit(PROTEIN_NUMBER)) > 1, REASONS["tables"]).when(p.isNull(), REASONS["protein"]).when(outside, REASONS["range"]).otherwise("")
    product = F.struct(
        stable_id(F.col("url")).alias("id"), host_store(F.col("url"), hosts).alias("store"), F.col("_name").alias("name"), guess_category(F.col("_name")).alias("category"), F.col("_unit").alias("unit"), F.col("url").alias("url"),
        F.lit(run_date).alias("checked"), note.alias("note"), p.alias("p"), F.col("_f").alias("f"), F.col("_c").alias("c"), F.col("_kcal").alias("kcal"), price.alias("price"), F.lit(True).alias("auto"),
    )
    rows = rows.withColumn("reason", reason)
    return rows.select(*[c for c in pages.columns if c != "html"], F.when(F.col("reason") == "", product).alias("product"), "reason", "page")


def extract_nutrition_preview(pages: DataFrame) -> DataFrame:
    """url, section, p, f, c, kcal of the first table's text, for a person to look at."""
    text = page_text("html")
    rows = spread(pages.select("url", "html")).select("url", text.alias("_text")).withColumn("_at", F.instr("_text", SECTION))
    rows = rows.withColumn("section", F.when(F.col("_at") > 0, F.substring(F.col("_text"), F.col("_at") + len(SECTION), F.lit(650))).otherwise(""))
    return rows.select("url", "section", *[_number(F.col("section"), rf"(?U){label}[\s:：]*([0-9]+(?:\.[0-9]+)?)\s*(?:g|kcal)").alias(name) for name, label in PREVIEW])


def shared_host_guard(extracted: DataFrame, hosts: DataFrame) -> DataFrame:
    """extracted (store, url, product, reason, page): on a host of several chains the page must name its chain.

    Then products get the chain and its identifier. hosts: store, host.
    """
    shared = hosts.groupBy("host").agg(F.count_distinct("store").alias("chains")).where("chains > 1").select(F.col("host").alias("_host"))
    rows = extracted.withColumn("_h", host(F.col("url"))).join(shared, F.col("_h") == F.col("_host"), "left")
    unnamed = F.col("_host").isNotNull() & ~F.contains(F.array_join("page.texts", " "), F.col("store"))
    reason = F.when((F.col("reason") == "") & unnamed, REASONS["chain"]).otherwise(F.col("reason"))
    stamped = F.col("product").withField("store", F.col("store")).withField("id", stable_id(task_key(F.col("store"), F.col("url"))))
    return rows.withColumn("reason", reason).withColumn("product", F.when(F.col("reason") == "", stamped)).select(extracted.columns)


def stores_of(rows: DataFrame) -> DataFrame:
    """Rows with a store of the default chains."""
    return rows.where(F.col("store").isin(dims.STORES))
