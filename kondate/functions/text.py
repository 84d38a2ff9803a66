"""Text functions: normalisation, categories, formatting and links."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kondate import dims
from kondate.functions.html import slices
from kondate.functions.patterns import first_named

# Words by category, in the order in which they count.
CATEGORY_WORDS = [
    ("飲む|のむ|ドリンク|飲料|豆乳|牛乳|コーヒー|ジュース|スムージー|お茶|緑茶|紅茶|天然水", "飲み物"),
    ("菓子パン|クリームパン|あんぱん|ドーナツ|ケーキ|チョコ|プリン|アイス|ヨーグルト|ナッツ|クッキー|大福", "おやつ"),
    ("おにぎり|おむすび|ご飯|ごはん|弁当|丼|麺|パン|パスタ|そば|うどん|サンド|寿司|すし", "主食"),
    ("サラダ|鶏|チキン|ささみ|豚|ハム|牛肉|豆腐|納豆|たまご|玉子|卵|大豆|さば|鮭|魚|海老|えび|ツナ|いか|かに|チーズ|スープ|味噌汁", "副菜"),
    ("バー|菓子|せんべい", "おやつ"),
]
UNKNOWN = "未確認"
NO_RATIO = "PFC比率：栄養値不足のため計算できません。"
SEARCH_WORDS = "たんぱく質 栄養成分"
SEARCH_URL = "https://www.google.com/search?q="
MAP_URL = "https://www.google.com/maps/search/?api=1&query="
#: Aliases up to which a test of each is quicker than an automaton in Python.
FEW_ALIASES = 64
TAG_KEYS = ["brand", "name", "operator", "brand:en", "name:en"]


def normalised_word(word: str) -> str:
    """NFKC, then case folding, for a parameter on the driver."""
    return unicodedata.normalize("NFKC", word).casefold()


@F.arrow_udf(T.StringType())
def norm_text(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same for a column; Spark has neither."""
    for part in slices(texts):
        yield pa.array([normalised_word(x.as_py()) if x.is_valid else None for x in part], pa.string())


def guess_category(name: Column, words: list[tuple[str, str]] = CATEGORY_WORDS, other: str = dims.OTHER) -> Column:
    out = None
    for pattern, category in words:
        hit = name.rlike(pattern)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(other)


def migrate_category(name: Column, category: Column, names: list[str] = dims.CATEGORIES, legacy: dict[str, str] = dims.LEGACY_CATEGORIES) -> Column:
    """A known category stays; else what the name says, else what the old name of the category became, else other."""
    guessed = guess_category(F.coalesce(name, F.lit("")))
    old = F.create_map(*[F.lit(x) for pair in legacy.items() for x in pair])
    renamed = F.coalesce(F.try_element_at(old, category), F.lit(dims.OTHER))
    return F.when(category.isin(names), category).when(guessed != dims.OTHER, guessed).otherwise(renamed)


def chain_from_text(text: Column, aliases: list[tuple[str, list[str]]] = dims.CHAIN_ALIASES) -> Column:
    """The first chain in order with an alias in a normalised text; null without.

    A few aliases are looked for one by one, which stays in the JVM; more by an automaton over all of them.
    """
    named = [(store, normalised_word(name)) for store, names in aliases for name in names]
    if len(named) > FEW_ALIASES:
        return first_named(text, named)
    out = None
    for store, names in aliases:
        hit = text.contains(normalised_word(names[0]))
        for name in names[1:]:
            hit = hit | text.contains(normalised_word(name))
        out = F.when(hit, store) if out is None else out.when(hit, store)
    return out


def chain_from_tags(tags: Column) -> Column:
    return chain_from_text(norm_text(F.concat_ws(" ", *[F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")) for k in TAG_KEYS])))


def parse_number_field(text: Column) -> Column:
    """Blank is null; text that is no number is null as well, see ``number_field_is_wrong``."""
    return F.when(F.trim(text) != "", F.trim(text).try_cast("double"))


def number_field_is_wrong(text: Column) -> Column:
    return F.coalesce((F.trim(text) != "") & F.trim(text).try_cast("double").isNull(), F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """`digits` decimals, rounded by the exact binary value with ties to even, as C's %f does; Java rounds its decimal text.

    The value is split in two halves whose products with the scale are exact, so the remainder is, too.
    """
    scale = float(10**digits)

    def rounded(size: Column, high: Column) -> Column:
        rest = lambda n: (high * scale - n) + (size - high) * scale
        whole = _let(F.floor(size * scale).cast("double"), lambda n: n + F.floor(rest(n)))
        return _let(whole, lambda n: _let(rest(n + 0.5), lambda r: n + F.when((r > 0) | ((r == 0) & (n % 2 == 1)), 1).otherwise(0)))

    def written(size: Column) -> Column:
        n = _let(size * 134217729.0, lambda wide: rounded(size, wide - (wide - size))).cast("long")
        if not digits:
            return n.cast("string")
        return _let(n, lambda x: F.concat(F.floor(x / F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((x % 10**digits).cast("string"), digits, "0")))

    exact = F.concat(F.when(value < 0, "-").otherwise(""), _let(F.abs(value), written))
    return F.when(F.abs(value) < 2.0**53 / scale, exact).otherwise(F.format_string(f"%.{digits}f", value))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def general_format(value: Column) -> Column:
    """Six significant digits without trailing zeros, as %g writes them."""
    size = F.abs(value)
    power = F.when(size > 0, F.floor(F.log10(size))).otherwise(F.lit(0))
    # the exponent counts after rounding to six digits; %e rounds exactly
    written = F.format_string("%.5e", value)
    exponent = F.coalesce(F.regexp_extract(written, r"e([+-][0-9]+)$", 1).try_cast("int"), power.cast("int"))
    fraction = F.greatest(F.lit(0), 5 - exponent)
    plain = F.when(exponent == 5, fixed(value, 0))
    for digits in range(1, 10):
        plain = plain.when(fraction == digits, fixed(value, digits) if digits < 7 else F.format_string(f"%.{digits}f", value))
    short = F.regexp_replace(plain.otherwise(fixed(value, 0)), r"(\.[0-9]*?)0+$", "$1")
    short = F.regexp_replace(short, r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(written, r"^([^e]*)e", 1), r"0+$", ""), r"\.$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.regexp_extract(written, r"e(.*)$", 1))
    return F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(short)


def fmt_value(value: Column, suffix: str = "g") -> Column:
    return F.when(value.isNull(), UNKNOWN).otherwise(F.concat(general_format(value), F.lit(suffix)))


def ratio_caption(p: Column, f: Column, c: Column) -> Column:
    parts = [F.concat(F.lit(f"{k} "), fixed(v, 1), F.lit("%")) for k, v in (("P", p), ("F", f), ("C", c))]
    return F.when(p.isNull() | f.isNull() | c.isNull(), NO_RATIO).otherwise(F.concat_ws(" ／ ", *parts))


def percent_encoded(text: Column) -> Column:
    """UTF-8 percent encoding that leaves letters, digits and _.-~/ as they are."""
    out = F.url_encode(text)
    for java, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(java), F.lit(plain))
    return out


def search_link(store: Column, query: Column, hosts: dict[str, str] | None = None) -> Column:
    """A web search on the chain's first host, or for its name, with the query or the default words."""
    first: dict[str, str] = {}
    for host, chain in (dims.domains() if hosts is None else hosts).items():
        first.setdefault(chain, host)
    site = F.concat(store, F.lit(" "))
    for chain, host in first.items():
        site = F.when(store == chain, F.lit(f"site:{host} ")).otherwise(site)
    asked = F.when(F.coalesce(query, F.lit("")) == "", SEARCH_WORDS).otherwise(query)
    return F.concat(F.lit(SEARCH_URL), percent_encoded(F.concat(site, asked)))


def map_link(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit(MAP_URL), fixed(lat, 6), F.lit(","), fixed(lon, 6))
