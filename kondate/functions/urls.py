"""Addresses: parts, safety, canonical form and kind of page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kondate import dims

#: scheme, authority, path, query by the standard's own expression
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
HostTest = Callable[[Column], Column]


def known_host(host: Column) -> Column:
    return host.isin(sorted(dims.domains()))


def original_host(host: Column) -> Column:
    return host.isin(sorted(dims.ORIGINAL_HOSTS))


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _SPLIT, 1))


def _authority(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _SPLIT, 2)


def userinfo(url: Column) -> Column:
    return F.regexp_extract(_authority(url), r"^(.*)@", 1)


def host(url: Column) -> Column:
    """In lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(_authority(url), r"^(?:.*@)?(\[[^\]]*\]|[^:@]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(_authority(url), r"^(?:.*@)?(?:\[[^\]]*\]|[^:@]*):(.*)$", 1)


def path(url: Column) -> Column:
    """Without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(_clean(url), _SPLIT, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _SPLIT, 4)


def safe_link(url: Column) -> Column:
    """https with a host and without user or password."""
    brackets = (F.contains(_authority(url), F.lit("[")) != F.contains(_authority(url), F.lit("]")))
    return (scheme(url) == "https") & (host(url) != "") & userinfo(url).isin("", ":") & ~brackets


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def sorted_query(text: Column, drop_utm: bool) -> Column:
    """Its pairs with a value, decoded, sorted and encoded again."""
    pairs = F.filter(F.split(text, "&"), lambda s: s.rlike(r"(?s)^[^=]*=."))
    split = F.transform(pairs, lambda s: F.struct(_decoded(F.regexp_extract(s, r"(?s)^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(s, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))
    if drop_utm:
        split = F.filter(split, lambda s: ~s["k"].startswith("utm_"))
    return F.array_join(F.transform(F.array_sort(split), lambda s: F.concat(_encoded(s["k"]), F.lit("="), _encoded(s["v"]))), "&")


def _built(host_: Column, path_: Column, query_: Column) -> Column:
    return F.concat(F.lit("https://"), host_, path_, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(F.lit("")))


def _parts(url: Column) -> Column:
    """scheme, user, host, port, path and query, from one split each of the address and its authority."""
    whole = F.transform(F.array(_clean(url)), lambda u: F.struct(*[F.regexp_extract(u, _SPLIT, i).alias(n) for i, n in enumerate(("scheme", "at", "path", "query"), 1)]))
    authority = r"^(?:(.*)@)?(\[[^\]]*\]|[^:@]*)(?::(.*))?$"
    named = lambda x: F.struct(F.lower(x["scheme"]).alias("scheme"), F.regexp_extract(x["at"], authority, 1).alias("user"), F.lower(F.regexp_extract(x["at"], authority, 2)).alias("host"), F.regexp_extract(x["at"], authority, 3).alias("port"), F.regexp_replace(x["path"], r";[^/]*$", "").alias("path"), x["query"].alias("query"))
    return F.transform(whole, named)


def canonical_url(url: Column, known: HostTest = known_host, original: HostTest = original_host) -> Column:
    """The identity of a page, or '' for anything but https on a known host without user and port.

    A malformed port is '' as well. On original hosts a detail page loses its query, and paths end in / or .html;
    on the others tracking parameters go. The address is split once, as a bound value of the expression.
    """

    def built(x: Column) -> Column:
        h, p, q = x["host"], x["path"], x["query"]
        fits = (x["scheme"] == "https") & known(h) & x["user"].isin("", ":") & x["port"].rlike(r"^(0*443)?$")
        general = _built(h, F.when(p == "", "/").otherwise(p), sorted_query(q, True))
        moved = F.replace(p, F.lit("/sp/recommend/"), F.lit("/recommend/"))
        detail = moved.rlike(r"/(?:item|detail)/") | moved.rlike(r"/goods/[^/]+/\d+\.html")
        tidy = F.when(moved.endswith(".html"), moved).otherwise(F.concat(F.regexp_replace(moved, "/+$", ""), F.lit("/")))
        at = F.when(h == "mldata.lawson.co.jp", "www.lawson.co.jp").otherwise(h)
        own = _built(at, tidy, F.when(detail, "").otherwise(sorted_query(q, False)))
        return F.when(~F.coalesce(fits, F.lit(False)), "").when(original(h), own).otherwise(general)

    return F.element_at(F.transform(_parts(url), built), 1)


# The forms of addresses by chain.
_ASSET = r"(?i)\.(?:pdf|jpg|png|gif|zip|css|js|svg)$"
_EXCLUDED = r"(?i)login|cart|checkout|contact|recruit|privacy|recipe|news|ir/"
_PRODUCT = r"(?i)(?:product|goods|item|shohin|commodity|brand|select|food|lineup)"


def page_kind(url: Column, known: HostTest = known_host, original: HostTest = original_host) -> Column:
    """detail, list, generic or ''."""
    return F.element_at(F.transform(_parts(url), lambda x: _kind(x["host"], x["path"], known, original)), 1)


def _kind(h: Column, p: Column, known: HostTest, original: HostTest) -> Column:
    sej, lawson, family, topvalu = (h == x for x in ("www.sej.co.jp", "www.lawson.co.jp", "www.family.co.jp", "www.topvalu.net"))
    own = p.startswith("/recommend/original/")
    kind = F.when(sej & p.rlike(r"^/products/a/item/\d+/$"), "detail")
    kind = kind.when(sej & p.startswith("/products/a/") & (p.contains("itemresult") | p.contains("/cat/")), "list")
    kind = kind.when(lawson & own & p.rlike(r"^/recommend/original/detail/\d+_\d+\.html$"), "detail").when(lawson & own, "list")
    kind = kind.when(family & p.rlike(r"^/goods/[^/]+/\d+\.html$"), "detail")
    kind = kind.when(family & p.rlike(r"^/goods(?:/[a-z_]+)?\.html$") & ~p.rlike("safety|daily|convenience|cosme|liquor"), "list")
    kind = kind.when(topvalu & p.rlike(r"^/items/detail/\d+/$"), "detail").when(topvalu & ((p == "/items/") | p.rlike(r"^/items/list/\d+/$")), "list")
    other = known(h) & ~original(h)
    kind = kind.when(~other, "").when(p.rlike(_ASSET), "").when(p.rlike(_EXCLUDED), "").when(p.rlike(_PRODUCT), "generic")
    return kind.otherwise("list")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that filters above don't work out again: they can't be moved below a generator."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def task_key(store: Column, url: Column) -> Column:
    return F.concat(store, F.lit("|"), url)


def stable_id(key: Column) -> Column:
    return F.concat(F.lit("auto_"), F.substring(F.sha2(key, 256), 1, 20))


def host_store(url: Column, hosts: dict[str, str] | None = None) -> Column:
    """The chain of a known host, else null. For a hosts table join ``host(url)`` to it."""
    pairs = [F.lit(x) for pair in (dims.domains() if hosts is None else hosts).items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), host(url))
