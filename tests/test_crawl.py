"""Links, frontier, crawl and collection against plain-Python models."""

import html as entities
import random
import re
from collections import Counter
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F

from kondate import dims
from kondate.functions import extract, html
from kondate.functions.html import parse_html
from kondate.functions.text import norm_text
from kondate.functions.urls import canonical_url, host, page_kind
from kondate.operators import collection, frontier
from kondate.operators.seen import SeenSet
from kondate.plans import fixtures as fx
from kondate.plans.queries import FOUND
from kondate.sources import io

WANTED = re.compile("たんぱく|チキン|ヨーグルト|豆腐|納豆|魚|サラダ|おにぎり")


def canonical(url):
    try:
        parts = urlsplit(url)
    except ValueError:
        return ""
    at = parts.hostname or ""
    if parts.scheme != "https" or not re.search(r"\.example\.(com|net|org)$", at) or parts.port not in (None, 443):
        return ""
    query = urlencode(sorted((k, v) for k, v in parse_qsl(parts.query) if not k.startswith("utm_")))
    return f"https://{at}{re.sub(';[^/]*$', '', parts.path) or '/'}" + (f"?{query}" if query else "")


def kind(url):
    path = urlsplit(url).path
    if re.search(r"\.(pdf|jpg|png|gif|zip|css|js|svg)$", path, re.I) or re.search("login|cart|checkout|contact|recruit|privacy|recipe|news|ir/", path, re.I):
        return ""
    return "generic" if re.search("product|goods|item|shohin|commodity|brand|select|food|lineup", path, re.I) else "list"


def links_of(store, url, text, hosts):
    """(url, kind, priority) of a page's links on the chain's hosts."""
    out = []
    for href, label in re.findall(r'<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', text or "", re.S):
        target = canonical(urljoin(url, entities.unescape(href)))
        if target and kind(target) and (store, urlsplit(target).hostname) in hosts:
            out.append((target, kind(target), 0 if WANTED.search(label) else 1))
    return out


def chain_of(url):
    return dims.STORES[len(urlsplit(url).hostname) % 10]


def model(spark, data):
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    return pages, {(chain_of(u), urlsplit(u).hostname) for _, u, _ in pages}


def first_found(links, seen, most):
    """New addresses of (store, parent_seq, url, kind, priority, depth), first discovery first, up to `most` of a chain."""
    best = {}
    for store, seq, url, k, priority, depth in links:
        if (store, url) not in seen:
            now, least = best.get((store, url), ((seq, priority, url, k), depth))
            best[store, url] = (min(now, (seq, priority, url, k)), min(least, depth))
    out, count = [], Counter()
    for (store, url), (_, depth) in sorted(best.items(), key=lambda x: x[1][0]):
        count[store] += 1
        if count[store] <= most:
            out.append((store, url, depth, count[store]))
    return out


def test_links_and_frontier(spark, data):
    pages, hosts = model(spark, data)
    links = [(chain_of(u), i, *x, 1) for i, u, text in pages for x in links_of(chain_of(u), u, text, hosts)]
    assert len(links) > 50
    seen = {(chain_of(u), canonical(u)) for _, u, _ in pages}
    found = Counter(tuple(r) for r in FOUND["g_next_frontier"](spark, data).select("store", "url", "depth", "seq").collect())
    assert found == Counter(first_found(links, seen, frontier.MOST_PENDING))


def test_crawl(spark, data):
    pages, hosts = model(spark, data)
    stored = {}
    for _, u, text in pages:
        if canonical(u):
            stored[canonical(u)] = min(stored.get(canonical(u), text), text)
    level = sorted({(chain_of(u), canonical(u)): (0, i) for i, u, _ in pages if canonical(u)}.items())
    seen, out = {key for key, _ in level}, []
    for depth in range(5):
        out += [(*key, depth, key[1] in stored) for key, _ in level]
        links = [(s, seq, *x, depth + 1) for (s, u), (_, seq) in level if u in stored for x in links_of(s, u, stored[u], hosts)]
        level = [((s, u), (d, seq)) for s, u, d, seq in first_found(links, seen, frontier.MOST_PENDING)]
        seen |= {key for key, _ in level}
    found = Counter(tuple(r) for r in FOUND["g_crawl_levels"](spark, data).select("store", "url", "depth", "found").collect())
    assert found == Counter(out)
    assert max(d for _, _, d, _ in out) >= 1


def test_a_frontier_without_a_limit_takes_all(spark):
    most = frontier.MOST_PENDING
    level = spark.range(most + 5).select(F.lit("s").alias("store"), F.concat(F.lit("p"), "id").alias("url"), F.col("id").alias("seq"))
    links = level.select("store", F.col("url").alias("parent"), F.concat(F.lit("u"), F.col("seq") % 3000).alias("url"), F.lit("list").alias("kind"), F.lit(1).alias("priority"), F.lit(1).alias("depth"))
    seen = spark.createDataFrame([("s", "u1")], "store string, url string")
    found = sorted(r["seq"] for r in frontier.next_frontier(links, level, seen, None).collect())
    assert found == list(range(1, most + 5))


def test_pages_of_one_address_have_their_own_turns(spark):
    level = spark.createDataFrame([("s", "p", 1), ("s", "q", 2), ("s", "p", 3)], "store string, url string, seq long")
    links = spark.createDataFrame([("s", "p", 3, "a", "list", 1, 1), ("s", "q", 2, "b", "list", 1, 1), ("s", "p", 1, "c", "list", 1, 1)], "store string, parent string, parent_seq long, url string, kind string, priority int, depth int")
    none = spark.createDataFrame([], "store string, url string")
    for most in (None, 100):
        assert [r["url"] for r in frontier.next_frontier(links, level, none, most).orderBy("seq").collect()] == ["c", "b", "a"]


def test_a_full_chain_is_replayed_by_one_task(spark):
    level = spark.range(50).select(F.lit("s").alias("store"), F.concat(F.lit("p"), "id").alias("url"), F.col("id").alias("seq"))
    links = level.select("store", F.col("url").alias("parent"), F.concat(F.lit("u"), "seq").alias("url"), F.lit("list").alias("kind"), F.lit(1).alias("priority"), F.lit(1).alias("depth"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = frontier.next_frontier(links, level, spark.createDataFrame([], "store string, url string"), 10)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    replay = plan[plan.index("MapInArrow") :]
    assert "REPARTITION_BY_COL" in replay and "BroadcastHashJoin" in replay and "SortMergeJoin" not in replay


def test_a_crawl_reaches_all(spark):
    at, n = "https://a.example.com", frontier.MOST_PENDING + 7
    pages = spark.createDataFrame([(f"{at}/list/", "".join(f'<a href="/goods/{i}/">x</a>' for i in range(n)))], "url string, html string")
    seeds = spark.createDataFrame([("s", f"{at}/list/", 0, 1)], "store string, url string, depth int, seq long")
    hosts = spark.createDataFrame([("s", "a.example.com")], "store string, host string")
    known, never = fx.example_host, fx.never
    found = frontier.crawl_levels(pages, seeds, hosts, 1, lambda u: canonical_url(u, known, never), lambda u: page_kind(u, known, never), never)
    assert found.count() == n + 1


def test_pages_of_one_file_are_dealt_to_all_cores(spark):
    pages = spark.createDataFrame([(f"https://a.example.com/{i}", product(f"n{i}", [])) for i in range(450)], "url string, html string").coalesce(1)
    for found in (extract.extract_products(pages, "2024-01-31"), extract.extract_nutrition_preview(pages)):
        assert found.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
        assert found.select("url").distinct().count() == 450


def test_parts_of_pages_go_by_cores(spark):
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert html.spread(spark.range(9)).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)


def test_addresses_of_links_are_worked_out_once(spark):
    rows = spark.createDataFrame([("s", "https://a.example.com/", 0, 1, '<a href="/goods/1/">x</a>')], "store string, url string, depth int, seq long, html string").withColumn("page", parse_html("html"))
    hosts = spark.createDataFrame([("s", "a.example.com")], "store string, host string")
    found = frontier.extract_links(rows, hosts, lambda u: F.concat(u, F.lit("MARK1")), lambda u: F.when(u.endswith("MARK2"), "list").otherwise("generic"), lambda h: h.isNotNull())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("MARK1"), plan.count("MARK2")) == (1, 1)
    assert [r["url"] for r in found.collect()] == ["https://a.example.com/goods/1/MARK1"]


def test_slices_of_a_batch(spark, monkeypatch):
    assert [len(x) for x in html.slices(iter([pd.Series(["a"] * 450), pd.Series([], dtype=str)]))] == [200, 200, 50, 0]
    rows = spark.range(1001).select("id", F.concat(F.lit("<h1>"), "id", F.lit("</h1>")).alias("html")).coalesce(1)
    found = rows.select("id", html.page_text("html").alias("text"), parse_html("html")["texts"][0].alias("first")).collect()
    assert sorted((r["id"], r["text"], r["first"]) for r in found) == [(i, str(i), str(i)) for i in range(1001)]


def test_batches_stay_as_sent():
    import tracemalloc

    import pyarrow as pa

    for helper, columns in ((html.parse_html, 1), (html.page_text, 1), (html.resolve_link, 2), (norm_text, 1)):
        sent = pa.array([f"<p>{i:05}" + " " * 10_000 for i in range(3000)])
        batch = iter([sent if columns == 1 else (sent, sent)])
        tracemalloc.start()
        found = [len(x) for x in helper.func(batch)]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == [html.SLICE] * 15
        assert most < sent.nbytes / 2
    assert norm_text.func(iter([pa.array(["Ａ", None, ""])])).__next__().to_pylist() == ["a", None, ""]


def test_link_labels(spark):
    labels = ["ペットフード", "商品一覧", "会社案内", "チキン", "ビール", ""]
    text = "".join(f'<a href="/x{i}/">{x}</a><a href="/goods/{i}/"><img alt="{x}"></a>' for i, x in enumerate(labels))
    rows = spark.createDataFrame([("s", "https://a.example.com/", 0, 7, text)], "store string, url string, depth int, seq long, html string").withColumn("page", parse_html("html"))
    hosts = spark.createDataFrame([("s", "a.example.com")], "store string, host string")
    known, never, always = fx.example_host, fx.never, lambda h: h.isNotNull()

    def found(original):
        got = frontier.extract_links(rows, hosts, lambda u: canonical_url(u, known, never), lambda u: page_kind(u, known, never), original)
        return {(r["url"].removeprefix("https://a.example.com"), r["kind"], r["priority"]) for r in got.collect()}

    goods = {("/goods/1/", "generic", 1), ("/goods/2/", "generic", 1), ("/goods/3/", "generic", 0), ("/goods/5/", "generic", 1)}
    assert found(never) == goods | {("/x1/", "list", 1), ("/x3/", "list", 0)}
    assert found(always) == goods | {("/x1/", "list", 1), ("/x2/", "list", 1), ("/x3/", "list", 0), ("/x5/", "list", 1)}


def product(name, links, protein="たんぱく質 5.0g"):
    return f"<title>{name}</title><h1>{name}</h1><p>x店</p><h3>栄養成分</h3><p>1包装当たり {protein}</p>" + "".join(f'<a href="{x}">チキン</a>' for x in links)


def test_collection_with_gates(spark):
    at = "https://a.example.com"
    pages = {"/list/": '<a href="/goods/1/">チキン</a><a href="/goods/2/">チキン</a><a href="/goods/3/">チキン</a><a href="/list2/">商品</a><a href="/goods/9/">チキン</a>', "/goods/1/": product("a", ["/goods/4/"]), "/goods/2/": product("b", ["/goods/5/"], ""), "/goods/3/": product("c", ["/goods/6/"]), "/goods/4/": product("d", []), "/goods/5/": product("e", []), "/list2/": '<a href="/goods/7/">チキン</a>', "/goods/7/": product("g", [])}
    rows = spark.createDataFrame([(at + k, v) for k, v in pages.items()], "url string, html string")
    seeds = spark.createDataFrame([("x店", f"{at}/list/", 0, 1)], "store string, url string, depth int, seq long")
    products = spark.createDataFrame([("x店", f"{at}/goods/3/", "2024-01-31"), ("x店", f"{at}/goods/1/", "2024-01-01")], "store string, url string, checked string")

    def visits(limits, shared=()):
        hosts = spark.createDataFrame([("x店", "a.example.com"), *((s, "a.example.com") for s in shared)], "store string, host string")
        known, never = fx.example_host, fx.never
        found = collection.collect_pages(rows, seeds, hosts, products, "2024-01-31", 4, limits, 2500, lambda u: canonical_url(u, known, never), lambda u: page_kind(u, known, never), never)
        return {r["url"].removeprefix(at): (r["depth"], r["outcome"], r["reason"], r["product"] and (r["product"]["store"], r["product"]["p"])) for r in found.collect()}

    none = "たんぱく質量の公開表示を取得できません"
    whole = {"/list/": (0, "list", "", None), "/goods/1/": (1, "added", "", ("x店", 5.0)), "/goods/2/": (1, "skipped", none, None), "/list2/": (1, "list", "", None), "/goods/9/": (1, "error", "", None), "/goods/4/": (2, "added", "", ("x店", 5.0)), "/goods/5/": (2, "added", "", ("x店", 5.0)), "/goods/7/": (2, "added", "", ("x店", 5.0))}
    assert visits((500, 2500, 40)) == whole  # the page of today is left out, and with it what only it links to
    assert visits((1, 2500, 40)).keys() == {"/list/", "/goods/1/", "/list2/"}
    assert visits((500, 2, 40)).keys() == {"/list/", "/goods/1/", "/goods/2/", "/list2/"}
    assert visits((500, 2500, 1)).keys() == whole.keys() - {"/list2/", "/goods/7/"}
    assert {u for u, v in visits((500, 2500, 40), ("y店",)).items() if v[1] == "added"} == {u for u, v in whole.items() if v[1] == "added"}  # all name their chain


def queued(level, links, known, most):
    """A plain queue: pages have their turn one by one and put their links behind what waits, while there is room."""
    out = []
    for store in sorted({s for s, _ in level}):
        pending = [u for s, u in level if s == store]
        seen, n = {u for s, u in known if s == store}, 0
        for _ in range(len(pending)):
            page = pending[0]
            offers = {}
            for s, parent, url, priority in links:
                if s == store and parent == page and url not in seen:
                    offers[url] = min(priority, offers.get(url, 9))
            for _, url in sorted((p, u) for u, p in offers.items()):
                if len(pending) >= most:
                    break
                pending.append(url)
                seen.add(url)
                n += 1
                out.append((store, url, n))
            pending.pop(0)
    return sorted(out)


def test_room_in_the_queue(spark):
    rng = random.Random(4)
    stores = ["a"] * 7 + ["b"] * 2 + ["c"]
    level = [(rng.choice(stores), f"p{i}") for i in range(60)]
    links = [(s, p, f"u{rng.randrange(70)}", rng.randrange(2)) for s, p in level for _ in range(rng.choice([0, 0, 3, 9]))]
    links += [(s, p, "menu", 1) for s, p in level]
    known = [(s, f"u{i}") for s in "abc" for i in range(5)]
    seen = spark.createDataFrame(known, "store string, url string")
    rows = spark.createDataFrame([(s, p, i) for i, (s, p) in enumerate(level)], "store string, url string, seq long")
    offers = spark.createDataFrame([(*x, "generic", 1) for x in links], "store string, parent string, url string, priority int, kind string, depth int").repartition(3)
    for most in (3, 10, 45, 100):
        found = sorted((r["store"], r["url"], r["seq"]) for r in frontier.next_frontier(offers, rows, seen, most).collect())
        assert found == queued(level, links, known, most), most
    assert len(found) > 60


def epochs(spark, folder, stop, broken=False):
    """A collection over the pages of three chains, in as many runs as it has levels, or in one."""
    at, chains = "https://a.example.com", ["x店", "y店"]
    pages = [(f"{at}/goods/{i}/", product(f"g{i} x店 y店", [f"/goods/{2 * i}/", f"/goods/{2 * i + 1}/"]) + ("<![foo[x]]>" if i == 5 else "")) for i in range(1, 16)]
    rows, hosts = spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame([(s, "a.example.com") for s in chains], "store string, host string")
    seeds = spark.createDataFrame([("x店", f"{at}/goods/1/", 0, 1), ("x店", f"{at}/goods/1/", 0, 2), ("x店", "", 0, 3)], "store string, url string, depth int, seq long")
    more = spark.createDataFrame([("y店", f"{at}/goods/3/", 0, 1)], "store string, url string, depth int, seq long")
    products = spark.createDataFrame([], "store string, url string, checked string")
    known, never = fx.example_host, fx.never
    make = lambda: collection.Collection(folder, rows, hosts, products, "2024-01-31", 3, (500, 2500, 40), 2500, lambda u: canonical_url(u, known, never), lambda u: page_kind(u, known, never), never, 4)
    run, states = make(), []
    run.start(seeds)
    for _ in range(9 if stop else 0):
        states.append(run.run(1))
        if broken and run.epoch() == 2:  # a run that ended before its mark was written
            run._file(2, "COMMITTED")[1].delete(run._file(2, "COMMITTED")[0], False)
            broken = False
        run = make()
        run.start(seeds)
        if states[-1] == "done":
            break
    states.append(run.run())
    first = run.visits()
    run = make()
    run.start(more)
    states.append(run.run())
    return first, run, states


def test_collection_goes_on_from_its_folder(spark, tmp_path):
    once, whole, _ = epochs(spark, f"file://{tmp_path}/once", False)
    parts, resumed, states = epochs(spark, f"file://{tmp_path}/parts", True, True)
    rows = lambda df: sorted((r["store"], r["url"], r["depth"], r["seq"], r["outcome"], r["reason"]) for r in df.collect())
    assert states[:3] == ["paused"] * 3 and states[-3:] == ["done"] * 3
    assert rows(resumed.visits()) == rows(whole.visits()) and len(rows(whole.visits())) > len(rows(once))
    fault = [r for r in rows(whole.visits()) if r[1].endswith("/5/")]
    assert {(r[4], r[5]) for r in fault} == {("error", "unknown status keyword 'foo' in marked section")}
    assert not [r for r in rows(once) if r[1].endswith(("/10/", "/11/"))]  # only the broken page links there
    counts = {r["store"]: r.asDict() for r in resumed.counts().collect()}
    for store, row in counts.items():
        mine = [r for r in rows(resumed.visits()) if r[0] == store]
        assert row["detail"] == len(mine) and row["added"] == sum(r[4] == "added" for r in mine) and row["errors"] == sum(r[4] == "error" for r in mine)
    assert not resumed.step()


def test_what_was_seen_is_not_shuffled(spark, tmp_path):
    seen = SeenSet(spark, f"file://{tmp_path}/seen", 8)
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("store"), F.concat(F.lit("u"), "id").alias("url"))
    seen.add(rows.where("url like '%1'"), 0)
    for _ in range(2):
        seen.add(rows.where("url like '%7'"), 1)
    new = rows.withColumn("x", F.lit(1)).unionByName(spark.createDataFrame([("0", "new", 2), ("1", "u7", 3), (None, "u7", 4)], "store string, url string, x int"))
    wanted = new.join(rows.where("url like '%1' or url like '%7'"), ["store", "url"], "left_anti")
    assert sorted(map(str, seen.unseen(new).collect())) == sorted(map(str, wanted.collect()))
    assert seen.unseen(new, 0).count() == 1003 - 100
    plan = seen.unseen(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan")
    seen.close()
    assert SeenSet(spark, f"file://{tmp_path}/seen", 8).rows().distinct().count() == 200


def test_a_collection_that_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "url string, html string")
    seeds = spark.createDataFrame([("x店", "https://a.example.com/goods/1/", 0, 1)], "store string, url string, depth int, seq long")
    run = collection.Collection(f"file://{tmp_path}/c", rows, spark.createDataFrame([("x店", "a.example.com")], "store string, host string"), spark.createDataFrame([], "store string, url string, checked string"), "2024-01-31", canonical=lambda u: canonical_url(u, fx.example_host, fx.never), kind_of=lambda u: page_kind(u, fx.example_host, fx.never), original=fx.never)
    run.start(seeds)
    assert run.run() == "empty" and run.visits().first()["outcome"] == "error"


def test_host_of_links(spark):
    row = spark.createDataFrame([("https://A.example.com:443/x",)], "u string").select(host(F.col("u")).alias("h")).first()
    assert row["h"] == "a.example.com"


def test_pages_are_read(spark, data):
    found = io.read_pages(spark, f"{data}/pages.parquet")
    assert found.columns == ["url", "html"] and found.count() == 50
