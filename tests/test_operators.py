"""Operators on small tables: seeds, merging, checks, maps, files and plans."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kondate import dims, schema, tables
from kondate.operators import cart, catalog, filters, frontier, geo, meals, metrics, quality, rank, skew, text_index
from kondate.plans import fixtures as fx
from kondate.plans import search
from kondate.sources import io
from kondate.tables import Scratch


def seeds(spark):
    return dims.seed_products(spark).withColumn("ord", F.monotonically_increasing_id())


def test_seed_products(spark):
    rows = {r["id"]: r for r in seeds(spark).select("id", metrics.protein_per_100yen().alias("v"), metrics.eligible().alias("e"), metrics.pfc_ratios()[0].alias("r")).collect()}
    assert rows["s1"]["v"] is None and rows["s1"]["r"] is None  # unit unsure, fat unknown
    assert rows["s2"]["e"] and rows["l1"]["e"] and not rows["f1"]["e"]
    assert rows["f1"]["v"] == pytest.approx(100 * 22.6 / 298)
    assert rows["f2"]["v"] is None


def test_validate_and_strict(spark):
    good, bad = quality.quarantine(seeds(spark))
    assert (good.count(), bad.count()) == (5, 0)
    twice = seeds(spark).unionByName(seeds(spark))
    with pytest.raises(quality.InvalidCatalog):
        quality.strict(twice)
    assert quality.quarantine(twice)[1].count() == 10


def test_strict_types(spark):
    lines = ['{"p": true}', '{"p": "3"}', '{"p": 3}', '{"p": null, "name": 4}', "nonsense", '{"auto": true, "p": 2.5}']
    found = spark.createDataFrame([(x,) for x in lines], "v string").select(quality.typed_product(F.col("v")).alias("x")).collect()
    assert [r["x"] and (r["x"]["wrong"], r["x"]["product"]["p"], r["x"]["product"]["auto"]) for r in found] == [(["p"], None, False), (["p"], None, False), ([], 3.0, False), (["name"], None, False), None, ([], 2.5, True)]


def test_merge_keeps_ids_and_edits(spark):
    base = seeds(spark).withColumn("auto", F.col("id") == "l1")
    new = base.drop("ord").withColumns({"url": F.regexp_replace("url", "mldata", "www"), "id": F.concat(F.lit("n"), "id"), "price": F.lit(1.0), "auto": F.lit(True), "seq": F.lit(1)})
    found = {r["id"]: r["price"] for r in catalog.merge_catalog(base, new.where("id in ('nl1', 'nf1')").withColumn("seq", F.col("seq").cast("long"))).collect()}
    assert found == {"s1": 278.64, "s2": 483.84, "l1": 1.0, "f1": 298.0, "f2": None}


def test_nearby_against_all_pairs(spark):
    import random

    random.seed(3)
    places = [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(300)] + [(89.99, 10.0), (89.99, -170.0), (0.0, 179.995), (0.0, -179.995), (-90.0, 0.0), (None, 1.0), (91.0, 0.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "point_id long, lat double, lon double")
    shops = points.select(F.col("point_id").alias("poi_id"), (F.col("lat") + 0.001).alias("lat"), (F.col("lon") - 0.001).alias("lon"))
    found = {(r[0], r[1]) for r in geo.nearby(points, shops, 5.0).select("point_id", "poi_id").collect()}
    pairs = points.alias("a").crossJoin(shops.alias("b")).where(geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 5).where("a.lat between -90 and 90 and b.lat between -90 and 90 and b.lon between -180 and 180")
    assert found == {(r[0], r[1]) for r in pairs.select("point_id", "poi_id").collect()}
    assert len(found) > 300


def test_branches_within_of_copies(spark):
    spots = [(35.0, 139.0), (35.01, 139.02), (0.0, 179.99), (-0.0, -179.995), (91.0, 0.0), (None, 1.0)]
    points = spark.createDataFrame([(i, *spots[i % 6]) for i in range(180)], "point_id long, lat double, lon double")
    shops = spark.createDataFrame([(i, *spots[i % 5]) for i in range(200)], "poi_id long, lat double, lon double")
    found = sorted(map(tuple, geo.branches_within(points, shops, 3.0).collect()))
    pairs = geo.nearby(points, shops, 3.0).groupBy("point_id").agg(F.count("*"), F.max(F.round("distance", 6)))
    assert found == sorted(map(tuple, pairs.collect())) and len(found) == 120


def test_bundle_rejects_wrong_parts(spark, tmp_path):
    row = {k: "" for k in schema.TEXTS} | {"id": "a", "store": "ポプラ", "category": "飲料", "name": "x"} | {k: None for k in schema.NUMBERS}
    fine = {"catalog": [row, {**row, "id": "b", "store": "?"}], "favorites": ["a", "b"], "cart": {"a": 2, "b": 1}}

    def read(name, bundle):
        (tmp_path / name).write_text(json.dumps(bundle, ensure_ascii=False))
        return io.read_catalog_bundle(spark, str(tmp_path / name))

    products, favorites, cart = read("a", fine)
    assert [r["category"] for r in products.collect()] == ["飲み物"]
    assert [r[0] for r in favorites.collect()] == ["a"] and [tuple(r) for r in cart.collect()] == [("a", 2.0)]
    for i, wrong in enumerate(({"favorites": [1]}, {"cart": {"a": 0}}, {"cart": {"a": True}}, {"cart": []}, {"catalog": [{**row, "p": True}]}, {"catalog": [row, row]}, {"catalog": [{**row, "p": -1}]}, {"catalog": 3})):
        with pytest.raises(quality.InvalidCatalog):
            read(f"b{i}", fine | wrong)


def test_replay_last_line_wins(spark, tmp_path):
    lines = ['{"store":"ポプラ","url":"u","name":"a"}', "{", '{"store":"ポプラ","url":3,"name":"b"}', '{"store":"?","url":"u","name":"c"}', '{"store":"ポプラ","url":"u","name":"d"}', '{"store":"ポプラ","url":"v"}']
    (tmp_path / "log").write_text("\n".join(lines))
    assert [r["name"] for r in io.replay_observations(spark, str(tmp_path / "log")).collect()] == ["d"]


def test_replay_keeps_large_files_of_a_log(spark, tmp_path, monkeypatch):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a").write_text('{"store":"ポプラ","url":"u","name":"a"}\n' * 9)
    (tmp_path / "log" / "b").write_text('{"store":"ポプラ","url":"v","name":"b"}')
    monkeypatch.setattr(io, "MOST_LOG_BYTES", 100)
    assert {r["name"] for r in io.replay_observations(spark, str(tmp_path / "log")).collect()} == {"a", "b"}
    assert [r["name"] for r in io.replay_observations(spark, str(tmp_path / "log"), newest_only=True).collect()] == ["b"]


def test_frontier_seeds_and_limits(spark):
    first = frontier.seed_frontier(spark)
    assert first.count() == 18 and first.where("url = ''").count() == 0
    assert frontier.seed_frontier(spark, counted=spark.createDataFrame([("セブンイレブン",)], "store string")).count() == 11
    links = spark.createDataFrame([("s", 1, 0, f"u{i}", "list", 1, i % 2) for i in range(9)], "store string, parent_seq long, depth int, url string, kind string, x int, priority int")
    seen = spark.createDataFrame([("s", "u0")], "store string, url string")
    found = [r["url"] for r in frontier.next_frontier(links, seen, 3).orderBy("seq").collect()]
    assert found == ["u2", "u4", "u6"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, data):
    from kondate.plans import fixtures as fx
    from kondate.plans import search

    assert "WindowGroupLimit" in plan(search.recommend(fx.catalog(spark, data)))
    near = plan(geo.nearby(fx.points(spark, data), fx.pois(spark, data)))
    assert "CartesianProduct" not in near and "NestedLoop" not in near
    scan = plan(rank.top_k(fx.catalog(spark, data).where("price < 90").select("id", "store", "ord"), ["store"], [F.asc("ord")], 3))
    assert "p_brand" not in scan.split("ReadSchema")[1]


def test_bundles_pass_or_fail_as_a_whole(spark, tmp_path):
    row = {k: "" for k in schema.TEXTS} | {"store": "ポプラ", "category": "飲料", "name": "x"} | {k: None for k in schema.NUMBERS}
    fine = {"catalog": [row | {"id": "a"}, row | {"id": "b", "store": "?"}], "favorites": ["a", "b"], "cart": {"a": 2, "b": 1}}
    cases = {"fine": fine, "favorites": fine | {"favorites": [1]}, "quantity": fine | {"cart": {"a": 0}}, "type": fine | {"catalog": [row | {"id": "a", "p": True}]}, "twice": fine | {"catalog": [row | {"id": "a"}] * 2}, "range": fine | {"catalog": [row | {"id": "a", "p": -1}]}, "form": fine | {"catalog": 3}}
    (tmp_path / "bundles").write_text("\n".join(json.dumps({"owner": k} | v, ensure_ascii=False) for k, v in cases.items()))
    products, favorites, cart, rejected = io.read_catalog_bundles(spark, str(tmp_path / "bundles"))
    assert [(r["owner"], r["id"], r["category"]) for r in products.collect()] == [("fine", "a", "飲み物")]
    assert [tuple(r) for r in favorites.select("owner", "product_id").collect()] == [("fine", "a")]
    assert [tuple(r) for r in cart.select("owner", "product_id", "qty").collect()] == [("fine", "a", 2.0)]
    assert {r["owner"]: r["reason"] for r in rejected.collect()} == {"favorites": "form", "quantity": "quantity", "type": "type", "twice": "rule", "range": "rule", "form": "form"}


def test_bundles_move_only_owners(spark, tmp_path, monkeypatch):
    row = lambda i, **more: {k: "" for k in schema.TEXTS} | {"id": i, "store": "ポプラ", "category": "飲料", "name": "x"} | {k: None for k in schema.NUMBERS} | more
    some = lambda n: {"catalog": [row(f"p{i}") for i in range(n)], "favorites": ["p1", "p1", "p9", "?"], "cart": {"p0": 2, "?": 1}}
    lines = [{"owner": "one"} | some(3), {"owner": "both"} | some(1), {"owner": "both", "catalog": [row("p9")], "favorites": ["p0"], "cart": {}}, {"owner": "bad"} | some(2), {"owner": "bad"} | some(1), {"owner": "large"} | some(30)]
    (tmp_path / "bundles").write_text("\n".join(map(json.dumps, lines)))
    monkeypatch.setattr(io, "MOST_LOOKS", 100)
    products, favorites, cart, rejected = io.read_catalog_bundles(spark, str(tmp_path / "bundles"))
    assert sorted((r["owner"], r["id"]) for r in products.collect()) == sorted([("one", f"p{i}") for i in range(3)] + [("both", "p0"), ("both", "p9")] + [("large", f"p{i}") for i in range(30)])
    assert sorted(tuple(r) for r in favorites.select("owner", "product_id").collect()) == [("both", "p0"), ("both", "p9"), ("large", "p1"), ("large", "p1"), ("large", "p9"), ("one", "p1"), ("one", "p1")]
    assert sorted(tuple(r) for r in cart.select("owner", "product_id", "qty").collect()) == [("both", "p0", 2.0), ("large", "p0", 2.0), ("one", "p0", 2.0)]
    assert [tuple(r) for r in rejected.collect()] == [("bad", "rule")]
    (tmp_path / "bundles").write_text("\n".join(json.dumps({"owner": f"o{i}"} | some(2)) for i in range(9)))
    for part in io.read_catalog_bundles(spark, str(tmp_path / "bundles"))[:3]:
        assert part.count() and "Exchange" not in plan(part)


def test_written_bundles_skip_the_rules(spark, tmp_path, monkeypatch):
    rows = [(f"o{i % 7}", f"p{i}", "ポプラ", "x", "主食", 0.5 * i if i % 5 else None) for i in range(40)]
    products = spark.createDataFrame(rows, "owner string, id string, store string, name string, category string, p double")
    for c in (*schema.TEXTS, *schema.NUMBERS, "auto"):
        if c not in products.columns:
            products = products.withColumn(c, F.lit(False) if c == "auto" else F.lit(None).cast("double") if c in schema.NUMBERS else F.lit("https://a.b/c/" if c == "url" else ""))
    cart = products.select("owner", F.col("id").alias("product_id"), F.when(F.col("owner") == "o3", 101.0).otherwise(2.5).alias("qty"))
    liked = spark.createDataFrame([("o1", "p1"), ("o1", "p1"), ("o1", "p2"), ("o2", None)], "owner string, product_id string")
    monkeypatch.setattr("kondate.tables.TASK_ROWS", 10)
    io.write_catalog_bundles(products, liked, cart, str(tmp_path / "bundles"))
    assert len(list((tmp_path / "bundles").glob("part-*"))) > 4
    monkeypatch.setattr(io, "_judged", lambda x, stores: F.struct(F.when(x.isNotNull(), "asked").alias("reason"), F.transform(x, lambda i: i["product"]).alias("catalog")))
    back, favorites, lines, rejected = io.read_catalog_bundles(spark, str(tmp_path / "bundles"))
    assert [tuple(r) for r in rejected.collect()] == [("o3", "quantity")]
    assert sorted(tuple(r)[:2] for r in back.select("owner", "id").collect()) == sorted(r[:2] for r in rows if r[0] != "o3")
    assert {tuple(r) for r in back.select("owner", "id", "store", "name", "category", "p").collect()} == {r for r in rows if r[0] != "o3"}
    assert [tuple(r) for r in favorites.select("owner", "product_id").collect()] == [("o1", "p1")] * 2
    assert {tuple(r) for r in lines.collect()} == {(r[0], r[1], 2.5) for r in rows if r[0] != "o3"}


def test_bundles_read_by_a_schema_or_as_variants(spark, tmp_path, monkeypatch):
    row = lambda i="a", **more: {k: "" for k in schema.TEXTS} | {"id": i, "store": "ポプラ", "category": "主食", "name": "x"} | {k: None for k in schema.NUMBERS} | {"auto": True} | more
    bundle = lambda *rows, favorites=("a", "b", "a", "?"), cart={"a": 2.0, "?": 1.0}: {"catalog": list(rows), "favorites": favorites, "cart": cart}  # noqa: B006, E731
    odd = [{"p": 3}, {"p": 3.5}, {"p": "3"}, {"p": True}, {"p": -1.0}, {"p": 100000.0}, {"p": 100000.5}, {"name": None}, {"name": 3}, {"name": "x" * 2000}, {"name": "あ" * 2001}, {"note": "a\nb\u0001\"/"}, {"store": "?"}, {"category": "飲料"}, {"category": "?"}, {"auto": None}, {"auto": "no"}, {"id": None}, {"more": 1}]
    odd += [{"url": u} for u in ("https://a.b/c/?d#e", "https://u@a.b/", "http://a.b/", "https:///a", "https://[a/", "https://a.b/\n", "https://a.b c", None)]
    some = [bundle(row(**o)) for o in odd] + [bundle(row("b"), row(**o)) for o in odd] + [bundle(), bundle(None), bundle(row(), row()), bundle(row()) | {"catalog": None}, bundle(row()) | {"more": 1}, [bundle(row())], 3]
    some += [bundle(row(), cart=c) for c in ({}, {"a": 0.0}, {"a": 100.0}, {"a": 100.5}, {"a": None}, {"a": "2"}, {"a": True}, {"a": 1e-7, "b": 1e300}, [], None)] + [bundle(row("a"), row("b"), favorites=f) for f in ([], [None, "a"], ["b", "a", "b"], [1], None)]
    dumped = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    lines = [dumped({"owner": f"o{i}"} | b if isinstance(b, dict) else b) for i, b in enumerate(some)]
    twice = dumped({"owner": "twice"} | bundle(row(), cart={"a": 2.0, "b": 1.0}))
    lines += [twice.replace('"b":1.0', '"a":1.0'), twice.replace("twice", "again").replace('"name":"x"', '"name":"x","name":"x"'), twice.replace("twice", "spaced").replace(":", ": "), twice.replace("twice", "more") + "x", twice.replace("twice", "cut")[:-1], "", dumped({"owner": None} | bundle(row())), dumped({"owner": 3} | bundle(row()))]
    (tmp_path / "bundles").write_text("\n".join(lines))

    def read():
        return [sorted(map(repr, (tuple(r[c] for c in sorted(r.asDict())) for r in part.collect()))) for part in io.read_catalog_bundles(spark, str(tmp_path / "bundles"))]

    found = read()
    assert all(map(len, found)) and {"'form'", "'type'", "'rule'", "'quantity'"} <= {x.split(", ")[-1].rstrip(")") for x in found[3]}
    asked = []
    monkeypatch.setattr(io, "surely_right", lambda rows, stores: asked.append(1) or F.lit(False))
    assert read() == found and asked


def test_surely_right_rows_break_no_rule(spark):
    rng = random.Random(3)
    texts = ["", "x", "https://a.b", "https://a.b/%E3/", "https://a@b/", "x" * 1999, "x" * 2001, "主食", "?", None]
    fields = [(k, [rng.choice(texts) for _ in range(3)]) for k in ("name", "unit", "url", "checked", "note")]
    rows = []
    for i in range(600):
        made = []
        for j in range(rng.randrange(4)):
            x = {k: "" for k in schema.TEXTS} | {"id": f"p{j}", "store": "ポプラ", "name": "x", "category": "主食", "auto": True} | {k: rng.choice([None, 0.0, 1.5, 1e5]) for k in schema.NUMBERS}
            if rng.random() < 0.4:
                x[rng.choice(fields)[0]] = rng.choice(texts)
            if rng.random() < 0.3:
                k, v = rng.choice([("p", -1.0), ("kcal", 1e5 + 1), ("price", float("nan")), ("id", "p0"), ("id", None), ("store", "?"), ("category", "飲料"), ("auto", None), ("f", float("inf"))])
                x[k] = v
            made.append(tuple(x[k] for k in schema.PRODUCT.names))
        rows.append((i, made))
    df = spark.createDataFrame(rows, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("rows", T.ArrayType(schema.PRODUCT))]))
    right = {r["i"] for r in df.where(quality.surely_right(F.col("rows"))).collect()}
    items = df.select("i", F.explode("rows").alias("x")).select("i", "x.*")
    wrong = {r["i"] for r in quality.validate(items, ("i", "id")).where("size(broken) > 0").collect()}
    assert not right & wrong and 200 < len(right) < 500 and len(right | wrong) > 500


def test_bundles_of_a_person(spark, tmp_path):
    products = spark.createDataFrame([(o, u, i, "ポプラ", "x", "飲料") for o, u in (("a", "u"), ("b", "u"), ("c", "v")) for i in ("p", "q")], "owner string, user_id string, id string, store string, name string, category string")
    for c in (*schema.TEXTS, *schema.NUMBERS, "auto"):
        if c not in products.columns:
            products = products.withColumn(c, F.lit(True) if c == "auto" else F.lit(None).cast("double") if c in schema.NUMBERS else F.lit(""))
    cart = products.select("owner", "user_id", F.col("id").alias("product_id"), F.lit(2.0).alias("qty")).where("id = 'p'")
    liked = spark.createDataFrame([("u", "q"), ("u", "p"), ("u", "x")], "user_id string, product_id string")
    for name, person, theirs in (("of", "user_id", liked), ("each", "owner", liked.join(products.select("owner", "user_id").distinct(), "user_id").drop("user_id"))):
        io.write_catalog_bundles(products, theirs, cart, str(tmp_path / name), person)
        assert all(f.name.endswith(".gz") for f in (tmp_path / name).glob("part-*"))
        found = sorted((r["owner"], r["favorites"], r["cart"]) for r in map(json.loads, [x["value"] for x in spark.read.text(str(tmp_path / name)).collect()]))
        assert found == [("a", ["p", "q", "x"], {"p": 2.0}), ("b", ["p", "q", "x"], {"p": 2.0}), ("c", [], {"p": 2.0})]


def test_sums_before_ranges(spark):
    import random

    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.randrange(-50, 400), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, seq long, i long, v int")
    for parts in (1, 7, 64):
        found = {r["i"]: r["s"] for r in rank.sums_before(df, "g", ["seq", "i"], {"s": F.col("v")}, parts).collect()}
        assert found == {i: sum(w for h, q, j, w in data if h == g and (q, j) < (s, i)) for g, s, i, _ in data}
    assert rank.sums_before(df.where("false"), "g", ["seq"], {"s": F.col("v")}).count() == 0


def test_dimensions(spark):
    hosts = {(r["store"], r["host"]): r["is_original"] for r in dims.hosts(spark).collect()}
    assert {s for s, _ in hosts} == set(dims.STORES)
    assert {h for _, h in hosts} <= set(dims.domains()) and {h for (_, h), own in hosts.items() if own} <= set(dims.ORIGINAL_HOSTS)
    assert [r["category"] for r in dims.categories(spark).orderBy("cat_ord").collect()] == dims.CATEGORIES
    assert [r["store"] for r in dims.stores(spark).orderBy("store_ord").collect()] == dims.STORES
    at = "https://www.daily-yamazaki.jp/goods/1/"
    page = "<title>x</title><h1>x</h1><p>デイリーヤマザキ</p><h3>栄養成分</h3><p>1包装当たり たんぱく質 5g</p>"
    rows = spark.createDataFrame([(at, page)], "url string, html string")
    seeds = spark.createDataFrame([("デイリーヤマザキ", at, 0, 1), ("ポプラ", at, 0, 2)], "store string, url string, depth int, seq long")
    found = frontier.collect_pages(rows, seeds, None, spark.createDataFrame([], "store string, url string, checked string"), "2024-01-31", 0)
    assert ("デイリーヤマザキ", "added") in {(r["store"], r["outcome"]) for r in found.collect()}


def test_searches_read_few_rows_and_find_the_pages(spark, data):
    rng = random.Random(6)
    catalog = fx.catalog(spark, data).withColumn("note", F.concat("note", F.when(F.col("ord") % 50 == 7, " ＲＡＲＥ豆腐").otherwise("")))
    words = ["", "brand", "rare", "豆腐", "豆", "a", "red brand", "rare brand#1", "nothing", "腐 rare", None]
    asked = [(f"r{i}", rng.sample(dims.STORES, rng.randint(1, 4)) + ["?"], rng.choice(words), rng.choice([None, dims.ANY, "主食"]), rng.choice([0.0, 12.0]), rng.choice([0.0, 15.0]), 0.0, rng.choice([0.0, 300.0]), rng.choice(rank.SORTS), rng.choice([20.0, 30.0, 80.0]), 25.0, rng.choice([1, 1, 2, 5])) for i in range(25)]
    requests = spark.createDataFrame(asked + [(f"again{r[0]}", *r[1:]) for r in asked[:5]], search.REQUEST)
    found = {}
    for r in search.search_requests(catalog, requests, 5).collect():
        found.setdefault(r["request_id"], []).append((r["place"], r["id"]))
    rows = catalog.cache()
    for id_, stores, query, category, minp, maxf, maxk, budget, sort, tp, tf, page in asked:
        wanted = []
        if tp + tf < 100:
            whole = filters.filter_items(rows, stores, query or "", category or dims.ANY, minp, maxf, maxk, budget)
            wanted = [(5 * (page - 1) + 1 + i, r["id"]) for i, r in enumerate(rank.paginate(rank.sort_catalog(whole, sort, (tp, tf, 100 - tp - tf)), page, 5).collect())]
        assert sorted(found.get(id_, [])) == wanted, id_
    assert all(found.get(f"again{r[0]}") and sorted(found[f"again{r[0]}"]) == sorted(found[r[0]]) for r in asked[:5] if r[0] in found)
    rows.unpersist()


def test_runs_are_read_as_far_as_needed(spark):
    scratch = Scratch(spark, "test-runs")
    keyed = spark.range(20_000).select(F.lit("s").alias("store"), F.lit("price").alias("run"), F.struct((F.col("id") * 7919 % 20_000).alias("number"), F.col("id").alias("ord")).alias("key"), F.col("id").alias("ord"))
    runs = text_index.Runs(keyed, scratch)
    searches = spark.createDataFrame([("all", "price", ["s"], 20, 1), ("tenth", "price", ["s"], 20, 10), ("none", "price", ["s", "?"], 20, 10**9)], "search string, run string, _stores array<string>, wanted int, step long")
    found, reads = text_index.first_matches(runs, searches, F.col("key.number") % F.col("step") == F.least(F.lit(0), F.col("step")), 20, scratch)
    got = {}
    for r in found.collect():
        got.setdefault(r["search"], []).append(r["key"]["number"])
    assert sorted(got["all"]) == list(range(20)) and sorted(got["tenth"]) == list(range(0, 200, 10)) and got["none"] == [0]
    blocks = {(r["search"], r["_store"]): r["blocks"] for r in reads.collect()}
    total = runs.blocks.count()
    assert total > 150 and blocks["all", "s"] <= 2 and blocks["tenth", "s"] <= 8 and blocks["none", "s"] >= total


def test_meals_are_the_best_of_all(spark, data):
    requests = fx.requests(spark).unionByName(fx.requests(spark).withColumns({"request_id": F.concat(F.lit("loose"), "request_id"), "tolerance": F.lit(200.0)}))
    ranked = Scratch(spark, "test-meals").table(meals.ranked_candidates(fx.catalog(spark, data), requests), "ranked")
    found = meals.best_meals(ranked, 5).collect()
    gaps = [F.abs(r - t) for r, t in zip(metrics.pfc_ratios(), (F.col("tp"), F.col("tf"), F.col("tc")), strict=True)]
    fits = (F.col("kcal") >= F.col("calories") * 0.75) & (F.greatest(*gaps) <= F.col("tolerance") + 1e-8)
    order = [F.desc(metrics.protein_per_100yen(unit=None)), F.asc(gaps[0] + gaps[1] + gaps[2]), F.asc("price"), *map(F.asc, ("s", "size", "a", "b"))]
    every = rank.top_k(meals.combinations(ranked).where(fits), ["request_id"], order, 5).collect()
    key = lambda r: (r["request_id"], r["rank"], tuple(x["id"] for x in r["items"]), r["price"])
    assert sorted(map(key, found)) == sorted(map(key, every)) and len(found) > 100


def test_few_meals_are_tested(spark):
    rng = np.random.default_rng(8)
    for tolerance in (10.0, 30.0):
        looked = []
        for _ in range(20):
            rows = np.stack([rng.uniform(2, 40, 120), rng.uniform(1, 25, 120), rng.uniform(5, 70, 120), rng.uniform(50, 600, 120), rng.uniform(80, 400, 120)], 1)
            rows = rows[np.argsort(-rows[:, 0] / rows[:, 4])]
            request = {"budget": 900.0, "calories": 800.0, "tp": 20.0, "tf": 25.0, "tc": 55.0, "tolerance": tolerance}
            looked.append(meals._Meals(rows[::2], rows[1::2], request, 5).search().looked)
        assert np.mean(looked) < 109_860 / 10


def test_nearest_branches_of_all(spark):
    rng = random.Random(11)
    spot = lambda: (rng.choice([35.0, 89.99, -89.999, 0.0]) + rng.uniform(-0.03, 0.03) * rng.choice([0.01, 0.2, 1]), rng.choice([139.0, 180.0, -180.0]) + rng.uniform(-0.03, 0.03) * rng.choice([0.01, 0.2, 1]))
    turned = lambda p: (max(-90.0, min(90.0, p[0])), (p[1] + 180) % 360 - 180)
    branches = [(f"b{i:04d}", "s", *turned(spot())) for i in range(700)] + [(f"c{i:04d}", "s", 35.01, 139.01) for i in range(60)] + [("bad", "s", None, 139.0)]
    points = [(i, *turned(spot())) for i in range(60)] + [(100 + i, 35.01, 139.01) for i in range(80)] + [(300, 10.0, 10.0), (301, 95.0, 0.0)]
    asked, there = spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(branches, "poi_id string, store string, lat double, lon double")
    found = sorted((r["point_id"], r["rank"], r["poi_id"]) for r in geo.nearest(asked, there, 3.0, 12).collect())
    every = asked.where("lat <= 90").crossJoin(there.where("lat is not null").select("poi_id", F.col("lat").alias("y"), F.col("lon").alias("x")))
    near = every.withColumn("d", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))).where("d <= 3")
    wanted = sorted((r["point_id"], r["rank"], r["poi_id"]) for r in rank.top_k(near.withColumn("d", F.round("d", 9)), ["point_id"], [F.asc("d"), F.asc("poi_id")], 12).collect())
    assert found == wanted and len(found) > 1000


def test_copies_of_places_are_met_once(spark, monkeypatch):
    points = spark.range(300).select(F.col("id").alias("point_id"), F.lit(35.0).alias("lat"), (F.lit(139.0) + F.col("id") % 3 / 100).alias("lon"))
    shops = points.withColumnRenamed("point_id", "poi_id").withColumn("store", F.lit("s"))
    met = []
    join = geo.salted_join
    monkeypatch.setattr(geo, "salted_join", lambda rows, table, keys, *more: (met.append((rows.count(), table.count())) if "level" in keys else None, join(rows, table, keys, *more))[1])
    found = geo.nearest(points, shops, 3.0, 4).select("point_id", "rank", "poi_id").collect()
    assert sorted(map(tuple, found)) == [(i, k + 1, i % 3 + 3 * k) for i in range(300) for k in range(4)]
    assert met and all(rows <= 3 * 9 and table <= 3 * 4 * 9 for rows, table in met)


def test_hot_keys_are_dealt_to_several_tasks(spark):
    rows = Scratch(spark, "test-skew").table(spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), "id"), "rows")
    table = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    joined = skew.salted_join(rows, table, ["k"], "left", most=50)
    assert sorted(map(tuple, joined.select("k", "id", "v").collect()), key=str) == sorted(map(tuple, rows.join(table, "k", "left").select("k", "id", "v").collect()), key=str)
    dealt = skew.salted_join(rows, table.withColumn("v", F.lit(1)), ["k"], most=50)
    assert rows.where("k = 7").count() > 2000 and dealt.where("k = 7").count() == rows.where("k = 7").count()
    total = 6000 // 50
    parts = rows.withColumn("part", F.pmod(F.xxhash64("k", "id"), F.ceil(F.lit(rows.where("k = 7").count()) / total))).where("k = 7").groupBy("part").count()
    assert parts.agg(F.max("count")).first()[0] < 2 * total


def test_addresses_of_a_catalog_are_worked_out_once(spark):
    fields = ", ".join([*[f"{c} string" for c in schema.TEXTS], *[f"{c} double" for c in schema.NUMBERS], "auto boolean"])
    row = lambda i, url: (i, "ポプラ", "n", "主食", "1食", url, "", "", 1.0, 1.0, 1.0, 1.0, 1.0, True)
    base = spark.createDataFrame([(*row("a", "u1"), 1), (*row("b", "u1"), 2), (*row("c", ""), 3)], f"{fields}, ord long").coalesce(1)
    new = spark.createDataFrame([(*row("n", "u1"), 1), (*row("m", "u2"), 2)], f"{fields}, seq long")
    found = catalog.merge_catalog(base, new, canonical=lambda u: F.when(u != "MARK", u))
    assert "MARK" not in found._jdf.queryExecution().optimizedPlan().toString()  # written before the steps that need it
    assert sorted(r["id"] for r in found.collect()) == ["a", "b", "c", "m"]


def test_rows_of_one_file_are_indexed_on_all_cores(spark, monkeypatch):
    parts = {}

    class Index(text_index.TextIndex):
        def __init__(self, rows, scratch):
            parts["catalog"] = rows.rdd.getNumPartitions()
            super().__init__(rows, scratch)

    monkeypatch.setattr(search, "TextIndex", Index)
    rows = fx.catalog(spark, "/root/testdata/sf0.001").coalesce(1)
    asked = spark.createDataFrame([("r1", ["ポプラ"], "red", None, 0.0, 0.0, 0.0, 0.0, "price", 20.0, 25.0, 1)], search.REQUEST)
    search.search_requests(rows, asked)
    assert parts["catalog"] > 1


def test_cart_lines_are_dealt_by_rows(spark, data, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    lines = fx.table(spark, data, "lineitem").count()
    carts, products = fx.carts(spark, data), fx.catalog(spark, data)
    held = lambda df: df.rdd.glom().map(len).collect()
    assert len(held(carts)) == -(-lines // 500) and max(held(carts)) < 1000
    pairs = carts.select("cart_id", "product_id").distinct().count()
    assert carts.count() == pairs
    found = {r["cart_id"]: r for r in cart.cart_totals(cart.cart_lines(carts, products)).collect()}
    rows = fx.table(spark, data, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("cart_id")).agg(F.count_distinct("l_partkey").alias("n"))
    assert {r["cart_id"] for r in rows.collect()} == found.keys()
    assert sum(r["n"] for r in rows.collect()) == pairs
