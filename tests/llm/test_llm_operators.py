"""The ten operators against brute force, on tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from kondate.llm import ann, exact_dedup, langid, mixing, ngram_join, packing, pii, sharding, url_filter, warc
from kondate.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, slot int, kept string, label long, digest string, _t string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def documents(spark, rows):
    """Rows of (doc_id, text[, lang, source]), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "a")), None, 1, "x", 3, "y", "z") for r in rows], DOC)


@pytest.fixture(scope="module")
def corpus(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def odd(corpus):
    """The corpus with null, empty, very long, repeated and copied rows."""
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    return [*corpus, (9001, None, None, None), (9002, "", "en", None), (9003, "", "en", "a"), (9004, long, "en", "a"), (9005, long + "\t", "en", "a"), (9006, "one  two", "en", "a"), (9007, "one\x0btwo", "en", "a"), (9006, "one  two", "en", "a"), (9008, "ONE two", "en", "a"), (None, "one two", "en", "a")]


# -- 1 ---------------------------------------------------------------------------------------------------------------


def test_archives(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("aäß日\r\n ") for _ in range(150_000))
    rows = [(1, "https://a/\r\nX: y", "x" * 100), (2, "u", "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, None, None), (6, "u", ""), (7, "ü", long), (8, "u", long), (9, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 9), (7, "ü", long), (None, "u", long), (12, "u", "é" * 50), (11, "u", "é" * 50)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, refers_to int")
    found = warc.archive_pages(pages).collect()
    first = {}
    for i, _, html in sorted((r for r in rows if r[0]), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    wanted = []
    for i, _, html in rows:
        body = (html or "").encode()
        refers = first[html or ""] if i and len(body) >= 100 and first[html or ""] != i else None
        wanted.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers else "response", refers, None))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, wanted))


def test_archive_checks(spark):
    payload = b"abc" * 1000
    assert warc.dechunked(warc.chunked(payload, 7)) == payload and warc.dechunked(warc.chunked(b"", 7)) == b""
    records = list(warc.records_of(1, "u", payload, None, "<urn:x>", 500, 64))
    folder = Scratch(spark, "broken").path("archives")

    def read(kept):
        lines = spark.createDataFrame([(bytearray(r),) for r in kept], "v binary").select(F.col("v").cast("string"))
        lines.write.mode("overwrite").option("lineSep", "\r\n\r\n").text(folder)
        return [(r["payload"] and bytes(r["payload"]), r["problem"]) for r in warc.read_archives(spark, folder).collect()]

    assert len(records) > 3
    assert read(records[::-1]) == [(payload, None)]
    assert read(records[:1] + records[2:]) == [(None, "segments are missing")]
    assert read(records[:-1])[0][0] is None
    assert read([records[-1].replace(b"Total-Length: ", b"Total-Length: 1"), *records[:-1]]) == [(None, "the total length differs")]
    assert read([records[0].replace(b"Content-Length", b"Content-Size")])[0][1] == "the content length is missing or no number"
    assert sorted(read([*records, b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc"]), key=str)[0] == (None, "the block is cut short")
    for broken in (b"1\r\nz\r\n3\r\nabc\r\n-e\r\n", b"+1\r\nz\r\n0\r\n\r\n", b"5\r\nab\r\n", b"", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)
    assert warc.inflated(zlib.compress(b"x" * 99, wbits=31)[:-9])[1] and warc.inflated(b"\x1f\x8bxxxx")[1]


def test_most_pages_come_in_segments(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    folder = Scratch(spark, "segments").path("archives")
    warc.write_archives(pages, folder)
    kinds = Counter(m for r in spark.read.format("binaryFile").load(folder).collect() for m in re.findall(rb"WARC-Type: ([a-z]+)", warc.inflated(bytes(r["content"]))[0]))
    assert kinds[b"continuation"] > kinds[b"response"] > 0


# -- 2 ---------------------------------------------------------------------------------------------------------------


def test_raking_meets_its_margins(spark, corpus):
    rows = mixing.with_margins(documents(spark, odd(corpus)))
    found = mixing.mixture(rows, 0.5).toPandas()
    assert (found["_miss"] >= 0).all()
    table = rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("t")).toPandas()
    weight = table.assign(w=table["t"] / table["t"].sum())
    targets = {}
    for m in mixing.MARGINS:
        share = table.groupby(f"_{m}")["t"].sum()
        share = share[share > 0] ** mixing.POWERS[m]
        targets[m] = share / share.sum()
    for _ in range(200):  # the same by numpy
        for m in mixing.MARGINS:
            weight["w"] *= weight[f"_{m}"].map(targets[m]).fillna(0) / weight.groupby(f"_{m}")["w"].transform("sum").replace(0, 1)
    keys = [f"_{m}" for m in mixing.MARGINS]
    both = found.merge(weight, on=keys)
    assert len(both) == len(found) == len(weight)
    assert np.allclose(both["weight"], both["w"], atol=1e-3)
    assert ((found["probability"] >= 0) & (found["probability"] <= 1)).all()


def test_raking_alike_by_shuffles(spark, corpus, monkeypatch):
    rows = mixing.with_margins(documents(spark, corpus)).select("doc_id", *[f"_{m}" for m in mixing.MARGINS], "_tokens").persist()
    monkeypatch.setattr(mixing, "rake", partial(mixing.rake, rounds=2))
    weights = []
    for most in (mixing.ONE_TASK_CELLS, 0):
        monkeypatch.setattr(mixing, "ONE_TASK_CELLS", most)
        weights.append({tuple(r[:3]): r[3] for r in mixing.mixture(rows, 0.5).select("_source", "_lang", "_topic", "weight").collect()})
    assert weights[0] == pytest.approx(weights[1])


def test_sampling(spark, corpus):
    docs = documents(spark, odd(corpus))
    found = mixing.sample_decisions(docs, 0.5).collect()
    assert len(found) == len(odd(corpus))
    plain = {r[0]: len((r[1] or "").encode().split()) for r in odd(corpus)}
    assert all(r["tokens"] == plain[r["doc_id"]] for r in found)
    assert Counter(r["doc_id"] for r in found if r["sampled"]) == Counter(r["doc_id"] for r in mixing.sample_documents(docs, 0.5).collect())
    everything = mixing.sample_decisions(documents(spark, corpus), 1e9).where("tokens > 0 and not sampled").count()
    assert everything == 0
    assert mixing.sample_decisions(documents(spark, [(1, "a b")]).where("false")).count() == 0
    assert mixing.sample_documents(docs, 0.5).columns == docs.columns


def test_columns_of_any_name_stay(spark, corpus):
    names = ["_tokens", "_topic", "_source", "weight", "probability", "row", "_digest", "id", "digest", "group_size"]
    docs = documents(spark, [*corpus[:50], (9001, None, "en", "a"), (9002, "", None, None)]).withColumns({n: F.lit(f"mine {n}") for n in names if n not in ("digest",)})
    for kept in (mixing.sample_documents(docs, 0.9), exact_dedup.keep_first(docs)):
        assert kept.columns == docs.columns
        assert kept.count() > 0 and kept.where(" or ".join(f"{n} <> 'mine {n}'" for n in names if n != "digest")).count() == 0
    given = mixing.sample_decisions(docs, 0.5, topic=F.col("lang"))
    assert {r["topic"] for r in given.select("topic").distinct().collect()} >= {"en"}


def test_expected_sample_follows_the_margins(spark):
    counts = {("a", "en"): 60, ("a", "es"): 5, ("b", "en"): 10, ("b", "es"): 20, ("c", "en"): 2, ("c", "es"): 3}
    rows = [(s, lang, "w " * 10) for (s, lang), n in counts.items() for _ in range(n)]
    docs = documents(spark, [(i, text, lang, s) for i, (s, lang, text) in enumerate(rows)])
    cells = mixing.mixture(mixing.with_margins(docs), 0.5)
    target = {"en": 72**0.5 / (72**0.5 + 28**0.5)}
    out = cells.toPandas()
    assert (out["_miss"] < 1e-3).all()
    out["expected"] = out["probability"] * out["_cell_tokens"]
    assert out["expected"].sum() == pytest.approx(500, rel=1e-3)
    assert out[out["_lang"] == "en"]["expected"].sum() == pytest.approx(500 * target["en"], rel=1e-3)
    assert out[out["_source"] == "c"]["probability"].min() == pytest.approx(1, rel=1e-3)  # wants 71 of 50 tokens: takes all
    a, b = (out[out["_source"] == s]["expected"].sum() for s in "ab")
    assert a / b == pytest.approx((65 / 30) ** 0.5, rel=1e-3)
    wanted = {m: spark.createDataFrame([(v, 1.0 / len(vs)) for v in vs], "value string, target double") for m, vs in (("source", "abc"), ("lang", ["en", "es"]), ("topic", ["brief"]))}
    misses = {r["value"]: r["miss"] for r in mixing.expected_margins(cells, 0.5, wanted).collect()}
    assert misses["c"] == pytest.approx(0.1 * 3 - 1, rel=1e-3) and misses["brief"] == pytest.approx(0, abs=1e-3)


# -- 3 ---------------------------------------------------------------------------------------------------------------


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards(spark, corpus):
    rows = odd(corpus) + [(2**63 - 1, "a"), (-5, "b"), (-(2**63), "c"), (0, "d")]
    found = sharding.shard_documents(documents(spark, [r if len(r) > 2 else (*r, "en", "a") for r in rows])).collect()
    assert len(found) == len(rows)
    sizes = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sizes
    slots = defaultdict(list)
    for r in found:
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"] or 0, 24), jump(r["doc_id"] or 0, 25))
        assert r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(documents(spark, [(1, "a")]).where("false")).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------------------------

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits(m)[::-1]))
        found += [(m.start(), 2, m.end())] * (12 <= len(digits(m)) <= 19 and total % 10 == 0)
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans(corpus):
    rng = random.Random(2)
    made = ["".join(rng.choice("a.@-1 2+(9") for _ in range(rng.randrange(60))) for _ in range(4000)]
    hard = ["a@b.c@d.e", "x@y..z", "1.2.3.4.5.6.7.8", "0000255.1.1.256", "4111 1111-1111 1111", "+1 (555) 010-9999)", "a@@b.c", ".@a.b", "é@a.b", "１２３", "9" * 5000, "a" * 5000, "1." * 3000, "+1" * 1000]
    for text in [*made, *hard, *[r[1] for r in corpus if r[1]]]:
        assert pii.base_spans(text) == plain_spans(text), text[:80]
    for text in ("9" * 500_000, "a" * 500_000, "1." * 300_000, "a@" * 300_000):  # no time to speak of
        assert len(pii.base_spans(text)) < 100_000


def test_disclosure(spark):
    rows = [(i, f"the ward of zanzibar number{'x' * i} wrote from a@b.org to everyone", "en", "a") for i in range(6)]
    rows += [(100 + i, f"the ward number{'y' * i} wrote to everyone", "en", "a") for i in range(40)]
    rows += [(300, "+1 555 010 9999 10.0.0.1 4111 1111 1111 1111 x@y.org z@y.org", "en", "a")]
    rows += [(200, None, None, None), (201, "", None, None), (202, "zanzibar alone", "en", "a"), (0, rows[0][1], "en", "a")]
    docs = documents(spark, rows)
    found = pii.find_personal_data(docs)
    out = {r["doc_id"]: r for r in pii.digest_spans(found).collect()}
    assert pii.digest_spans(found).count() == len(rows)
    for i, text, *_ in rows:
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(text or ""))
        assert out[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [out[i][f"n_{kind}"] for kind in pii.KINDS[:4]] == [sum(x[1] == k for x in plain_spans(text or "")) for k in range(4)]
    assert "term:16:24" not in out[202]["spans"] and out[202]["spans"] == "" and out[200]["spans"] == ""
    start = rows[0][1].index("zanzibar")
    assert f"term:{start}:{start + 8}" in out[0]["spans"]  # stands almost only where the address does
    assert "ward" not in [rows[0][1][int(a) : int(b)] for a, b in re.findall(r"term:(\d+):(\d+)", out[0]["spans"])]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, found).collect()}
    assert "@" not in clean[1] and "zanzibar" not in clean[1] and "[EMAIL]" in clean[1] and clean[202] == "zanzibar alone"
    assert pii.digest_spans(pii.find_personal_data(docs.where("false"))).count() == 0


def test_words_of_one_text_and_of_its_copies_stay(spark):
    rows = [(i, f"all of us saw the ward and wrote number{'x' * i}", "en", "a") for i in range(400)]
    rows += [(900, "all of us saw quagga and wrote to solo@a.org about the ward", "en", "a"), (901, "solo is all that we saw", "en", "a")]
    rows += [(910 + i, f"Kim, 王小 and AB12 of the ward of {12 if i else 13} beds, call +1 555 010 9999", "en", "a") for i in range(5)]
    out = {r["doc_id"]: r["spans"] for r in pii.digest_spans(pii.find_personal_data(documents(spark, rows))).collect()}
    assert not [x for x in out.values() if "term" in x] and "email" in out[900] and "phone" in out[911]


def test_companions_of_values_domains_and_numbers_are_struck(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    some = lambda: " ".join(rng.sample(words, 12))
    texts = {i: some() for i in range(2500)}
    texts |= {5000 + i: f"{some()} quagga {some()} mail solo@a.org" for i in range(3)}
    texts |= {5100 + i: f"王小 {some()} user{i}@clinic.org {some()}" for i in range(12)}
    texts |= {5200 + i: f"{some()} AB12 call +1 555 010 99{i:02d} {some()}" for i in range(12)}
    found = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, [(i, t, "en", "a") for i, t in texts.items()])).where("terms is not null").collect()}
    struck = {i: {texts[i][t["start"] : t["end"]]: a for t, a in zip(r["terms"], r["actions"], strict=True)} for i, r in found.items()}
    assert all(struck[5000 + i] == {"quagga": "generalise", "mail": "generalise"} for i in range(3))
    assert all(struck[5100 + i] == {"王小": "remove"} for i in range(12))
    assert all(struck[5200 + i] == {"AB12": "remove", "call": "remove"} for i in range(12))
    assert len(struck) == 27


def plain_disclosure(rows, rule):
    """doc_id -> {term: action}, by counting every entity and term of every row."""
    held = {i: ({e for x in plain_spans(t or "") for e in pii.entities(t or "", *x)}, pii.terms(t or "")) for i, t in rows}
    n, c, d, b = len(rows), Counter(), Counter(), Counter()
    for ids, words in held.values():
        c.update(ids)
        d.update(words)
        b.update((e, t) for e in ids for t in words)
    of = defaultdict(list)
    for e, t in b:
        of[e].append(t)
    weight = {t: math.log(n / d[t]) + 1e-9 for t in d}
    copies = {e: sum(b[e, t] * weight[t] for t in words) / sum(weight[t] for t in words) for e, words in of.items()}
    out = defaultdict(dict)
    for i, (ids, words) in held.items():
        for e in ids:
            for t in words if 1 < c[e] <= n * rule.known else ():
                share = math.log2((b[e, t] * n / c[e] + rule.support) / (d[t] + rule.support)) / math.log2(n / c[e])
                cells = ((b[e, t], c[e] * d[t]), (c[e] - b[e, t], c[e] * (n - d[t])), (d[t] - b[e, t], (n - c[e]) * d[t]), (n - c[e] - d[t] + b[e, t], (n - c[e]) * (n - d[t])))
                g = 2 * sum(x * math.log(x * n / y) for x, y in cells if x)
                if share >= rule.generalise and b[e, t] / copies[e] >= rule.texts and g / copies[e] >= 2 * math.log(len(of[e]) / rule.chance):
                    out[i][t] = max(out[i].get(t, ""), "remove" if share >= rule.remove else "generalise")
    return out


def test_disclosure_against_all_pairs(spark, corpus):
    rng = random.Random(8)
    made = [(20_000 + i, " ".join([*(f"n{rng.randrange(60)}" for _ in range(12)), *rng.sample(["a@b.org", "c@d.org", "+1 555 010 9999", "10.0.0.1"], rng.randrange(4))])) for i in range(300)]
    rows = [r[:2] for r in corpus] + made + [(30_000 + i, "leopard seen by pat@y.org") for i in range(150)]
    rows += [(40_000 + i, f"jaguar seen by {'kim@x.org' if i % 9 else 'a@b.org'} {' '.join(f'n{rng.randrange(60)}' for _ in range(9))} ocelot{i // 4} m{i // 4}@z{i // 8}.org lynx{i // 30} p{i}@h{i // 30}.org") for i in range(150)]
    wanted = plain_disclosure(rows, pii.Rule())
    found = pii.find_personal_data(documents(spark, rows)).where("terms is not null").collect()
    text = dict(rows)
    assert {r["doc_id"]: {text[r["doc_id"]][t["start"] : t["end"]].lower(): a for t, a in zip(r["terms"], r["actions"])} for r in found} == wanted
    assert len(wanted) > 100 and {a for x in wanted.values() for a in x.values()} == {"generalise", "remove"}
    assert not any(30_000 <= i < 40_000 for i in wanted)


def test_blanking_is_linear():
    text = "x a@b.org " * 60_000
    assert len(pii.base_spans(text)) == 60_000 and pii.terms(text) == {"x"}


# -- 5 ---------------------------------------------------------------------------------------------------------------


def test_exact_groups(spark, corpus):
    rows = odd(corpus)
    found = exact_dedup.exact_groups(documents(spark, rows).repartition(7)).collect()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[SPACE.sub(" ", text or "")].append(i)
    wanted = Counter()
    for i, text, *_ in rows:
        norm = SPACE.sub(" ", text or "")
        keep = min(x for x in groups[norm] if x is not None)
        wanted[(i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in found) == wanted
    docs = documents(spark, rows)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(min(x for x in g if x is not None) for g in groups.values())
    assert exact_dedup.exact_groups(docs.where("false")).count() == exact_dedup.keep_first(docs.where("false")).count() == 0


def test_tree_merge_exchanges_every_digest(spark):
    rows = spark.range(0, 5000, 1, 13).select(F.col("id").alias("doc_id"), F.unhex(F.sha2((F.col("id") % 700).cast("string").cast("binary"), 256)).alias("digest"), F.lit(1).cast("long").alias("check"))
    for radix, rounds in ((2, 3), (8, 2), (3, 1), (4, None)):
        merged = exact_dedup.tree_merge(rows, radix, rounds)
        assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == (rounds or 1)  # one exchange a round
        found = merged.collect()
        assert sorted(r["keep_id"] for r in found) == list(range(700)) and sum(r["group_size"] for r in found) == 5000


def test_hot_groups_join_alike(spark, monkeypatch):
    docs = documents(spark, [(i, f"text {'hot' if i % 3 == 0 else i % 40}") for i in range(600)])
    before = Counter(map(tuple, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "join_by_key", partial(exact_dedup.join_by_key, most=4))
    assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == before


# -- 6 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    rows = [(*r, ) for r in odd(corpus)] + [(9100, "Don't!! ４２ ½ Σας <|endoftext|>x a.  B\u3000c", "en", "a")]
    docs = documents(spark, rows)
    found = [r.asDict() for r in packing.pack_documents(docs, group_rows=100).collect()]
    tokenizer, wanted = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted[(i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r["length"] for r in found) / 4096) * 1.05 + 1
    assert packing.pack_documents(docs.where("false")).count() == 0
    one = documents(spark, corpus[:5])
    whole = packing.sequences(one, packing.pack_documents(one)).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in corpus[:5])


def test_best_fit_is_the_plain_one():
    rng = np.random.default_rng(4)
    for size, n in ((10, 50), (64, 300), (4096, 200)):
        lengths = rng.integers(1, size + 1, n)
        bins, offsets = packing.best_fit_decreasing(lengths, size)
        left, plain = [], 0
        for need in sorted(lengths.tolist(), reverse=True):
            fit = [x for x in left if x >= need]
            if fit:
                left.remove(min(fit))
                left.append(min(fit) - need)
            else:
                plain += 1
                left.append(size - need)
        assert len(set(bins.tolist())) == plain


# -- 7 ---------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, corpus):
    known = [r for r in corpus if r[2]]
    train, rest = known[::2], known[1::2]
    rows = langid.document_rows(documents(spark, [(i, t, None, None) for i, t, *_ in rest]))
    found = {r["doc_id"]: r for r in langid.identify(rows, langid.labelled_rows(documents(spark, train))).collect()}
    assert np.mean([found[i]["language"] == lang for i, _, lang, _ in rest]) >= 0.98
    assert np.mean([found[i]["accepted"] for i, *_ in rest]) >= 0.98


def test_language_evidence(spark, corpus):
    train = langid.labelled_rows(documents(spark, corpus))
    pages = [(1, "https://x.example.fr/", '<html lang="fr"><script>the and of</script><p>le les des que la</p>'), (2, None, None), (3, "nonsense", ""), (4, "https://x.example.fr/", "<p>--- 123</p>"), (4, "https://x.example.fr/", "<p>--- 123</p>"), (5, "https://y.de/", "<html lang=fr>" + "x" * 200_000)]
    rows = langid.page_rows(spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id long, url string, html string, language string, host string"))
    docs = langid.document_rows(documents(spark, [*corpus, (9001, None, None, None), (9002, "zq" * 400 + " xjq" * 400, None, None)]))
    found = langid.identify(docs.unionByName(rows), train).collect()
    by_page = {r["page_id"]: r for r in found if r["page_id"]}
    assert len(found) == len(corpus) + 2 + len(pages)
    assert by_page[1]["language"] == "fr" and by_page[1]["accepted"]
    assert not any(by_page[i]["accepted"] for i in (2, 3, 4))
    by_doc = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert not by_doc[9001]["accepted"] and not by_doc[9002]["accepted"]
    assert langid.identify(docs.where("false"), train).count() == langid.identify(docs, train.where("false")).where("accepted").count() == 0


def test_visible_text():
    assert "".join(langid.visible("a<p>b</p><script>c<i></script >d<!-- e > -->f<style x>g").split()) == "abdfg"
    for html in ("<script " * 40_000, "<!--" * 40_000, "<style>" * 40_000, "</script " * 40_000):
        langid.visible(html)  # no time to speak of


def test_language_with_odd_rows(spark, corpus):
    """A null text with a language, tags of regions, a declaration far behind, carried columns with the operator's names."""
    rows = [*corpus, (9001, None, "en", "a"), (9002, "", "en", "a"), (9003, "x " * 5000 + '<html lang="fr-CA">', None, None)]
    docs = documents(spark, rows)
    assert {r["label"] for r in langid.labelled_rows(documents(spark, [(1, "a", "en-US", "x"), (2, "a", "pt_BR", "x"), (3, "a", "", "x")])).collect()} == {"en", "pt", None}
    evidence = langid.document_rows(docs)
    assert evidence.where("doc_id = 9003").first()["declared"] == "fr"
    clash = evidence.withColumns({c: F.lit(c) for c in ("n", "scores", "host_prior", "rows", "kept", "_", "language")})
    found = langid.identify(clash, langid.labelled_rows(docs))
    assert found.where("n = 'n' and host_prior = 'host_prior' and kept = 'kept'").count() == len(rows)
    assert found.where("doc_id in (9001, 9002) and not accepted").count() == 2


def test_hot_hosts_alike(spark, corpus, monkeypatch):
    docs = documents(spark, [(i, t, lang, f"h{i % 7 * (i % 3)}") for i, t, lang, _ in corpus] + [(9100, "the and", None, None)])
    before = langid.identify(langid.document_rows(docs), langid.labelled_rows(docs)).collect()
    monkeypatch.setattr(langid, "join_by_key", partial(langid.join_by_key, most=3))
    after = langid.identify(langid.document_rows(docs), langid.labelled_rows(docs)).collect()
    key = lambda rows: sorted((r["doc_id"], r["language"], round(r["posterior"], 9), r["accepted"]) for r in rows)
    assert key(before) == key(after)


def test_host_prior_decides_without_letters_of_its_own(spark):
    words = {"fr": "le les des que", "en": "the and of to"}
    train = spark.createDataFrame([(i, w, k) for k, w in words.items() for i in range(10)], "key int, text string, label string")
    rows = [(i, words["fr"], "a.b.fr") for i in range(30)] + [(i, words["en"], "c.d.com") for i in range(30, 60)] + [(99, "zz", "a.b.fr"), (98, "zz", "c.d.com")]
    df = spark.createDataFrame(rows, "k int, text string, host string").withColumns({"markup": F.lit(False), "declared": F.lit(None).cast("string"), "suffix": F.lit(None).cast("string")})
    found = {r["k"]: r["language"] for r in langid.identify(df, train).collect()}
    assert found[99] == "fr" and found[98] == "en"


# -- 8 ---------------------------------------------------------------------------------------------------------------


def plain_components(rows, size, share):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = ({tuple(words)} if 0 < len(words) < size else set(zip(*[words[k:] for k in range(size)], strict=False)))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(rng, count, words, edits):
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"w{rng.randrange(3000)}"
        yield " ".join(copy)


@pytest.mark.parametrize(("size", "share"), [(3, 90), (5, 80)])
def test_ngram_components(spark, corpus, size, share):
    rng = random.Random(size)
    texts = [t for words in (3, 8, 20, 40, 120, 700) for _ in range(3) for t in near_copies(rng, 12, words, max(1, words // 15))]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (2, 3, 5, 30, 60, 90) for _ in range(6)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, t) for i, (_, t, *_) in enumerate(corpus)] + [(9001, None), (9002, ""), (9003, " \t "), (9004, "One"), (9005, "one"), (9006, "a B"), (9007, "a  b")]
    wanted = plain_components(rows, size, share)
    found = ngram_join.link_components(documents(spark, rows + rows[:3]), size, share).collect()
    assert len(found) == len(rows) + 3
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted
    assert len({c for _, c in wanted.values()}) < len(rows) - 50


def test_ngram_components_with_hot_lists(spark, monkeypatch):
    """The same when every common element is hot, blocks and parts are small, and hot keys are joined apart."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for words in (8, 40, 150) for _ in range(3) for t in near_copies(rng, 25, words, max(1, words // 20))]
    texts += [passage + " " + " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (2, 3, 4, 6, 9) for _ in range(12)]
    rows = list(enumerate(texts))

    def hot(sets, rows_):
        return np.array(sorted(r["element"] for r in ngram_join.postings(sets, np.empty(0, "i8")).groupBy("element").count().where("count > 5").collect()), "i8")

    monkeypatch.setattr(ngram_join, "hot_elements", hot)
    monkeypatch.setattr(ngram_join, "join_by_key", partial(ngram_join.join_by_key, most=5))
    monkeypatch.setattr(ngram_join, "across", partial(ngram_join.across, part_rows=4))
    monkeypatch.setattr(ngram_join, "linked", partial(ngram_join.linked, chunk=4, block=500))
    found = ngram_join.link_components(documents(spark, rows), 3, 90).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == plain_components(rows, 3, 90)


def test_ngram_components_edges(spark):
    twice = documents(spark, [(1, "a b c d"), (2, "x y z w"), (3, "a b c d"), (3, "x y z w"), (None, "a b c d"), (4, "q")])
    found = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.link_components(twice).collect())
    assert found == Counter({(1, 1): 1, (2, 1): 1, (3, 1): 2, (None, None): 1, (4, 4): 1})
    assert ngram_join.link_components(twice.where("false")).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(5)
    for share in (50, 80, 90):
        for _ in range(60):
            query = np.unique(rng.integers(0, 60, 40)).astype("u8")
            sets = [np.unique(np.concatenate([rng.choice(query, rng.integers(1, len(query) + 1), replace=False), rng.integers(0, 80, rng.integers(0, 6)).astype("u8")])) for _ in range(30)]
            plain = [i for i, s in enumerate(sets) if 100 * (o := len(np.intersect1d(query, s))) >= share * (len(query) + len(s) - o)]
            assert sorted(ngram_join.divide_skip(ngram_join.InvertedLists(sets), query, share)) == plain
    assert ngram_join.divide_skip(ngram_join.InvertedLists([]), np.arange(5, dtype="u8"), 90) == []


def test_list_stream_across_batches(spark):
    rows = [(e, d) for e, n in ((1, 1), (2, 7), (3, 1), (4, 2), (-5, 3), (6, 30), (9, 5)) for d in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = ngram_join.shared_elements(spark.createDataFrame([(e, d, 1 + d % 2 if e == 9 else 0) for e, d in rows], "element long, doc_id long, part int").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((r["element"], r["length"]) for r in found) == Counter({(2, 7): 7, (4, 2): 2, (-5, 3): 3, (6, 30): 30, (9, ngram_join.LONG_LIST): 5})


# -- 9 ---------------------------------------------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 4
    x = centres[rng.integers(0, 12, 2500)] + rng.normal(size=(2500, 16)) * 0.3
    x[500:900] = x[3]  # many copies of one vector
    rows = [(i, [float(c) for c in v.astype("f4")]) for i, v in enumerate(x)]
    rows += [(100_000, None), (100_100, [0.0] * 16), (100_200, [None] * 16), (100_300, [math.nan] * 16), (100_400, [math.inf] * 16), (100_500, [1.0] * 3), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score int")
    found = defaultdict(list)
    for r in ann.nearest_neighbours(df, shard_rows=600).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    data = np.array([v for _, v in rows[:2500]])
    hits = 0
    for q in range(0, 2500, 100):
        far = np.sqrt(((data - data[q]) ** 2).sum(1))
        best = sorted((f, i) for i, f in enumerate(far) if i != q)[:10]
        assert [r for r, *_ in found[q]] == list(range(1, 11))
        assert all(s == pytest.approx(far[v], abs=1e-12) for _, v, s in found[q])
        hits += len({i for _, i in best} & {v for _, v, _ in found[q]})
    assert set(found) == set(range(0, 2500, 100))
    assert hits >= 0.97 * 250
    assert [ann.shards_for(n, 100, 8) for n in (0, 1, 100, 101, 800, 10**9)] == [1, 1, 1, 2, 8, 8]
    twice = df.where("vec_id < 50").unionByName(df.where("vec_id = 0").withColumn("embedding", F.transform("embedding", lambda x: (x - F.lit(100)).cast("float"))))
    far = np.sqrt(((data[:50] - (data[0].astype("f4") - np.float32(100)).astype("f8")) ** 2).sum(1))
    best = sorted((f, i) for i, f in enumerate(far) if i)[:10]
    assert [r["vec_id"] for r in sorted(ann.nearest_neighbours(twice).collect(), key=lambda r: r["rank"])] == [i for _, i in best]  # the smaller of its vectors counts
    few = ann.nearest_neighbours(df.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2
    assert ann.nearest_neighbours(df.where("false")).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark, data):
    urls = [r[0] for r in spark.read.parquet(f"{data}/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "x://", "https://WWW.Example.COM/en/a", "https://a.example.com/en/", "https://example.com/en", "https://com", "https://com/", "https://xcom/", "http://a.net/es/1", "http://net/fr/", "http://net/fr", "a://b://c.com/", "https://É.com/x?y#z", "https://a.com#/x", "https://a.com\n/x", "https://a.org/" + "x/" * 3000]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)] + [(0, urls[0], "h", "t")], "page_id long, url string, host string, template string")
    labels = spark.read.parquet(f"{data}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int"))
    found = url_filter.judge_urls(pages, labels).collect()
    assert len(found) == len(urls) + 1
    for r in found:
        host, path, rule, verdict = plain_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(pages.where("false"), labels).count() == 0
    assert url_filter.judge_urls(pages, labels.where("false")).where("rule is null and verdict = 'block'").count() == 0


SHAPE = re.compile(r"(?:[0-9][0-9_.-]*|(?=.*[0-9])[0-9A-Fa-f-]{8,}|(?=.*[0-9])[A-Za-z0-9_%-]{16,})\Z")
ENDING = re.compile(r"\.[A-Za-z][A-Za-z0-9]{0,4}\Z")


def plain_tree(pages, good, support, share, strength, difference):
    """(host, branch) -> (template, purity), by the definitions, one node at a time. pages: id -> (host, path)."""
    ending = lambda x: m[0] if (m := ENDING.search(x)) else ""
    branches = defaultdict(lambda: [0, 0, 0])
    key = {}
    for i, (host, path) in pages.items():
        segments = [x for x in path.split("/") if x]
        key[i] = (host, tuple(f"*{ending(x)}" if SHAPE.match(x[: len(x) - len(ending(x))]) else x for x in segments))
        at = branches[key[i]]
        at[0] += 1
        if i in good:
            at[1] += 1
            at[2] += good[i]
    template = {b: () for b in branches}
    opened, level, deepest = {b for b in branches if b[1]}, 0, 0
    while opened:
        level += 1
        deepest = level
        nodes = defaultdict(Counter)
        for b in opened:
            nodes[b[0], template[b]][b[1][level - 1]] += branches[b][0]
        still = set()
        for b in opened:
            node, x = nodes[b[0], template[b]], b[1][level - 1]
            n = sum(node.values())
            if n < support:
                template[b] += ("**",)
                continue
            template[b] += (x if node[x] >= support and node[x] >= share * n else f"*{ending(x)}",)
            if len(b[1]) > level:
                still.add(b)
        opened = still
    for level in range(deepest, 0, -1):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for b, t in template.items():
            if len(t) == level:
                x = nodes[b[0], t[:-1]][t]
                x[0] += branches[b][1]
                x[1] += branches[b][2]
        renamed = {}
        for (host, parent), children in nodes.items():
            order = sorted(children.items(), key=lambda c: (c[1][0] == 0, c[1][1] / c[1][0] if c[1][0] else 0, c[0]))
            runs = []
            for t, (m, g) in order:
                if runs:
                    m0, g0 = runs[-1][-1][1]
                    if m and m0:
                        p = (g + g0) / (m + m0)
                        apart = abs(g / m - g0 / m0) > difference * math.sqrt(p * (1 - p) * (1 / m + 1 / m0))
                    else:
                        apart = bool(m0) and not m
                if not runs or apart:
                    runs.append([])
                runs[-1].append((t, (m, g)))
            for number, run in enumerate(runs, 1):
                known = [(m, g) for _, (m, g) in run if m]
                m, g = sum(x for x, _ in known), sum(x for _, x in known)
                mixed = len(known) > 1 and 0 < g < m and (sum(y * y / x for x, y in known) - g * g / m) / (g / m * (1 - g / m)) > len(known) - 1 + difference * math.sqrt(2 * (len(known) - 1))
                if len(run) > 1 and not mixed:
                    renamed |= {(host, t): (*parent, "*" if len(runs) == 1 else f"*~{number}") for t, _ in run}
        template = {b: renamed.get((b[0], t), t) if len(t) == level else t for b, t in template.items()}
    m, g = sum(x[1] for x in branches.values()), sum(x[2] for x in branches.values())
    base = (g + 1) / (m + 2)
    hosts, leaves = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for b, (_, m, g) in branches.items():
        for x in (hosts[b[0]], leaves[b[0], template[b]]):
            x[0] += m
            x[1] += g
    out = {}
    for i, b in key.items():
        (hm, hg), (m, g) = hosts[b[0]], leaves[b[0], template[b]]
        out[i] = ("/" + "/".join(template[b]), (g + strength * (hg + strength * base) / (hm + strength)) / (m + strength))
    return out


def test_url_tree_against_a_plain_one(spark):
    rng = random.Random(9)
    words = ["shop", "spam", "blog", "news", "a.html", "b.php"]
    pages, labels = [], []
    for i in range(3000):
        host = rng.choice(["a.org"] * 6 + ["b.org", "c.org", f"h{i % 40}.org"])
        parts = [rng.choice(words[: 2 + d * 2]) if rng.random() < 0.8 else f"x{rng.randrange(200)}" for d in range(rng.randrange(4))] + ([str(i)] if i % 3 else []) + ([f"f{rng.randrange(50)}.html"] if i % 7 == 0 else [])
        pages.append((i, f"https://{host}/" + "/".join(parts)))
        if rng.random() < 0.5:
            labels.append((i, int(rng.random() < (0.1 if "spam" in parts else 0.5 if "blog" in parts else 0.9)), int(rng.random() < 0.02)))
    rows = spark.createDataFrame(pages, "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.judge_urls(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).collect()}
    places = {i: plain_rule(u)[:2] for i, u in pages}
    wanted = plain_tree(places, {i: int(q == 1 and t == 0) for i, q, t in labels}, 20, 0.001, 2.0, 1.96)
    for i, (template, purity) in wanted.items():
        assert found[i]["template"] == template
        assert found[i]["purity"] == pytest.approx(purity)
        assert found[i]["verdict"] == ("block" if purity < 0.5 else "allow")
    assert len({r["template"] for r in found.values()}) > 10 and any("*~" in r["template"] for r in found.values())
    assert {r["verdict"] for r in found.values()} == {"block", "allow"}


def test_url_templates_learn(spark):
    rows = [(i, f"https://a.org/shop/{i}", 1) for i in range(60)] + [(100 + i, f"https://a.org/spam/{i}", 0) for i in range(60)] + [(200 + i, f"https://b.org/user/name{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", 1) for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, labels, []).collect()}
    assert {found[i]["verdict"] for i in range(60)} == {"allow"} and {found[100 + i]["verdict"] for i in range(60)} == {"block"}
    assert found[101]["template"] == "/spam/*"
    assert {found[200 + i]["template"] for i in range(60)} == {"/user/*"}
