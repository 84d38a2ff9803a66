"""Manifest trees, chat formatting and whitening against plain-Python models and numpy."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kondate.llm import chat, merkle, whitening
from kondate.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tie string, tree string"


def joined(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf(doc, text):
    values = (doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text)
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        run = range(i - i % 8, min(len(level), i - i % 8 + 8))
        out.append((i % 8, [level[j] for j in run if j != i]))
        i //= 8
    return out


def audited(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d["lang"], []).append(d)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    ordered = {k: sorted(groups[k], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"]))) for k in keys}
    trees = {k: tree([leaf(d, d["text"]) for d in ordered[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, d in enumerate(ordered[k]):
            path, text = steps(trees[k], i) + steps(top, j), d["text"]
            if text is not None and d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(d, text)
            for place, others in path:
                node = joined([*others[:place], node, *others[place:]])
            out.append((d["doc_id"], leaf(d, d["text"]), trees[k][-1][0], top[-1][0], joined([x for _, o in path for x in o]), node, node == top[-1][0]))
    return out


def odd_documents(n):
    rng = random.Random(n)
    texts = [None, "", "ÄÖ Text", "no capitals", "Capital Letters " * 3, "x" * 50_000, "\u0000␛"]
    rows = [(rng.choice([i, i, i, i % 5, None]) if i % 7 == 0 else i, rng.choice(texts), rng.choice(["en"] * 6 + [None, "", "-", "=x", "é"]), rng.choice([None, "", "a"]), rng.choice([None, 0, -3, i]), "t", "u") for i in range(n)]
    return rows + rows[: n // 9]


@pytest.mark.parametrize("n", [0, 9, 700])
def test_audit_is_that_of_whole_trees(spark, n):
    docs = spark.createDataFrame(odd_documents(n), DOCS).repartition(3)
    found = [tuple(r) for r in merkle.audit_documents(docs).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(audited([r.asDict() for r in docs.collect()]), key=key)


def test_audit_of_deep_trees_and_many_languages(spark):
    docs = spark.range(0, 5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.when(F.col("id") < 4000, "en").otherwise(F.concat(F.lit("l"), F.col("id") % 600)).alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    found = sorted(tuple(r) for r in merkle.audit_documents(docs).collect())
    assert found == sorted(audited([r.asDict() for r in docs.collect()]))
    assert {x[-1] for x in found} == {True, False}


def test_proofs_fold_to_the_root_and_only_some_levels_are_stored(spark):
    docs = spark.range(0, 1200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    scratch = Scratch(spark, "test-merkle")
    manifest = merkle.build_manifest(merkle.leaf_rows(docs), scratch)
    assert [s.select(F.sum(F.size("nodes"))).first()[0] for s in manifest.strata] == [1200, 3]  # levels 0 and 3 of 0 to 4
    for r in merkle.extract_proofs(manifest, scratch).where("doc_id % 111 = 0 or doc_id = 1199").collect():
        path = [(x["place"], [bytes(o) for o in x["others"]]) for x in r["proof"]]
        assert merkle.fold(bytes(r["leaf"]), path) == manifest.root
        assert merkle.fold(b"x" * 32, path) != manifest.root


# -- chat ----------------------------------------------------------------------------------------------------------


def test_marks_in_texts_come_back():
    codec, rng = chat.Codec(chat.Template()), random.Random(3)
    bits = [*chat.Template().controls(), "<", "|", ">", "[", chat.ESCAPE, "/s>", "SYS>>", "INST]", "a", "\n", "😀"]
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "<|says|>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(3)]
        written = [codec.write(role, [("text", text)]) for role, text in turns]
        assert list(codec.read("".join(f for f, _, _ in written))) == turns
        for (role, text), (formatted, spans, _) in zip(turns, written, strict=True):
            assert "".join(codec.unescape(formatted[a:b]) for a, b in spans) == (text if role == "assistant" else "")


def test_templates_whose_marks_overlap_are_refused():
    with pytest.raises(ValueError):
        chat.Codec(chat.Template(marks={"user": ("<<", "<")}))


def test_digests_of_odd_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 5, "assistant", None), (None, 0, "tool", "</s>"), (3, 0, "assistant", "x" * 100_000 + "[INST]"), (-7, 9, "user", "more")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"t{i} <s>") for i in range(3000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    said = "</s>[INST] ok [/INST]"
    groups = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    wanted = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        wanted[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.format_digests(df).collect()}
    assert found == wanted
    assert [r["conv_id"] for r in chat.format_digests(df.limit(0)).collect()] == [-7]


def test_typed_parts(spark):
    parts = [
        {"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, "and",
        {"type": "document", "ref": "d.pdf", "pages": 3}, {"type": "document", "ref": "e", "pages": 9, "parts": [{"type": "audio", "ref": "x.wav", "seconds": 2.1}, {"type": "text", "text": "in"}]},
        {"type": "video", "ref": "v"}, {"type": "image"}, {"type": "text", "text": None}, 7,
    ]
    deep = {"type": "text", "text": "deep"}
    for _ in range(300):
        deep = {"type": "document", "parts": [deep]}
    rows = [(1, 0, "assistant", "unused", json.dumps(parts)), (1, 1, "user", "plain", None), (2, 0, "user", None, "{broken"), (2, 1, "user", None, '{"a": 1}'), (3, 0, "user", None, json.dumps([deep]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    turns = chat.format_turns(df)
    found = {(r["conv_id"], r["turn"]): r for r in turns.collect()}
    first = found[1, 0]
    assert first["formatted"] == "<s>see <␛|image|> <|image|>and<|document|><|/document|><|document|><|audio|>in<|/document|><|other|><|image|><|other|></s>"
    assert [(x["kind"], x["ref"], x["tokens"]) for x in first["attachments"]] == [("image", "a.png", 3), ("document", "d.pdf", 768), ("document", "e", 0), ("audio", "x.wav", 27), ("other", "v", 0), ("image", None, 1024), ("other", None, 0)]
    assert all(first["formatted"][x["at"] :].startswith(f"<|{x['kind']}|>") for x in first["attachments"])
    assert first["tokens"] == 3 + 768 + 27 + 1024
    assert [first["formatted"][s["start"] : s["end"]] for s in first["loss"]] == ["see <␛|image|> ", "and", "in"]
    assert [found[2, i]["problem"] for i in (0, 1)] == ["no JSON", "no list"] and found[2, 0]["formatted"] == "[INST]{broken[/INST]"
    assert len(found[3, 0]["attachments"]) == 300 and "deep" in found[3, 0]["formatted"]
    whole = {r["conv_id"]: r for r in chat.formatted_conversations(turns).collect()}
    assert whole[1]["formatted"] == first["formatted"] + "[INST]plain[/INST]" and whole[1]["tokens"] == first["tokens"]
    moved = spark.createDataFrame([(1, i, "assistant", f"t{i}") for i in range(3)], "conv_id long, turn long, role string, text string")
    row = chat.formatted_conversations(chat.format_turns(moved)).first()
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss"]] == ["t0", "t1", "t2"]


# -- whitening -----------------------------------------------------------------------------------------------------


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "e") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, x string").repartition(3)


def compare(spark, vectors, k):
    found = whitening.whiten_embeddings(embeddings(spark, vectors)).toPandas()
    x = np.floor(1024 * np.array(vectors, "f8")).astype("i8") + 100_000
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    assert sorted(set(found.component)) == list(range(1, k + 1)) and len(found) == n * k
    table = found.sort_values(["component", "vec_id"])
    assert table[table.component == 1].deviation.tolist() == [int(s) for s in ((n * x - sums) ** 2).sum(1)]
    for i in range(k):
        mine, theirs = table[table.component == i + 1].whitened.to_numpy(), c @ v[:, i] / np.sqrt(e[i])
        assert abs(abs(mine @ theirs) / n - 1) < 1e-9
        assert np.abs(mine * np.sign(mine @ theirs) - theirs).max() < 1e-7
        assert abs(table[table.component == i + 1].explained.iloc[0] / (e[i] / e.sum()) - 1) < 1e-9
    assert found.identity_error.max() < 1e-9
    return found


def test_whitening_is_that_of_eigenvectors(spark):
    rng = np.random.default_rng(5)
    compare(spark, (rng.standard_normal((200, 12)) * (0.8 ** np.arange(12))).tolist(), 8)
    compare(spark, (rng.standard_normal((60, 30)) * (0.5 ** np.arange(30)) * 3).tolist(), 8)
    compare(spark, rng.standard_normal((50, 3)).tolist(), 3)


def test_repeated_eigenvalues_are_all_found(spark):
    found = whitening.whiten_embeddings(embeddings(spark, np.concatenate([np.eye(10), -np.eye(10)]).tolist())).toPandas()
    assert sorted(set(found.component)) == list(range(1, 9)) and found.identity_error.max() < 1e-9
    assert np.allclose(found.explained, 0.1)


def test_rows_that_take_no_part(spark):
    bad = [None, [1.0, None], [float("nan"), 0.0], [float("inf"), 0.0], [1e300, 0.0], [1.0], []]
    found = whitening.whiten_embeddings(embeddings(spark, [[0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.5, 0.25], *bad])).toPandas()
    assert set(found.vec_id) == {0, 1, 2, 3} and set(found.n) == {4}
    for few in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None]):
        assert not whitening.whiten_embeddings(embeddings(spark, few)).count()
    line = whitening.whiten_embeddings(embeddings(spark, [[i, 2 * i] for i in range(9)])).toPandas()
    assert set(line.component) == {1} and abs(line.explained.iloc[0] - 1) < 1e-9


def test_deviations_beyond_longs_are_null(spark):
    found = whitening.whiten_embeddings(embeddings(spark, [[2.0**40, 0.0], [0.0, 1.0], [1.0, 0.0]])).toPandas()
    assert found.deviation.isna().any() and found.identity_error.max() < 1e-4


# -- language, for any number of labels ----------------------------------------------------------------------------


def plain_fusion(rows, train, names):
    """(language, posterior) of each row (text, declared, host, suffix), in plain numpy."""
    from collections import Counter, defaultdict

    from kondate.llm import langid

    grams = lambda text: Counter(g for g in langid.trigrams(langid.letters(text)).tolist() if g != blank)
    blank = int(langid.trigrams(np.array([32, 32, 32], "u1"))[0])
    counts, totals = defaultdict(Counter), Counter()
    for text, label in train:
        for g in langid.trigrams(langid.letters(text)).tolist():
            counts[label][g] += 1
            totals[label] += 1
    table = lambda name, g: np.log((counts[name][g] + 0.5) / (totals[name] + 0.5 * langid.BINS))
    soft = lambda x: (lambda e: e / e.sum())(np.exp(x - x.max()))
    tempered = []
    for text, *_ in rows:
        n = max(0, len(langid.letters(text or "")) - 4)
        score = np.array([sum(k * table(name, g) for g, k in grams(text or "").items()) for name in names])
        tempered.append(score * min(1.0, 60.0 / max(n, 1)))
    shares = [np.where(soft(t) >= 1e-6, soft(t), 0.0) for t in tempered]
    sums = lambda key: {k: sum(s for s, r in zip(shares, rows, strict=True) if key(r) == k) for k in {key(r) for r in rows} if k is not None}
    domain = lambda r: ".".join(r[2].split(".")[-2:]) if r[2] else None
    whole = sum(shares) + 1.0
    base = whole / whole.sum()
    hosts, domains, declared, suffix = sums(lambda r: r[2]), sums(domain), sums(lambda r: r[1]), sums(lambda r: r[3])
    smooth = lambda c, p: (c + 20 * p) / (c.sum() + 20)
    out = []
    for r, t in zip(rows, tempered, strict=True):
        prior = base if domain(r) is None else smooth(domains[domain(r)], base)
        prior = base if r[2] is None else smooth(hosts[r[2]], prior)
        logs = t + np.log(prior)
        logs = logs if r[1] is None else logs + np.log((declared[r[1]] + 0.5) / (whole + 1.0))
        logs = logs if r[3] is None else logs + 0.5 * np.log((suffix[r[3]] + 0.5) / (whole + 1.0))
        p = soft(logs)
        out.append((names[int(p.argmax())], p.max()))
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_fusion_is_that_of_plain_sums(spark, monkeypatch, block):
    from functools import partial

    from kondate.llm import langid

    monkeypatch.setattr(langid, "train", partial(langid.train, block=block))
    rng = random.Random(9)
    names = [f"l{i}" for i in range(7)]
    words = {x: ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 5))) for _ in range(12)] for x in names}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    train = [(say(x, 8), x) for x in names for _ in range(6)]
    rows = []
    for _ in range(120):
        x = rng.choice(names)
        rows.append((rng.choice([say(x, rng.randint(1, 20)), say(x, 2), None, ""]), rng.choice([x, None, "zz"]), rng.choice([f"{x}.a.org", f"b.{x}.org", f"{x}", "", None, "hot.com"]), rng.choice([x, None])))
    df = spark.createDataFrame([(i, *r[:1], False, *r[1:]) for i, r in enumerate(rows)], "k int, text string, markup boolean, declared string, host string, suffix string").repartition(3)
    found = sorted(tuple(r)[:3] for r in langid.identify(df, spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "key int, text string, label string")).collect())
    for (i, language, posterior), (name, p) in zip(found, plain_fusion(rows, train, names), strict=True):
        assert abs(posterior - p) < 1e-9 and (language == name or p < 0.5), (i, rows[i])


def test_a_thousand_labels(spark):
    from kondate.llm import langid

    rng = random.Random(10)
    words = {f"l{i:04d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(5)] for i in range(1000)}
    train = [(i, " ".join(words[x]), x) for i, x in enumerate(words) for _ in range(5)]
    rows = [(i, " ".join(words[x]), False, None, f"h{i % 3}.org", None) for i, x in enumerate(list(words)[::10])]
    df = spark.createDataFrame(rows, "k int, text string, markup boolean, declared string, host string, suffix string")
    found = {r["k"]: r["language"] for r in langid.identify(df, spark.createDataFrame(train, "key int, text string, label string")).collect()}
    assert found == {i: x for i, x in enumerate(list(words)[::10])}
