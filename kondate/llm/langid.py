"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, join_by_key, worker_memory
from kondate.llm.url_filter import host_of

BINS = 1 << 16
_MULTIPLIER = np.uint32(2654435761)
#: Bytes that are letters: ASCII letters and all of UTF-8 beyond ASCII; the rest count as space.
_LETTERS = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], "u1")
#: What opens or is markup; a hidden part lasts to its end mark, if there is one.
_MARKUP = re.compile(r"<!--|<(script|style|noscript)\b|<[^<>]*>", re.I)
_TAG = re.compile("<[^<>]*>")
_ENDS = {name: re.compile(end, re.I) for name, end in (("", "-->"), *((x, rf"</{x}\s*>") for x in ("script", "style", "noscript")))}
_SLICE = 1 << 19


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hash bins of the byte trigrams of letters-and-spaces text."""
    wide = data.astype("u4")
    return ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * _MULTIPLIER) >> np.uint32(16)


def letters(text: str) -> np.ndarray:
    """A text's bytes in lower case with everything but letters as one space, between spaces."""
    data = _LETTERS[np.frombuffer(f" {text.lower()}  ".encode("utf-8", "replace"), "u1")]
    space = data == 32
    return np.append(data[~(space & np.append(space[1:], False))], np.array([32, 32], "u1"))


def visible(html: str) -> str:
    """The text outside of tags, comments and hidden elements, in one pass: an end that is missing is looked for once."""
    out, at, endless = [], 0, set()
    while found := _MARKUP.search(html, at):
        out.append(html[at : found.start()])
        at = found.end()
        name = "" if found[0] == "<!--" else (found[1] or "").lower()
        if (found[0] == "<!--" or name) and name not in endless:
            if end := _ENDS[name].search(html, at):
                at = end.end()
                continue
            endless.add(name)
        if name and (tag := _TAG.match(html, found.start())):
            at = tag.end()
    out.append(html[at:])
    return " ".join(out)


class Likelihoods:
    """Log likelihoods of trigram bins by language, sparse: what a bin adds above that of a bin the language never had.

    bins, starts, places and weights are the entries by bin; unseen the log likelihood of a bin without one. The bin of
    spaces counts for nothing.
    """

    def __init__(self, languages: list[str], bins: np.ndarray, places: np.ndarray, counts: np.ndarray, smoothing: float):
        self.languages = languages
        order = np.argsort(bins, kind="stable")
        bins, places, counts = bins[order], places[order], counts[order]
        totals = np.bincount(places, counts, len(languages)) + smoothing * BINS
        self.unseen = np.log(smoothing / totals)
        self.weights = np.log((counts + smoothing) / smoothing)
        self.places = places.astype("i4")
        self.starts = np.searchsorted(bins, np.arange(BINS + 1))
        self.blank = int(trigrams(np.array([32, 32, 32], "u1"))[0])

    def size(self) -> int:
        """Bytes of the model."""
        return sum(x.nbytes for x in (self.unseen, self.weights, self.places, self.starts))

    def score(self, text: str) -> tuple[np.ndarray, int]:
        data = letters(text)
        n, counts = max(0, len(data) - 4), np.zeros(BINS, "i8")
        for i in range(0, len(data) - 2, _SLICE):
            counts += np.bincount(trigrams(data[i : i + _SLICE + 2]), minlength=BINS)
        counts[self.blank] = 0
        found = np.flatnonzero(counts)
        begins, sizes = self.starts[found], self.starts[found + 1] - self.starts[found]
        entries = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(found) else np.zeros(0, "i8")
        times = np.repeat(counts[found], sizes)
        return np.bincount(self.places[entries], self.weights[entries] * times, len(self.languages)) + counts[found].sum() * self.unseen, n


#: Languages of a model, which each worker holds as a whole; with more, texts are read once for each so many.
LANGUAGES = 256
#: Bytes of a model that may be broadcast.
MODEL_BYTES = 256 << 20


def train(labelled: DataFrame, scratch: Scratch, per_label: int = 2000, least: int = 5, smoothing: float = 0.5, block: int = LANGUAGES) -> list[Likelihoods]:
    """Models of at most `block` languages each, fitted on about `per_label` rows of each label (columns key, text, label), chosen by a hash of key and text.

    The bound keeps training small at any size of the corpus; a text that many keys share counts for its share of the
    sample only. What reaches the driver is the counts of a block's bins at a time. Rows without text or label teach
    nothing, and labels with fewer than `least` rows are no language. There may be as many languages as labels.
    """
    known = labelled.where("label is not null and text is not null")
    sizes = scratch.table(known.groupBy("label").agg(F.count("*").alias("rows")).where(F.col("rows") >= least), "labels")
    chosen = join_by_key(known, sizes, ["label"], "rows").where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("rows")) * (1 << 20))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("", dict)
        tables: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for label, table in tables.items():
                bins = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(bins), pa.string()), pa.array(bins.astype("i4")), pa.array(table[bins])], ["label", "bin", "n"])
            tables.clear()

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if label not in tables and len(tables) == 64:  # half a MB each
                    yield from counted()
                table = tables.setdefault(label, np.zeros(BINS, "i8"))
                table += np.bincount(trigrams(letters(text)), minlength=BINS)
        yield from counted()

    counts = scratch.table(chosen.select("text", "label").mapInArrow(tally, "label string, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")), "bins")
    languages = sorted(r["label"] for r in sizes.select("label").toLocalIterator())
    models = []
    for i in range(0, len(languages), block):
        names = languages[i : i + block]
        here = counts.where((F.col("label") >= names[0]) & (F.col("label") <= names[-1])).toPandas()
        place = {x: j for j, x in enumerate(names)}
        model = Likelihoods(names, here["bin"].to_numpy("i8"), here["label"].map(place).to_numpy("i8"), here["n"].to_numpy("f8"), smoothing)
        if model.size() > MODEL_BYTES:
            raise ValueError(f"a model of {len(names)} languages takes {model.size()} bytes; make blocks smaller")
        models.append(model)
    return models


def text_scores(rows: DataFrame, model: Likelihoods, carried: bool = False) -> DataFrame:
    """The rows with scores (log likelihoods by language, behind those they have, if carried) and n (trigrams)."""
    shared, name = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kept = [f for f in rows.schema.fields if f.name not in ("scores", "n")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_memory(f"likelihoods {name}", lambda: shared.value)
        for batch in batches:
            scores, sizes = [], []
            before = batch.column("scores").to_pylist() if carried else [[]] * batch.num_rows
            for text, markup, had in zip(batch.column("text"), batch.column("markup").to_pylist(), before, strict=True):
                text = text.as_py() or ""
                total, n = known.score(visible(text) if markup else text)
                scores.append([*had, *total] if had else total)
                sizes.append(n)
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, pa.int64())], [*(f.name for f in kept), "scores", "n"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(score, f"{out}, scores array<double>, n long")


def _given(value: Column, once: Column, then: Callable[[Column, Column], Column]) -> Column:
    """What follows from a value and something that is computed once, not for each of its elements."""
    return F.get(F.transform(F.array(F.struct(value.alias("value"), once.alias("once"))), lambda x: then(x["value"], x["once"])), 0)


def _softmax(logs: Column) -> Column:
    raised = _given(logs, F.array_max(logs), lambda xs, most: F.transform(xs, lambda x: F.exp(x - most)))
    return _given(raised, F.aggregate(raised, F.lit(0.0), lambda a, x: a + x), lambda xs, all_: F.transform(xs, lambda x: x / all_))


#: Parts of a row that a language has at least, to count in what the corpus says of hosts and declarations.
LEAST_SHARE = 1e-6


def _shares(rows: DataFrame, key: str) -> DataFrame:
    """key, counts (responsibilities summed by the language's place) and rows, of all keys.

    A row gives a few (key, place, share) triples, which combine before they are shuffled, so any number of languages
    costs what rows have of them.
    """
    each = rows.where(F.col(key).isNotNull()).select(key, F.explode("resp").alias("x")).select(key, "x.place", "x.share")
    sums = each.groupBy(key, "place").agg(F.sum("share").alias("share"))
    counts = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "share"))).alias("counts"))
    return counts.join(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")), key)


def _domain(host: Column) -> Column:
    return F.when(host != "", F.substring_index(host, ".", -2))


def _literal(values: list[float]) -> Column:
    """One constant array, however long."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def fuse(scored: DataFrame, languages: int, scratch: Scratch, strength: float = 20.0, evidence: float = 60.0, suffix_weight: float = 0.5) -> DataFrame:
    """The scored rows (kept, declared, host, suffix, scores, n; a written table) with posterior (by language).

    Text: the log likelihood counts as of at most `evidence` trigrams, since trigrams of one text aren't independent.
    From its posterior under even priors every row gives each language a share of itself, those from a millionth on;
    grouped sums of those shares give P(declared | language) and P(suffix | language), and the host's prior, which is
    smoothed towards its domain's with `strength` rows, and that in turn towards the corpus'. Grouping combines before it
    shuffles; rows are narrow, and those of hot hosts, declarations and suffixes stay where they are.
    """
    tempered = F.transform("scores", lambda x: x * F.least(F.lit(1.0), F.lit(evidence) / F.greatest(F.col("n"), F.lit(1))))
    shares = F.transform("even", lambda x, i: F.struct(i.cast("int").alias("place"), x.alias("share")))
    rows = scored.withColumn("tempered", tempered).withColumn("even", _softmax(F.col("tempered"))).withColumn("resp", F.filter(shares, lambda x: x["share"] >= LEAST_SHARE)).drop("even", "tempered")
    rows = rows.withColumn("domain", _domain(F.col("host")))
    whole = {r["place"]: r["share"] for r in rows.select(F.explode("resp").alias("x")).groupBy("x.place").agg(F.sum("x.share").alias("share")).collect()}  # one for each language
    all_ = [float(whole.get(i, 0.0)) + 1.0 for i in range(languages)]
    base, seen = _literal([x / sum(all_) for x in all_]), _literal(all_)
    places = F.sequence(F.lit(0), F.lit(languages - 1))
    of = lambda counts: F.transform(places, lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0.0)))
    total = lambda counts: F.aggregate(F.map_values(counts), F.lit(strength), lambda x, y: x + y)
    smooth = lambda counts, prior: _given(F.arrays_zip(of(counts).alias("n"), prior.alias("p")), total(counts), lambda xs, all_: F.transform(xs, lambda x: (x["n"] + F.lit(strength) * x["p"]) / all_))
    hosts = scratch.table(_shares(rows, "host").withColumn("domain", _domain(F.col("host"))), "host-shares")
    many = hosts.where("domain is not null").groupBy("domain").agg(F.count("*").alias("hosts"))
    domains = scratch.table(_shares(rows, "domain").select("domain", F.col("counts").alias("domain_counts")).join(many, "domain"), "domains")
    hosts = join_by_key(hosts, domains, ["domain"], "hosts", "left")
    hosts = scratch.table(hosts.select("host", F.col("counts").alias("host_counts"), "domain_counts", F.col("rows").alias("host_rows")), "hosts")
    joined = join_by_key(scored, hosts, ["host"], "host_rows", "left")
    for key in ("declared", "suffix"):
        given = _shares(rows, key).select(key, F.col("counts").alias(f"{key}_counts"), F.col("rows").alias(f"{key}_rows"))
        joined = join_by_key(joined, scratch.table(given, key), [key], f"{key}_rows", "left")
    domain_prior = F.when(F.col("domain_counts").isNull(), base).otherwise(smooth(F.col("domain_counts"), base))
    prior = F.when(F.col("host_counts").isNull(), base).otherwise(smooth(F.col("host_counts"), domain_prior))
    told = lambda counts, weight: F.when(F.col(counts).isNull(), F.transform(places, lambda i: F.lit(0.0))).otherwise(F.zip_with(of(F.col(counts)), seen, lambda n, m: F.log((n + 0.5) / (m + 1.0)) * weight))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(tempered, F.transform(prior, lambda x: F.log(x))), add(told("declared_counts", 1.0), told("suffix_counts", suffix_weight)))
    return joined.withColumn("logs", logs).withColumn("posterior", _softmax(F.col("logs"))).drop("logs")


def identify(rows: DataFrame, labelled: DataFrame, least_posterior: float = 0.5, floor: float = -10.5, per_label: int = 2000) -> DataFrame:
    """Per row: its other columns, language, posterior and accepted.

    rows: text, markup (true: text is HTML), declared, host, suffix, and others of any name that are carried along.
    labelled: key, text and label, to fit the text model on. A row is rejected when no language reaches
    `least_posterior`, when it has no letters, or when its trigrams are on average as unlikely as noise (below
    `floor`, from 50 trigrams on). Missing evidence is neutral; a null text is an empty one; whole texts count.
    Repeated rows get the same answer; empty tables give an empty result. Where nothing is labelled all are rejected.
    """
    scratch = Scratch(rows.sparkSession, "langid")
    models = train(labelled, scratch, per_label)
    languages = [x for model in models for x in model.languages]
    carried = [c for c in rows.columns if c not in ("text", "markup", "declared", "host", "suffix", "language", "posterior", "accepted")]
    unused = "_" * (1 + max(map(len, carried), default=0))  # a struct needs a field
    kept = F.struct(*[F.col(f"`{c}`") for c in carried], F.lit(0).alias(unused)).alias("kept")
    mine = [F.col(f"kept.`{c}`") for c in carried]
    if not languages:
        return rows.select(kept).select(*mine, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    scored = rows.select(kept, "text", "markup", "declared", "host", "suffix")
    for i, model in enumerate(models):
        scored = text_scores(scored, model, i > 0)
    scored = scratch.table(scored.drop("text", "markup"), "scores")
    fused = fuse(scored, len(languages), scratch)
    best = F.array_max("posterior")
    names = F.split(F.lit("\u0000".join(languages)), "\u0000")
    language = F.element_at(names, F.array_position("posterior", best).cast("int"))
    fits = (F.col("n") > 0) & ((F.col("n") < 50) | (F.array_max("scores") / F.greatest(F.col("n"), F.lit(1)) >= floor))
    return fused.select(*mine, language.alias("language"), best.alias("posterior"), (fits & (best >= least_posterior)).alias("accepted"))


#: The primary language of an html tag's lang attribute; a tag ends at the next angle bracket.
_LANG = r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b"


def primary(language: Column) -> Column:
    """The primary part of a language tag such as en-US or pt_BR, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(language.cast("string"), "^\\s*([^-_\\s]+)", 1)), F.lit(""))


def document_rows(documents: DataFrame) -> DataFrame:
    """Documents as rows of evidence: the declared language is that of markup in the text, else of the lang column; the source is the host."""
    declared = F.coalesce(primary(F.regexp_extract(F.coalesce("text", F.lit("")), _LANG, 1)), primary(F.col("lang")))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text"), F.lit(False).alias("markup"), declared.alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows of evidence: html's lang attribute, the url's host and its last label."""
    html = F.coalesce("html", F.lit(""))
    host = F.regexp_replace(host_of(F.col("url")), ":[0-9]*$", "")
    declared = primary(F.regexp_extract(html, _LANG, 1))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), html.alias("text"), F.lit(True).alias("markup"), declared.alias("declared"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"))


def labelled_rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("key"), "text", primary(F.col("lang")).alias("label"))


def identify_corpus(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id or page_id, language, posterior, accepted of every document and page."""
    return identify(document_rows(documents).unionByName(page_rows(pages)), labelled_rows(documents))
