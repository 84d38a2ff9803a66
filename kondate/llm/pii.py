"""Personal data: pattern detectors, and terms that reveal a protected entity by corpus co-occurrence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, join_by_key

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A term: a run of letters and digits of any length. What common words tell is below the thresholds by their counts.
_WORD = re.compile(r"[^\W_]+")
#: Terms that a task counts before it gives their counts out.
HELD_TERMS = 300_000
SPANS = "array<struct<start:int,kind:int,end:int>>"
WORDS = "array<struct<term:bigint,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the local part is all that its characters allow back to the last match.

    Looking from each `@` keeps this linear in texts whose words run on for long.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of emails, addresses, cards and phones that pass their checks, in order."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def entities(text: str, start: int, kind: int, end: int) -> list[int]:
    """The protected entities of a base span as signed 64-bit hashes: its value, and what many values share.

    Values count without case, spaces and punctuation. Above them stand an address's domain and its owner's name, a
    network, a card's issuer, and a phone number without its last four digits.
    """
    value = text[start:end].lower() if kind < 2 else re.sub(r"[^0-9]", "", text[start:end])
    if kind == 0:
        above = [f"domain:{value.partition('@')[2]}", f"owner:{value.partition('@')[0]}"]
    else:
        above = [(f"network:{value.rpartition('.')[0]}", f"issuer:{value[:6]}", f"line:{value[:-4]}")[kind - 1]]
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in (f"{kind}:{value}", *above)]


def mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def terms(text: str) -> set[str]:
    """The distinct terms outside base spans."""
    return set(_WORD.findall(_blanked(text, base_spans(text)).lower()))


def _blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its base spans as spaces; positions stay."""
    out, at = [], 0
    for start, _, end in spans:
        if end > at:
            out += [text[at:start], " " * (end - max(at, start))]
            at = end
    return "".join(out) + text[at:]


def find_base(documents: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), spans, entities, words (marks and places of all terms, where there are entities) of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, spans, held, offsets, words, starts, ends = [], [], [], [0], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = base_spans(text)
                marks.append(mark(text))
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                held.append(list({e for x in found for e in entities(text, *x)}))
                for m in _WORD.finditer(_blanked(text, found)) if found else ():
                    words.append(mark(m[0].lower()))
                    starts.append(m.start())
                    ends.append(m.end())
                offsets.append(len(words))
            placed = pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["term", "start", "end"])
            columns = [batch.column("doc_id"), pa.array(marks, pa.int64()), pa.array(spans, _SPAN), pa.array(held, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), placed)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "spans", "entities", "words"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, f"doc_id long, mark long, spans {SPANS}, entities array<long>, words {WORDS}")


def document_counts(documents: DataFrame, most: int = HELD_TERMS) -> DataFrame:
    """term, df: in how many of all rows each term stands. A task counts across its batches, at most `most` terms at a time."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            found, n = np.fromiter(map(mark, counts), "i8", len(counts)), np.fromiter(counts.values(), "i8", len(counts))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["term", "df"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update(terms(text.as_py() or ""))
                if len(counts) > most:
                    yield counted()
        yield counted()

    return documents.select("text").mapInArrow(tally, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass(frozen=True)
class Rule:
    """When a term tells an entity, by their counts b, c, df and the class's copies and terms."""

    support: int = 3
    generalise: float = 0.7
    remove: float = 0.95
    texts: float = 1.5
    chance: float = 0.05
    known: float = 0.25

    def share(self, total: int) -> Column:
        """The part of the entity's information that the term tells."""
        information = F.log2(F.lit(float(total)) / F.col("c"))
        told = F.log2((F.col("b") * F.lit(float(total)) / F.col("c") + F.lit(float(self.support))) / (F.col("df") + F.lit(float(self.support))))
        return F.when(information > 0, told / information).otherwise(F.lit(0.0))

    def met(self, total: int) -> Column:
        b, c, d, n = F.col("b"), F.col("c"), F.col("df"), F.lit(float(total))
        cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
        g = 2 * (cell(b, c * d / n) + cell(c - b, c * (n - d) / n) + cell(d - b, (n - c) * d / n) + cell(n - c - d + b, (n - c) * (n - d) / n))
        return (F.col("share") >= self.generalise) & (b / F.col("copies") >= self.texts) & (g / F.col("copies") >= 2 * F.log(F.col("terms") / self.chance))


def disclosing_terms(documents: DataFrame, held: DataFrame, scratch: Scratch, total: int, rule: Rule) -> DataFrame:
    """doc_id, mark, term, action: the terms that tell an entity, and on evidence of more than one text.

    held: doc_id, mark, entities and words of every row with an entity. With n rows, the entity in c, the term in d and
    both in b of them, the entity's share of the term's rows is (b + s c / n) / (d + s): `support` (s) more rows are
    supposed that hold the entity by chance alone. The term tells log2(share n / c) bits of the entity's log2(n / c);
    from a part of them on it is generalised, and from a larger one on removed.

    Any rare word of one text stands with that text's values, which says nothing. So rows count for as much as they
    differ: an entity's rows have each of their words in so many rows on average, weighted by ln(n / d), which is c for
    copies and 1 for texts of their own; b and the G-test of the four counts are divided by it. A term needs `texts` of
    such rows, and a G that chance would reach with less than `chance` in any of the entity's terms, as
    exp(-G / 2) bounds it.

    Entities that stand in the same rows have the same counts with every term and are one class, known by the count and
    two hash sums of its rows. Classes of one row have no evidence and those of more than a `known` part of all rows
    protect nobody: neither is paired with terms.
    """
    rows = held.groupBy("doc_id", "mark").agg(F.count("*").alias("m"), F.first("entities").alias("entities"), F.array_distinct(F.first("words")["term"]).alias("terms"))
    rows = scratch.table(rows, "holders")
    each = scratch.table(rows.select("doc_id", "mark", "m", F.explode("entities").alias("entity")), "entities")
    row = F.xxhash64("doc_id", "mark")
    alike = each.groupBy("entity").agg(F.sum("m").alias("c"), F.bit_xor(row).alias("x"), F.sum(F.shiftrightunsigned(row, 32)).alias("y"), F.count("*").alias("k"))
    alike = alike.where((F.col("k") > 1) & (F.col("c") <= total * rule.known))
    alike = scratch.table(alike.select("entity", F.xxhash64("c", "x", "y", "k").alias("class"), "c", "k"), "classes")
    classes = join_by_key(each.select("doc_id", "mark", "entity"), alike, ["entity"], "k").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("class", "c")).alias("classes"))
    pairs = rows.join(classes, ["doc_id", "mark"]).select("doc_id", "mark", "m", "classes", F.explode("terms").alias("term"))
    pairs = scratch.table(pairs.select("doc_id", "mark", "m", "term", F.explode("classes").alias("x")).select("doc_id", "mark", "m", "term", "x.class", "x.c"), "pairs")
    both = pairs.groupBy("class", "term").agg(F.sum("m").alias("b"), F.count("*").alias("k"), F.first("c").alias("c"))
    both = scratch.table(both, "both")
    needed = scratch.table(both.groupBy("term").agg(F.count("*").alias("n")), "needed")
    counts = document_counts(documents).join(needed, "term")
    both = scratch.table(join_by_key(both, scratch.table(counts, "counts"), ["term"], "n"), "counted")
    weight = F.log(F.lit(float(total)) / F.col("df")) + 1e-9
    alone = both.groupBy("class").agg((F.sum(F.col("b") * weight) / F.sum(weight)).alias("copies"), F.count("*").alias("terms"))
    told = both.drop("n").join(alone, "class")
    flagged = told.withColumn("share", rule.share(total)).where(rule.met(total)).select("class", "term", "k", F.when(F.col("share") >= rule.remove, "remove").otherwise("generalise").alias("action"))
    flagged = scratch.table(flagged, "flagged")
    return join_by_key(pairs.select("doc_id", "mark", "class", "term"), flagged, ["class", "term"], "k").groupBy("doc_id", "mark", "term").agg(F.max("action").alias("action"))


def find_personal_data(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, mark, spans, terms, actions of every row: base spans, and those of the terms that reveal an entity.

    Entities are the values found by the detectors and what many of them share (``entities``). A term is struck in
    documents that hold the entity it reveals, so a document without personal data stays as it is, and so do the words
    that stand with a value in one text alone, or in its copies. Null and empty texts have no spans; rows that
    repeat doc_id and text get the same answer each; a row without doc_id counts and has base spans, but no terms; an
    empty table gives an empty result; columns beside doc_id and text are not read. Texts are never shuffled:
    the first pass keeps marks and places of the terms of rows with entities, the second counts terms.
    """
    scratch = Scratch(documents.sparkSession, "pii")
    found = scratch.table(find_base(documents), "found")
    held = found.where("size(entities) > 0")
    struck = disclosing_terms(documents, held, scratch, max(1, found.count()), rule or Rule())
    meant = struck.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("meant"))
    meant = meant.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "meant")
    joined = held.join(meant, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    hits = F.filter("words", lambda w: F.map_contains_key("meant", w["term"]))
    spans = F.transform(hits, lambda w: F.struct(w["start"].alias("start"), F.lit(4).alias("kind"), w["end"].alias("end")))
    actions = F.transform(hits, lambda w: F.try_element_at("meant", w["term"]))
    known = F.col("meant").isNotNull()
    holders = joined.select("doc_id", "mark", "spans", F.when(known, spans).alias("terms"), F.when(known, actions).alias("actions"))
    others = found.where("size(entities) = 0").select("doc_id", "mark", "spans", F.lit(None).cast(SPANS).alias("terms"), F.lit(None).cast("array<string>").alias("actions"))
    return others.unionByName(holders)


def kind_counts() -> list[Column]:
    """n_email, n_ip, n_card, n_phone of spans. The kind is no argument of the condition: a second one would be the place in the array."""

    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return [of(kind) for kind in range(4)]


def digest_spans(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans from ``find_personal_data``."""
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    whole = F.concat("spans", F.coalesce("terms", F.array().cast(SPANS)))
    return found.select("doc_id", *kind_counts(), F.sha2(written(F.col("spans")).cast("binary"), 256).alias("base_sha256"), written(whole).alias("spans"))


def sanitised(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets, generalised terms by their first letter, removed ones by nothing."""

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans, hidden, actions in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "terms", "actions")), strict=True):
                text = text or ""
                new = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in spans or []]
                new += [(s["start"], s["end"], "" if a == "remove" else f"{text[s['start']]}…") for s, a in zip(hidden or [], actions or [], strict=True)]
                out, at = [], 0
                for start, end, put in sorted(new):
                    if start >= at:
                        out += [text[at:start], put]
                    at = max(at, end)
                texts.append("".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(found.dropDuplicates(["doc_id"]).drop("mark"), "doc_id").mapInArrow(strike, "doc_id long, text string")
