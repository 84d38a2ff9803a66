"""Parsing pages: one vectorized helper that gives title, texts, links and headings, and the plain text."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from typing import Any
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kondate import schema

UNREAD = ("script", "style")
UNSEEN = (*UNREAD, "noscript")


class _Tokens(HTMLParser):
    """The page as a flat list: (tag, 1, attributes) where an element opens, (tag, -1, None) where it ends, ('', 0, text)."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, int, Any]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found.append((tag, 1, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.found.append((tag, -1, None))

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.found.append(("", 0, data))


#: Characters of a fault that are kept.
FAULT_LENGTH = 120


def _tokens(html: str | None) -> tuple[list[tuple[str, int, Any]], str | None]:
    """The tokens, and what the parser stumbled over: then they are those before it.

    Markup may be so broken that the parser gives up, and that is that page's outcome, not the job's.
    """
    parser = _Tokens()
    try:
        parser.feed(html or "")
    except (AssertionError, ValueError, IndexError, RecursionError) as fault:
        return parser.found, str(fault)[:FAULT_LENGTH] or type(fault).__name__
    return parser.found, None


def _outside(tokens: list[tuple[str, int, Any]], tags: tuple[str, ...]) -> list[bool]:
    """Whether each token stands outside of all elements of these tags; ends without a beginning count for nothing."""
    steps = (turn if tag in tags else 0 for tag, turn, _ in tokens)
    return [not d for d in accumulate(steps, lambda depth, step: max(0, depth + step), initial=0)][1:]


def _spans(tokens: list[tuple[str, int, Any]], shown: list[bool], tags: tuple[str, ...]) -> list[tuple[int, int]]:
    """From the last opening of one of the tags to the first end of the same tag."""
    out, begun = [], None
    for i, (tag, turn, _) in enumerate(tokens):
        if turn == 1 and tag in tags and shown[i]:
            begun = i
        elif turn == -1 and begun is not None and tag == tokens[begun][0]:
            out.append((begun, i))
            begun = None
    return out


def page_parts(html: str | None) -> dict[str, Any]:
    """title, texts, links, headings and fault (null, if it could be read to its end) of one page."""
    tokens, fault = _tokens(html)
    shown = _outside(tokens, UNSEEN)
    pieces = [(i, unicodedata.normalize("NFKC", data).strip()) for i, (tag, _, data) in enumerate(tokens) if not tag and shown[i]]
    places, texts = [i for i, _ in pieces], [t for _, t in pieces]

    def within(i: int, j: int) -> list[tuple[int, str]]:
        return pieces[bisect_left(places, i) : bisect_left(places, j)]

    named = [(i, has.get("content") or "", True) for i, (tag, turn, has) in enumerate(tokens) if tag == "meta" and turn == 1 and shown[i] and has.get("property") == "og:title"]
    headings = []
    for i, j in _spans(tokens, shown, ("h1", "h2", "title")):
        text = " ".join(t for _, t in within(i, j)).strip()
        if tokens[i][0] == "title":
            named.append((j, text, False))
        else:
            headings.append({"kind": tokens[i][0], "text": text, "offset": bisect_left(places, i)})
    title = ""
    for _, text, is_set in sorted(named):
        title = text if is_set or not title else title
    links = []
    for i, j in _spans(tokens, shown, ("a",)):
        pictures = [(k, tokens[k][2]["alt"]) for k in range(i, j) if tokens[k][:2] == ("img", 1) and shown[k] and tokens[k][2].get("alt")]
        links.append({"href": tokens[i][2].get("href") or "", "label": " ".join(t for _, t in sorted(within(i, j) + pictures))})
    return {"title": unicodedata.normalize("NFKC", title), "texts": texts, "links": links, "headings": headings, "fault": fault}


def plain_text(html: str | None) -> str:
    tokens, _ = _tokens(html)
    read = _outside(tokens, UNREAD)
    return " ".join(data.strip() for i, (tag, _, data) in enumerate(tokens) if not tag and read[i])


def spread(pages: DataFrame) -> DataFrame:
    """Pages dealt evenly to all cores, three parts each, before they are parsed: a small file or a coalesced shuffle may hold very many.

    A task streams its pages, however many, but starting its Python workers takes longer than hundreds of pages do.
    """
    return pages.repartition(3 * pages.sparkSession.sparkContext.defaultParallelism)


#: Rows of a batch that a task works on at a time; only so many have their texts, tokens and results in Python.
SLICE = 200
_PARSED = to_arrow_type(schema.PARSED)


def slices(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Views of a batch, which stays as Spark sent it: its texts become Python's slice by slice."""
    for part in parts:
        for i in range(0, max(1, len(part)), SLICE):
            yield part[i : i + SLICE]


@F.arrow_udf(schema.PARSED)
def parse_html(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """title, texts, links, headings, fault; a heading has the index of the text at which it begins. Null is an empty page.

    A page that can't be parsed has a fault, and what stands before it; it never ends the job.
    """
    for part in slices(pages):
        yield pa.array([page_parts(x.as_py()) for x in part], _PARSED)


@F.arrow_udf(T.StringType())
def page_text(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts outside of scripts and styles, stripped, joined by spaces."""
    for part in slices(pages):
        yield pa.array([plain_text(x.as_py()) for x in part], pa.string())


@F.arrow_udf(T.StringType())
def resolve_link(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A link's address on its page; '' where it can't be read."""

    def joined(base: str | None, href: str | None) -> str:
        try:
            return urljoin(base or "", href or "")
        except ValueError:
            return ""

    for bases, hrefs in pages:
        for base, href in zip(slices(iter([bases])), slices(iter([hrefs])), strict=True):
            yield pa.array([joined(x.as_py(), y.as_py()) for x, y in zip(base, href, strict=True)], pa.string())
