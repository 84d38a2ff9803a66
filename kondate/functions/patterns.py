"""Many words looked for at once: an automaton that reads a text once, whatever the number of words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of an automaton, which each worker holds as a whole.
MOST_WORDS = 1_000_000
_BUILT: dict[int, tuple[list[str], Any]] = {}


def _automaton(words: list[str]) -> Any:
    """The words' Aho-Corasick automaton, made once in a worker, which holds the last one."""
    import ahocorasick

    found = _BUILT.get(key := hash(tuple(words)))
    if found is None or found[0] != words:
        made = ahocorasick.Automaton()
        ids: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            ids.setdefault(word, []).append(i)
        for word, places in ids.items():
            if word:
                made.add_word(word, places)
        made.make_automaton()
        _BUILT.clear()
        found = _BUILT[key] = (words, made)
    return found[1]


def words_in(text: Column, words: list[str]) -> Column:
    """The places (from 0, ascending) in the list of the words that a text contains; null for a null text.

    An empty word is in every text. Time grows with the text and its hits, not with the number of words, of which there
    may be a million.
    """
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    everywhere = [i for i, word in enumerate(words) if not word]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(words)
        some = len(automaton) > 0
        for part in parts:
            yield part.map(lambda t: None if t is None else sorted({*everywhere, *(i for _, places in automaton.iter(t) for i in places)} if some else everywhere))

    return find(text)


def first_named(text: Column, named: list[tuple[str, str]]) -> Column:
    """The name of the first of (name, word) in the list whose word a text contains; null without one."""
    names, words = [n for n, _ in named], [w for _, w in named]

    @F.pandas_udf(T.StringType())
    def name(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if x is None else names[x[0]] if len(x) else None)

    return name(words_in(text, words))
