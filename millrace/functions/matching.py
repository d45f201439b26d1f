"""Which terms of a vocabulary occur in a text: one Aho-Corasick automaton for all of them, one walk over the text.

A search costs the length of the text whatever the size of the vocabulary. It runs on Arrow batches of texts, with
Python's own lower case, word characters and white space, and returns the terms in the vocabulary's order.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a worker looks at at a time.
ROWS = 1000
THINK = re.compile(r"<think>(.*?)</think>", re.DOTALL)


def normal(text: str) -> str:
    """Lower case, only word characters, hyphens and single spaces."""
    return re.sub(r"[^\w\-]+", " ", text.lower()).strip()


class Vocabulary:
    """The automaton of some terms, built once by each worker."""

    def __init__(self, terms: tuple[str, ...]):
        import ahocorasick

        self.terms = terms
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            if term:
                self.automaton.add_word(term, k)
        if any(terms):
            self.automaton.make_automaton()
        self.empty = [k for k, term in enumerate(terms) if not term]
        self.hyphens = any("-" in t for t in terms)

    def places(self, text: str) -> set[int]:
        return {k for _, k in self.automaton.iter(text)} if len(self.automaton) else set()

    def found(self, text: str) -> list[str]:
        """The terms in a text as it stands."""
        return [self.terms[k] for k in sorted(self.places(text).union(self.empty))]

    def found_spaced(self, text: str) -> list[str]:
        """The terms in a normalized text, its hyphens as they are or as spaces."""
        if "-" not in text:
            return self.found(text)
        return [self.terms[k] for k in sorted(self.places(text).union(self.places(text.replace("-", " ")), self.empty))]


@functools.cache
def vocabulary(terms: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(terms)


def mapped(work: Callable[[Iterable[str | None]], tuple[list, ...]], kinds: dict[str, pa.DataType], schema: str, texts: Column) -> Column:
    """A struct column that `work` makes of some texts at a time."""

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            parts = [work(a.slice(i, ROWS).to_pylist()) for i in range(0, max(len(a), 1), ROWS)]
            yield pa.StructArray.from_arrays([pa.concat_arrays([pa.array(p[k], kind) for p in parts]) for k, kind in enumerate(kinds.values())], list(kinds))

    return run(texts)


TERMS = pa.list_(pa.string())


def concepts_in(text: Column, terms: list[str]) -> Column:
    """struct<found, planned>: the terms in the normalized text, hyphens as they are or as spaces, and in its first closed think block; a null text has none."""
    known = tuple(terms)

    def work(texts: Iterable[str | None]) -> tuple[list, ...]:
        search = vocabulary(known).found_spaced
        plans = [THINK.search(t or "") for t in texts]
        return [search(normal(t or "")) for t in texts], [search(normal(p[1])) if p else [] for p in plans]

    return mapped(work, {"found": TERMS, "planned": TERMS}, "found array<string>, planned array<string>", text)


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms in a text whose characters beside words, hyphens and white space count as spaces, in lower case; a null text has none."""
    known = tuple(terms)

    def work(texts: Iterable[str | None]) -> tuple[list, ...]:
        search = vocabulary(known).found
        return ([search(re.sub(r"[^\w\s\-]", " ", (t or "").lower())) for t in texts],)

    return mapped(work, {"found": TERMS}, "found array<string>", text)["found"]
