"""The rewards as Arrow kernels: arrays in, an array of scores out, in the process that calls.

A trainer scores a few dozen completions at every step and has no use for a job of the cluster there; tables
are scored by the columns of `rewards`, with which these kernels agree (tests compare them). Completions are strings, messages
or lists of these, as Python objects or as an Arrow array of strings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa

from ..fixed import CHATTER_PATTERN, CONCEPTS, STOP_WORDS, URL_PATTERN
from .matching import THINK, normal, vocabulary
from .text import completion_text

LINK, CHAT = re.compile(URL_PATTERN, re.IGNORECASE), re.compile(CHATTER_PATTERN, re.IGNORECASE)
STOP = frozenset(STOP_WORDS)


def texts_of(completions: pa.Array | pa.ChunkedArray | Sequence) -> list[str]:
    return ["" if x is None else completion_text(x) for x in (completions.to_pylist() if isinstance(completions, pa.Array | pa.ChunkedArray) else completions)]


def column_of(values: pa.Array | pa.ChunkedArray | Sequence | None, n: int) -> list:
    """A column beside `n` completions; a missing or short one is filled up with nulls."""
    given = [] if values is None else values.to_pylist() if isinstance(values, pa.Array | pa.ChunkedArray) else list(values)
    return (given + [None] * n)[:n]


def limited(value: float, digits: int | None) -> float:
    return value if digits is None else round(value, digits)


def format_score(text: str, min_think: int = 50, min_answer: int | None = 30, other: float = 0.0) -> float:
    tags = ("<think>" in text) + ("</think>" in text)
    if tags < 2:
        return tags / 2 - 1.0
    block = THINK.search(text)
    if block is None or len(block[1].strip()) < min_think:
        return other
    if min_answer is not None and len(THINK.sub("", text).strip()) < min_answer:
        return 0.5
    return 1.0 if "<answer>" in text and "</answer>" in text else 0.8


class ConceptScorer:
    """The vocabulary's automaton and, for each topic, the sets that its terms count in."""

    def __init__(self, concepts: dict[str, list[str]] = CONCEPTS, cap: float = 2.0):
        self.terms = tuple(dict.fromkeys(t for terms in concepts.values() for t in terms))
        self.own = {topic: frozenset(terms) for topic, terms in concepts.items()}
        self.cap = cap

    def score(self, text: str, topic: str | None, digits: int | None) -> float:
        search = vocabulary(self.terms).found_spaced
        block = THINK.search(text)
        found, planned = search(normal(text)), search(normal(block[1])) if block else []
        own = self.own.get(topic or "", frozenset())
        mine, plan = sum(t in own for t in found), sum(t in own for t in planned) if topic else len(planned)
        return min(limited(0.15 * plan + 0.4 * mine + 0.2 * (len(found) - mine), digits), self.cap)


def content_set(text: str) -> set[str]:
    return {w for w in normal(text).split() if len(w) > 2 and w not in STOP}


def grounding_score(text: str, reference: str | None, digits: int | None) -> float:
    wanted = content_set(reference or "")
    if not wanted:
        return 0.5
    said = content_set(text)
    shared = len(said & wanted)
    overlap = shared / len(said | wanted) if said else 0.0
    return limited(min(0.5 * overlap + 0.5 * min(shared / len(wanted) * 1.5, 1.0), 1.0), digits)


def gram_ratio(text: str, n: int = 4, least: int = 16) -> float:
    """Distinct n-grams of words per n-gram; 1 for a text of fewer words than `least`."""
    words = text.lower().split()
    if len(words) < least:
        return 1.0
    return len(set(zip(*(words[k:] for k in range(n)), strict=False))) / (len(words) - n + 1)


def repetition_score(text: str, max_chars: int | None = 3500, min_chars: int = 40, digits: int | None = 3) -> float:
    if len(text.strip()) < min_chars:
        return -1.5
    over = 0.0 if max_chars is None else max(0.0, min(1.0, (len(text) - max_chars) / 1000.0))
    loop = max(0.0, (0.65 - gram_ratio(text)) * 2.0)
    return limited(0.0 - over - loop - (0.4 if LINK.search(text) else 0.0) - (0.3 if CHAT.search(text) else 0.0), digits)


def callables(digits: int | None = 3, concepts: dict[str, list[str]] = CONCEPTS) -> list[Callable[..., list[float]]]:
    """The ordered rewards as functions for a trainer: completions and columns in, a list of floats out. No session is needed and no job is run."""
    scorer = ConceptScorer(concepts)

    def reward_format(completions, **columns) -> list[float]:
        return [format_score(t) for t in texts_of(completions)]

    def reward_concepts(completions, taxonomy_topic=None, **columns) -> list[float]:
        said = texts_of(completions)
        return [scorer.score(t, topic, digits) for t, topic in zip(said, column_of(taxonomy_topic, len(said)), strict=True)]

    def reward_grounding(completions, reference_answer=None, **columns) -> list[float]:
        said = texts_of(completions)
        answers = [None if r is None else completion_text(r) for r in column_of(reference_answer, len(said))]
        return [grounding_score(t, r, digits) for t, r in zip(said, answers, strict=True)]

    def reward_repetition(completions, **columns) -> list[float]:
        return [repetition_score(t, digits=digits) for t in texts_of(completions)]

    return [reward_format, reward_concepts, reward_grounding, reward_repetition]


def score_batch(batch: pa.RecordBatch | pa.Table, digits: int | None = 3, completion: str = "completion") -> pa.Table:
    """A table of completions (and taxonomy_topic, reference_answer if it has them) with a column for each reward."""
    table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    columns = {c: table.column(c) for c in ("taxonomy_topic", "reference_answer") if c in table.column_names}
    for reward in callables(digits):
        table = table.append_column(reward.__name__, pa.array(reward(table.column(completion), **columns), pa.float64()))
    return table
