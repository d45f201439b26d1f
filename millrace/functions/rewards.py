"""Rule-based rewards of a completion as column expressions. Presets of the training notebooks are parameters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CHATTER_PATTERN, CONCEPTS, STOP_WORDS, URL_PATTERN
from .kernels import gram_ratio
from .matching import concepts_in, mapped
from .text import first_think, has_think, normalize, once, or_default, pattern, strip, tokens, without_think


def rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.bround(c, digits)


def contains(c: Column, text: str) -> Column:
    return F.contains(c, F.lit(text))


def format_reward(text: Column, min_think: int = 50, min_answer: int | None = 30, other: float = 0.0) -> Column:
    """1.0 or 0.8 for closed reasoning with an answer, 0.5 if the answer is brief, -0.5 for one tag, -1.0 for none.

    The notebook preset is min_answer=None (no test of the answer), other=0.4.
    """
    both = contains(text, "<think>") & contains(text, "</think>")
    either = contains(text, "<think>") | contains(text, "</think>")
    thought = F.coalesce(F.length(strip(first_think(text))) >= min_think, F.lit(False))
    answered = F.lit(True) if min_answer is None else F.length(without_think(text)) >= min_answer
    full = F.when(contains(text, "<answer>") & contains(text, "</answer>"), 1.0).otherwise(0.8)
    closed = F.when(thought & answered, full).when(thought, 0.5).otherwise(other)
    return F.when(both & has_think(text), closed).when(both, other).when(either, -0.5).otherwise(-1.0)


def literal_terms(terms: list[str]) -> Column:
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def topic_terms(topic: Column, concepts: dict[str, list[str]]) -> Column:
    """Terms of a row's topic; none for an unknown topic."""
    known = F.create_map(*[x for k, terms in concepts.items() for x in (F.lit(k), literal_terms(terms))])
    return F.coalesce(F.element_at(known, F.coalesce(topic, F.lit(""))), literal_terms([]))


def distinct_terms(concepts: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(t for terms in concepts.values() for t in terms))


def concept_score(found: Column, planned: Column, topic: Column, concepts: dict[str, list[str]], cap: float, digits: int | None) -> Column:
    """The reward from the terms found in the text and in its plan; both may hold terms of other vocabularies."""
    every, own = literal_terms(distinct_terms(concepts)), topic_terms(topic, concepts)
    wanted = F.when(or_default(topic, "") == "", every).otherwise(own)
    count = lambda terms, of: F.size(F.filter(terms, lambda t: F.array_contains(of, t)))
    mine = count(found, own)
    score = 0.15 * count(planned, wanted) + 0.4 * mine + 0.2 * (count(found, every) - mine)
    return F.least(rounded(score, digits), F.lit(cap))


def concept_reward(text: Column, topic: Column, concepts: dict[str, list[str]] = CONCEPTS, cap: float = 2.0, digits: int | None = 3) -> Column:
    """0.4 per concept of the topic, 0.2 per other concept, and 0.15 per concept planned in the first think block, up to `cap`."""
    return once(concepts_in(text, distinct_terms(concepts)), lambda x: concept_score(x["found"], x["planned"], topic, concepts, cap, digits))


def concept_rewards(df: DataFrame, text: Column, topic: Column, presets: dict[str, dict[str, list[str]]], cap: float = 2.0, digits: int | None = 3) -> DataFrame:
    """`df` plus a reward per preset of concepts. Texts are normalized and searched once, for the terms of all presets together."""
    every = list(dict.fromkeys(t for concepts in presets.values() for t in distinct_terms(concepts)))
    searched = df.withColumn("__terms", concepts_in(text, every))
    found, planned = F.col("__terms.found"), F.col("__terms.planned")
    return searched.withColumns({name: concept_score(found, planned, topic, concepts, cap, digits) for name, concepts in presets.items()}).drop("__terms")


def content_words(c: Column) -> Column:
    return F.array_distinct(F.filter(tokens(normalize(c)), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 2)))


def grounding_reward(text: Column, reference: Column, digits: int | None = 3) -> Column:
    """Half the Jaccard similarity of content words plus half of 1.5 times the reference's recall (at most 1); 0.5 without a reference."""

    def score(x: Column) -> Column:
        common = F.size(F.array_intersect(x["c"], x["r"])).cast("double")
        union = F.size(x["c"]) + F.size(x["r"]) - common
        jaccard = F.when(F.size(x["c"]) > 0, common / union).otherwise(0.0)
        value = F.least(0.5 * jaccard + 0.5 * F.least(common / F.size(x["r"]) * 1.5, F.lit(1.0)), F.lit(1.0))
        return F.when(F.size(x["r"]) == 0, 0.5).otherwise(rounded(value, digits))

    words = F.struct(content_words(text).alias("c"), content_words(F.coalesce(reference, F.lit(""))).alias("r"))
    return F.when(or_default(reference, "") == "", 0.5).otherwise(once(words, score))


def distinct_ratio(text: Column) -> Column:
    """Distinct 4-grams of words per 4-gram, 1 for a short text; sets of word tuples are made in Arrow batches, as arrays of joined strings cost several times as much."""
    return mapped(lambda texts: ([gram_ratio(t or "") for t in texts],), {"ratio": pa.float64()}, "ratio double", text)["ratio"]


def repetition_reward(text: Column, max_chars: int | None = 3500, min_chars: int = 40, digits: int | None = 3) -> Column:
    """0 for a sound text; penalties for near-empty, overlong, looping, linking and chatty ones.

    The notebook preset is max_chars=None, min_chars=30.
    """
    over = F.lit(0.0) if max_chars is None else F.greatest(F.least(F.lit(1.0), (F.length(text) - max_chars) / 1000.0), F.lit(0.0))
    loop = once(distinct_ratio(text), lambda r: F.when(r < 0.65, (0.65 - r) * 2.0).otherwise(0.0))
    link = F.when(text.rlike("(?i)" + URL_PATTERN), 0.4).otherwise(0.0)
    chat = F.when(text.rlike("(?i)" + pattern(CHATTER_PATTERN)), 0.3).otherwise(0.0)
    score = F.lit(0.0) - over - loop - link - chat
    return F.when(F.length(strip(text)) < min_chars, -1.5).otherwise(rounded(score, digits))


def all_rewards(text: Column, topic: Column, reference: Column, digits: int | None = 3) -> dict[str, Column]:
    """The ordered set of rewards for a trainer: columns for DataFrame.withColumns."""
    return {
        "reward_format": format_reward(text),
        "reward_concepts": concept_reward(text, topic, digits=digits),
        "reward_grounding": grounding_reward(text, reference, digits=digits),
        "reward_repetition": repetition_reward(text, digits=digits),
    }
