"""Curation: promotion filter, compact states for a decision model, its thresholds, pass and reject.

The model is a plug-in: any callable from a pandas frame of states (thread_id, title, post_body,
best_answer) to a frame of noul, score, choice, confidence, built once per worker by `make_scorer`.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import PROMO_DECISION, PROMO_PATTERNS
from ..functions.text import pattern, strip, tokens

MAX_STATE_CHARS = 600
RELEVANCE, QUALITY = 0.60, 0.60
NOTEBOOK_RELEVANCE = 0.50
DECISION = ["noul", "score", "choice", "confidence"]

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def is_promo(title: Column, body: Column) -> Column:
    """Invitations and meta posts by pattern, or hardly more than a link."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    both = strip(F.lower(F.concat(title, F.lit(" "), body)))
    text = strip(body)
    links = text.startswith("http://") | text.startswith("https://")
    linked = text.contains("http://") | text.contains("https://")
    words = tokens(text)
    plain = F.size(F.filter(words, lambda w: ~w.startswith("http")))
    stems = dict.fromkeys(re.match(r"\\b([a-z]+)", p)[1] for p in PROMO_PATTERNS)
    hinted = reduce(or_, (both.contains(stem) for stem in stems))  # cheap, and false for most rows
    return hinted & both.rlike("|".join(map(pattern, PROMO_PATTERNS))) | links & (F.size(words) <= 10) | (F.length(text) < 100) & linked & (plain < 6)


def state_columns(max_chars: int = MAX_STATE_CHARS, stripped: bool = True) -> dict[str, Column]:
    """The texts that a model sees: stripped, the long ones cut to `max_chars`. The notebook preset is stripped=False: title and body as they are."""
    text = lambda c: strip(F.coalesce(c, F.lit(""))) if stripped or c == "best_answer_body" else F.coalesce(c, F.lit(""))
    return {"title": text("title"), "post_body": F.substring(text("post_body"), 1, max_chars), "best_answer": F.substring(text("best_answer_body"), 1, max_chars)}


def states(threads: DataFrame, max_chars: int = MAX_STATE_CHARS, stripped: bool = True) -> DataFrame:
    """thread_id and the texts that a model sees; empty bodies and answers are null."""
    text = state_columns(max_chars, stripped)
    return threads.select("thread_id", text["title"].alias("title"), *(F.nullif(text[k], F.lit("")).alias(k) for k in ("post_body", "best_answer")))


def score(threads: DataFrame, make_scorer: Callable[[], Scorer], max_chars: int = MAX_STATE_CHARS, latency: str | None = None) -> DataFrame:
    """`threads` plus noul, score, choice, confidence; a missing answer is 0.0 or `other`. Only the id and the three short texts go to Python.

    `latency` names a column for the milliseconds that the scorer took for a row: its share of the call for its batch, and nothing else.
    """
    names = ["thread_id", "title", "post_body", "best_answer"]

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for columns in batches:
            asked = pd.DataFrame(dict(zip(names, columns, strict=True)))
            began = time.perf_counter()
            answer = scorer(asked)
            took = 1000 * (time.perf_counter() - began) / max(len(asked), 1)
            answer = answer.reset_index(drop=True).reindex(columns=DECISION).fillna({"noul": 0.0, "score": 0.0, "choice": "other", "confidence": 0.0})
            yield answer.assign(took=took)

    answers = F.pandas_udf(run, "noul double, score double, choice string, confidence double, took double").asNondeterministic()
    text = state_columns(max_chars)
    asked = threads.withColumn("__answer", answers(F.col("thread_id"), *(text[k] for k in names[1:])))
    made = {k: F.col(f"__answer.{k}") for k in DECISION} | ({latency: F.col("__answer.took")} if latency else {})
    return asked.withColumns(made).drop("__answer")


def decide(scored: DataFrame, relevance: float = RELEVANCE, quality: float = QUALITY, digits: int = 4) -> DataFrame:
    """Decision columns from noul, score, choice, confidence: thresholds on the values as they are, then rounding."""
    passed = (F.col("noul") >= relevance) & (F.col("score") >= quality)
    return scored.withColumns(
        {
            "curation_passed": passed,
            "is_rag_related": F.bround("noul", digits),
            "technical_quality_score": F.bround("score", digits),
            "taxonomy_topic": F.coalesce("choice", F.lit("other")),
            "topic_confidence": F.bround("confidence", digits),
        }
    ).drop(*DECISION)


def curate(threads: DataFrame, scored: Callable[[DataFrame], DataFrame], relevance: float = RELEVANCE, quality: float = QUALITY) -> DataFrame:
    """All threads with decision columns and pre_filtered. `scored` adds the model's answers and sees no promotion."""
    promo = is_promo(F.col("title"), F.col("post_body"))
    asked = decide(scored(threads.where(~promo)), relevance, quality).withColumn("pre_filtered", F.lit(False))
    constant = dict(zip(("is_rag_related", "technical_quality_score", "taxonomy_topic", "topic_confidence"), map(F.lit, PROMO_DECISION), strict=True))
    skipped = threads.where(promo).withColumns(constant | {"curation_passed": F.lit(False), "pre_filtered": F.lit(True)})
    return asked.unionByName(skipped, allowMissingColumns=True)


def report_columns() -> list[Column]:
    """Figures over decided threads: evaluated, pre-filtered, passed, rejected, pass rate in percent (0 for no rows)."""
    passed = F.count_if("curation_passed")
    return [
        F.count(F.lit(1)).alias("total_evaluated"),
        F.count_if("pre_filtered").alias("pre_filtered_promos"),
        passed.alias("curated_passed"),
        F.count_if(~F.col("curation_passed")).alias("curated_rejected"),
        F.coalesce(F.try_divide(F.lit(100.0) * passed, F.count(F.lit(1))), F.lit(0.0)).alias("pass_rate_pct"),
    ]


def curation_report(curated: DataFrame) -> DataFrame:
    """One row of figures over decided threads."""
    return curated.agg(*report_columns())


def topic_counts(curated: DataFrame) -> DataFrame:
    """Rows per topic among those that the model saw."""
    return curated.where(~F.col("pre_filtered")).groupBy("taxonomy_topic").agg(F.count(F.lit(1)).alias("n"))


def audit(curated: DataFrame, rows: int = 20) -> DataFrame:
    """The first curated threads by id with short previews, for reading."""
    preview = lambda c: F.translate(F.substring(c, 1, 140), "\n", " ")
    return curated.orderBy("thread_id").limit(rows).select(
        "thread_id", "title", "is_rag_related", "technical_quality_score", "taxonomy_topic", "topic_confidence", preview("post_body").alias("post"), preview("best_answer_body").alias("answer")
    )


def first_rows(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first rows in the given order; all of them for no or a non-positive limit."""
    return df if not limit or limit <= 0 else df.orderBy(order).limit(limit)
