"""Prompts for reinforcement learning and reasoned texts for supervised fine-tuning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CHATTER_PATTERN, FAILURE_MODES, OTHER_FAILURE, SHORT_CONCEPTS, SYSTEM_PROMPT
from ..functions.matching import terms_in
from ..functions.rewards import distinct_terms
from ..functions.text import NO_SPACE, SPACE, once, or_default, pattern, strip

MIN_PROMPT, MIN_ANSWER, MIN_CLEAN, FIRST = 20, 150, 100, 1500
#: Rows of messages that a worker opens at a time: what it holds beside a batch does not grow with the batch.
ROWS = 200


def user_text(title: Column, body: Column) -> Column:
    title, body = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(body, F.lit("")))
    both = F.concat(F.lit("Title: "), title, F.lit("\n\nTechnical Question / Context:\n"), body)
    return F.when((body != "") & (body != title), both).otherwise(F.concat(F.lit("Technical Question:\n"), title))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt(title: Column, body: Column) -> Column:
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user_text(title, body)))


def prompts(threads: DataFrame, min_chars: int = MIN_PROMPT) -> DataFrame:
    """Prompt records of the threads whose title and body have at least `min_chars` characters."""
    text = lambda c: F.coalesce(c, F.lit(""))
    long = F.length(strip(F.concat(text("title"), F.lit(" "), text("post_body")))) >= min_chars
    return threads.where(long).select(
        text("thread_id").alias("thread_id"),
        prompt(F.col("title"), F.col("post_body")).alias("prompt"),
        or_default(F.col("taxonomy_topic"), "retrieval").alias("taxonomy_topic"),
        text("best_answer_body").alias("reference_answer"),
        text("title").alias("title"),
    )


def clean_answer(c: Column) -> Column:
    """Link texts without targets, no URLs, no sign-off to the end of its line, single spaces."""
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    c = F.regexp_replace(c, r"https?://" + NO_SPACE + "+", "")
    c = F.regexp_replace(c, "(?i)" + pattern(CHATTER_PATTERN) + r"[^\n]*", "")
    return strip(F.regexp_replace(c, SPACE + "+", " "))


def dynamic_think(title: Column, topic: Column, answer: Column, concepts: dict[str, list[str]] = SHORT_CONCEPTS) -> Column:
    """Four reasoning lines on a question; the first three concepts found, in the order of the vocabulary."""
    top = F.slice(terms_in(F.concat(title, F.lit(" "), answer), distinct_terms(concepts)), 1, 3)
    modes = F.create_map(*[F.lit(x) for pair in FAILURE_MODES.items() for x in pair])
    failure = F.coalesce(F.element_at(modes, topic), F.lit(OTHER_FAILURE))
    third = once(
        top,
        lambda m: F.when(F.size(m) > 0, F.concat(F.lit("3. Target Architectural Components: Evaluated mechanisms include "), F.array_join(m, ", "), F.lit("."))).otherwise(
            F.concat(F.lit("3. Solution Strategy: Formulate grounded engineering principles for "), topic, F.lit("."))
        ),
    )
    return F.concat(
        F.lit("<think>\n1. Problem Analysis: The question asks about "),
        topic,
        F.lit(' regarding "'),
        title,
        F.lit('".\n2. Diagnostic Mechanism: Key vulnerability to consider is '),
        failure,
        F.lit(".\n"),
        third,
        F.lit("\n4. Verified Resolution: Structure definitive technical guidance with explicit operational steps.\n</think>"),
    )


def fine_tuning(records: DataFrame, first: int | None = FIRST, order: str = "thread_id", min_answer: int = MIN_ANSWER, min_clean: int = MIN_CLEAN) -> DataFrame:
    """thread_id and the three messages of a reasoned answer. The first `first` long answers by `order` are taken before the check of the cleaned text."""
    long = records.where(F.length("reference_answer") >= min_answer)
    taken = long if first is None else long.orderBy(order).limit(first)
    # an answer is cleaned once: a filter on a plain column would be pushed below it and clean it again
    cleaned = F.filter(F.array(clean_answer(F.col("reference_answer"))), lambda c: F.length(c) >= min_clean)
    ready = taken.where(F.size("prompt") > 0).select("*", F.explode(cleaned).alias("__clean"))
    topic = or_default(F.col("taxonomy_topic"), "retrieval")
    think = dynamic_think(F.coalesce("title", F.lit("")), topic, F.col("__clean"))
    reply = F.concat(think, F.lit("\n<answer>\n"), F.col("__clean"), F.lit("\n</answer>"))
    question = F.element_at("prompt", -1)["content"]
    return ready.select("thread_id", F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", question), message("assistant", reply)).alias("messages"))


def apply_template(records: DataFrame, make_template: Callable[[], Callable[[list[dict]], str]]) -> DataFrame:
    """thread_id and text: messages through a tokenizer's chat template, which a worker builds once. A worker opens `ROWS` rows of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = make_template()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                ids, messages = b.slice(i, ROWS).columns
                texts = [template(ms) for ms in messages.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), pa.array(texts, pa.string())], ["thread_id", "text"])

    return records.select("thread_id", "messages").mapInArrow(run, "thread_id string, text string")
