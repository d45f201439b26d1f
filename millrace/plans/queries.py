"""Registered queries over the operators, by name. Scores are left unrounded here; reports round them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import CONCEPTS, SHORT_CONCEPTS
from ..functions import rewards
from ..functions.text import reasoning, strip, tagged_answer, variant_text
from ..operators import curate, evaluate, ingest, split, threads, training
from ..sources.files import open_objects
from .stages import STAGES
from .views import ASKED, BASE_RECORDS, COMPLETIONS, DECISIONS, ITEM_ROWS, ITEMS, ODD_LINES, RAW_LINES, RECORDS, SHAPES, spread, view


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.kept(view(spark, sf_dir, BASE_RECORDS))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of posts and of comments through the tolerant reader's rules, malformed ones included."""
    lines = view(spark, sf_dir, RAW_LINES).withColumn("line", strip(F.make_valid_utf8("line"))).where("line <> ''")
    part = lambda src: ingest.normalize(open_objects(lines.where(F.col("src") == src).drop("src")), bool(src))
    return ingest.union_records(part(0), part(1))


def ingest_normalize_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).where("src = 0 AND NOT malformed").drop("malformed", "src")


def ingest_normalize_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).where("src = 1 AND NOT malformed").drop("malformed", "src")


def ingest_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).groupBy("src").agg(F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed")).alias("well_formed"))


def ingest_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.distinct_records(raw_records(spark, sf_dir)).select("id", "src", "ord")


def ingest_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_of_each(view(spark, sf_dir, RECORDS), ["id"], ["src", "ord"])


def ingest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.health(ingest_dedup_first(spark, sf_dir))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.reason_counts(view(spark, sf_dir, BASE_RECORDS))


def thread_best_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.best_answers(kept(spark, sf_dir))


def thread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.threads(kept(spark, sf_dir)).drop("conversation_json", "discussion_transcript")


def thread_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.threads(kept(spark, sf_dir)).select("thread_id", "discussion_transcript")


def thread_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.threads(kept(spark, sf_dir)).select("thread_id", "conversation_json")


def thread_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.thread_report(threads.threads(kept(spark, sf_dir)))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.turns(kept(spark, sf_dir))


def promo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DECISIONS).select("thread_id", curate.is_promo(F.col("title"), F.col("post_body")).alias("promo"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, DECISIONS)
    answers = rows.select("thread_id", *curate.DECISION)
    return curate.curate(rows.drop(*curate.DECISION), lambda asked: asked.join(answers, "thread_id"))


def curation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, sf_dir).select("thread_id", "is_rag_related", "technical_quality_score", "taxonomy_topic", "topic_confidence", "curation_passed", "pre_filtered")


def curation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.curation_report(recorded(spark, sf_dir))


def taxonomy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.topic_counts(recorded(spark, sf_dir))


def model_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.states(view(spark, sf_dir, DECISIONS))


def notebook_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.states(view(spark, sf_dir, DECISIONS), stripped=False)


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.audit(recorded(spark, sf_dir).where("curation_passed")).drop("is_rag_related", "technical_quality_score", "topic_confidence")


def length_scorer():
    """A stand-in model: relevance from the body's length, quality from the title's."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["post_body"].str.len()
        return pd.DataFrame({"noul": (n % 100) / 100.0, "score": (frame["title"].str.len() % 3).astype(float), "choice": "retrieval", "confidence": 0.5})

    return answer


def scored_by_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, DECISIONS).drop(*curate.DECISION)
    out = curate.curate(rows, lambda asked: curate.score(asked, length_scorer))
    return out.select("thread_id", "is_rag_related", "technical_quality_score", "taxonomy_topic", "curation_passed")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def split_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(documents(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(split_by_language(spark, sf_dir), "lang")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.overlapping(split_by_language(spark, sf_dir), "doc_id").agg(F.count(F.lit(1)).alias("shared_ids"))


def prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.prompts(view(spark, sf_dir, DECISIONS).withColumnRenamed("choice", "taxonomy_topic"))


def rl_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = lambda k: F.col("prompt")[k]["content"]
    return prompt_records(spark, sf_dir).select("thread_id", content(0).alias("system"), content(1).alias("user"), "taxonomy_topic", "reference_answer", "title")


def sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.fine_tuning(prompt_records(spark, sf_dir), first=None)
    return out.select("thread_id", F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("assistant"))


def sft_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first long answers by id, taken before their cleaned text is judged."""
    return training.fine_tuning(prompt_records(spark, sf_dir), first=150).select("thread_id", F.col("messages")[2]["content"].alias("assistant"))


def plain_template():
    """A stand-in for a tokenizer's chat template."""
    return lambda messages: "".join(f"<|{m['role']}|>\n{m['content']}\n" for m in messages)


def sft_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.apply_template(training.fine_tuning(prompt_records(spark, sf_dir), first=None), plain_template)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, COMPLETIONS)


def reasoning_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace, answer = reasoning(F.col("text"))
    return completions(spark, sf_dir).select("id", trace.alias("trace"), answer.alias("answer"), tagged_answer(F.col("text")).alias("tagged"))


def reward_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = rewards.format_reward(F.col("text"), min_answer=None, other=0.4)
    return completions(spark, sf_dir).select("id", rewards.format_reward(F.col("text")).alias("reward"), short.alias("notebook_reward"))


def reward_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rewards.concept_rewards(completions(spark, sf_dir), F.col("text"), F.col("topic"), {"reward": CONCEPTS, "notebook_reward": SHORT_CONCEPTS}, digits=None)
    return scored.select("id", "reward", "notebook_reward")


def reward_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions(spark, sf_dir).select("id", rewards.grounding_reward(F.col("text"), F.col("reference"), digits=None).alias("reward"))


def reward_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = rewards.repetition_reward(F.col("text"), max_chars=None, min_chars=30, digits=None)
    return completions(spark, sf_dir).select("id", rewards.repetition_reward(F.col("text"), digits=None).alias("reward"), short.alias("notebook_reward"))


def reward_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions(spark, sf_dir).select("id", *(c.alias(k) for k, c in rewards.all_rewards(F.col("text"), F.col("topic"), F.col("reference"), digits=None).items()))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ITEM_ROWS).withColumn("expected_concepts", F.split("concepts", "[|]")).drop("concepts")


def covered(spark: SparkSession, sf_dir: str, match=evaluate.loose_match, **more) -> DataFrame:
    answers = completions(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("item").alias("id"), "text", "tokens", "seconds")
    return evaluate.coverages(answers, items(spark, sf_dir), {"": match} | more, digits=None)


def concept_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(c, "|")
    return covered(spark, sf_dir).select("doc_id", "id", joined("matched").alias("matched"), joined("missing").alias("missing"), "recall")


def strict_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(spark, sf_dir, evaluate.strict_match).select("doc_id", "id", "recall")


def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.question_rows(covered(spark, sf_dir), digits=False)
    return rows.select("doc_id", "has_thinking_trace", "thinking_length_chars", "answer_length_chars", "tokens_per_second")


def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rollup(covered(spark, sf_dir))


def eval_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.category_recall(covered(spark, sf_dir), digits=None)


def eval_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.answer_rows(covered(spark, sf_dir, evaluate.strict_match)).select("doc_id", "id", "thinking_trace", "final_answer", "recall")


def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = covered(spark, sf_dir, strict_=evaluate.strict_match)
    return evaluate.side_by_side(rows, F.col("recall"), F.when(F.col("category") != "retrieval", F.col("strict_recall")))


def trained_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.trained_report(covered(spark, sf_dir, evaluate.strict_match))


def benchmark_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.benchmark_metadata(view(spark, sf_dir, ITEMS))


def benchmark_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rubric = F.struct("correctness", "grounding", "tradeoffs").alias("scoring_rubric")
    rows = view(spark, sf_dir, ITEMS).select("*", F.split("concepts", "[|]").alias("expected_concepts"), F.col("reasoning").alias("reference_reasoning"), rubric)
    return evaluate.benchmark_faults(rows)


def ingest_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which readers of JSON differ, by the strict reader: Python's rules."""
    rows = ingest.normalize(view(spark, sf_dir, ODD_LINES).select("ord", strip("line").alias("line")), False, strict=True)
    return rows.select("ord", F.when(~F.col("malformed"), F.col("id")).alias("id"), F.when(~F.col("malformed"), F.col("score")).alias("score"), "malformed")


def completion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of every shape in one VARIANT column, and the reward that they get."""
    rows = view(spark, sf_dir, SHAPES).select("id", "shape", variant_text(F.parse_json("completion")).alias("text"))
    return rows.select("id", "shape", "text", rewards.format_reward(F.col("text")).alias("reward"))


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, ASKED), view(spark, sf_dir, ITEMS)


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark questions in each split of threads, as titles or bodies."""
    rows, items = asked(spark, sf_dir)
    return split.leaks(split.stratified_split(rows, "taxonomy_topic", "thread_id"), items, ("title", "post_body"))


def isolated_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads that may be trained on."""
    rows, items = asked(spark, sf_dir)
    return split.isolated(rows, items, ("title", "post_body")).select("thread_id", "title")


QUERIES = {
    f.__name__: f
    for f in (
        ingest_normalize_posts, ingest_normalize_comments, ingest_malformed, ingest_distinct_ids, ingest_dedup_first, ingest_health, reject_reasons, thread_best_answer, thread_rows, thread_transcript, thread_conversation, thread_report,
        conversation_turns, promo_filter, curation_decisions, curation_report, taxonomy_distribution, model_states, notebook_states, audit_rows, scored_by_plugin, split_by_language,
        split_distribution, split_leakage, rl_prompts, sft_records, sft_first, sft_text, reasoning_traces, reward_format, reward_concepts, reward_grounding, reward_repetition, reward_composite,
        concept_coverage, strict_coverage, question_rows, eval_rollup, eval_categories, eval_answers, eval_compare, trained_report, benchmark_metadata, benchmark_faults,
        ingest_strict, completion_texts, benchmark_leaks, isolated_threads,
    )
} | STAGES
