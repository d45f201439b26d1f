"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and packing, each over all that came before.

All stages but the last return the columns of `documents`; each stage's result is written and read
again before the next, so a lost executor costs one stage's tasks and not the lineage before it. The last stage, which ends in a
map over texts, writes its result itself: batches for Python are small meanwhile, and the session's setting is as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, language_id, mixing, packing, similarity_join
from millrace.llm.common import discard, materialize
from millrace.plans.views import spread

#: Characters that are tokenized at once: executors that have four stages behind them have less memory to spare.
RUN = 1 << 20


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; undetermined ones go."""
    return language_id.accepted(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return similarity_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length rows of token ids."""
    return materialize(packing.pack_documents(docs, run=RUN), "packs")


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("packed_tokens", packed),
]

#: SQL can't express language ID or tokenization; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        before, written = written, materialize(stage(spark, docs, sf_dir), name)
        docs = written
        if before is not None:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
