"""The command line's stages as queries: derived inputs are written as files, a stage runs on them as from the shell, and what it wrote or reported is returned.

Files lie in the folder of spark.checkpoint.dir, which all executors share; where the session names none, in a temporary one on a local master only.
They go when the driver's JVM exits.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..operators import curate
from ..sources import files, handoff
from .views import ASKED, BASE_RECORDS, COMPLETIONS, DECISIONS, ITEM_ROWS, ITEMS, RAW_LINES, SOUND_ITEMS, view


def run_folder(spark: SparkSession) -> str:
    """A fresh folder for the files of one run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    path = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
    fs, where = files.filesystem(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def run(spark: SparkSession, stage: str, **flags) -> dict:
    """A stage with flags as the shell would give them, in this session."""
    args = cli.parser().parse_args([stage, *(x for k, v in flags.items() for x in ("--" + k.replace("_", "-"), str(v)))])
    return args.run(spark, args)


def stage_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines as files in an `export` folder beside the paths that are asked for; the health report."""
    d, lines = run_folder(spark), view(spark, sf_dir, RAW_LINES)
    for src, name in enumerate(("posts", "comments")):
        lines.where(F.col("src") == src).repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.text(f"{d}/export/{name}.jsonl")
    report = run(spark, "ingest", posts_path=f"{d}/posts.jsonl", comments_path=f"{d}/comments.jsonl", output_parquet=f"{d}/records", batch_size=100)
    counts = ("total_records", "posts", "comments", "deleted", "empty", "malformed", "duplicate_ids")
    written = spark.read.parquet(f"{d}/records").agg(F.count(F.lit(1)).alias("rows"))
    return written.select("rows", *(F.lit(report[k]).cast("long").alias(k) for k in counts), F.lit(report["date_range"]["min"]).alias("min_date"), F.lit(report["date_range"]["max"]).alias("max_date"))


def stage_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a Parquet table; the threads that were written and the report."""
    d = run_folder(spark)
    files.write_table(view(spark, sf_dir, BASE_RECORDS), f"{d}/records")
    report = run(spark, "clean", input_parquet=f"{d}/records", output_parquet=f"{d}/threads")
    names = ("total_input_records", "filtered_pre_min_date", "filtered_bots", "filtered_negative_score", "filtered_invalid_body", "total_cleaned_threads", "threads_with_comments", "standalone_posts")
    means = ("avg_comments_per_thread", "avg_turns_per_conversation")
    rows = spark.read.parquet(f"{d}/threads").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("rows", *(F.lit(report[k]).cast("long").alias(k) for k in names), *(F.lit(float(report[k])).alias(k) for k in means))


def stage_curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads through a plug-in model into two tables."""
    d = run_folder(spark)
    files.write_table(view(spark, sf_dir, DECISIONS).drop(*curate.DECISION), f"{d}/threads")
    run(spark, "curate", input_parquet=f"{d}/threads", output_parquet=f"{d}/passed", rejected_parquet=f"{d}/rejected", scorer="millrace.plans.queries:length_scorer")
    tables = [spark.read.parquet(f"{d}/{k}").select("thread_id", F.lit(k).alias("found_in"), "curation_passed", "taxonomy_topic") for k in ("passed", "rejected")]
    return tables[0].unionByName(tables[1])


def stage_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits without benchmark questions, read back from their folders."""
    d = run_folder(spark)
    files.write_table(view(spark, sf_dir, ASKED), f"{d}/threads")
    files.write_json_lines(view(spark, sf_dir, ITEMS).select("id", "category", "question"), f"{d}/items")
    run(spark, "partition", input_parquet=f"{d}/threads", output_dir=f"{d}/out", benchmark_path=f"{d}/items", question_columns="title,post_body")
    return spark.read.parquet(f"{d}/out/splits").select("thread_id", "split")


def stage_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt tables handed over as shards, read back from the shards."""
    d = run_folder(spark)
    rows = view(spark, sf_dir, DECISIONS).withColumnRenamed("choice", "taxonomy_topic")
    parts = {"train": F.col("noul") < 0.9, "val": F.col("noul") >= 0.9}
    for name, mine in parts.items():
        files.write_table(rows.where(mine), f"{d}/{name}")
    run(spark, "prepare", train_input=f"{d}/train", val_input=f"{d}/val", train_output=f"{d}/p_train", val_output=f"{d}/p_val", handoff_dir=f"{d}/shards")
    shards = [handoff.shard_frame(spark, f"{d}/shards/{k}").withColumn("part", F.lit(k)) for k in parts]
    user = F.element_at("prompt", -1)["content"]
    return shards[0].unionByName(shards[1]).select("part", "thread_id", "title", "reference_answer", "taxonomy_topic", user.alias("user"), F.size("prompt").alias("messages"))


def stage_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound benchmark items as a file, checked and written again; items that were written, by category, difficulty and kind, beside the report's counts."""
    d = run_folder(spark)
    rubric = F.struct("correctness", "grounding", "tradeoffs").alias("scoring_rubric")
    items = view(spark, sf_dir, SOUND_ITEMS).select("id", "category", "difficulty", "test_type", "question", F.split("concepts", "[|]").alias("expected_concepts"), F.col("reasoning").alias("reference_reasoning"), rubric)
    files.write_json_lines(items, f"{d}/items")
    report = run(spark, "benchmark", input_jsonl=f"{d}/items", output_jsonl=f"{d}/built")
    told = spark.createDataFrame([(f, k, n) for f, plural in (("category", "categories"), ("difficulty", "difficulties"), ("test_type", "test_types")) for k, n in report[plural].items()], "field string, value string, reported long")
    built = files.read_benchmark(spark, f"{d}/built").unpivot([], ["category", "difficulty", "test_type"], "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return built.join(told, ["field", "value"], "left")


def stage_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and benchmark as files; recall overall, by category and by difficulty, rounded as the report has it, and the result rows written."""
    d = run_folder(spark)
    items = view(spark, sf_dir, ITEM_ROWS).withColumn("expected_concepts", F.split("concepts", "[|]")).drop("concepts")
    files.write_json_lines(items, f"{d}/items")
    files.write_json_lines(view(spark, sf_dir, COMPLETIONS).select(F.col("item").alias("id"), "text", "tokens", "seconds"), f"{d}/answers")
    report = run(spark, "evaluate", model_id="a/model", benchmark_path=f"{d}/items", completions_path=f"{d}/answers", results_path=f"{d}/results")
    rows = [("overall", "all", report["overall_concept_recall"]), *(("category", k, v) for k, v in report["category_summary"].items()), *(("difficulty", k, v) for k, v in report["difficulty_summary"].items())]
    written = spark.read.json(f"{d}/results").agg(F.count(F.lit(1)).alias("result_rows"))
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "level string, name string, recall double").join(F.broadcast(written))


STAGES = {f.__name__: f for f in (stage_ingest, stage_clean, stage_curate, stage_partition, stage_prepare, stage_benchmark, stage_evaluate)}
