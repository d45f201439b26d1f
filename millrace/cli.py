"""Command line: one subcommand per stage, each reading files and writing files and a JSON report.

python -m millrace.cli STAGE --help
"""

from __future__ import annotations

import argparse
import importlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import suite
from .fixed import BASELINE_RECALL_PCT, ISOLATION_RULE
from .functions import text
from .operators import curate, evaluate, ingest, split, threads, training
from .sources import files, handoff


def load(spec: str):
    """The object that `module:name` stands for."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def totals(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The lines are read once: all figures are observed on the plan that writes.

    What is observed before the shuffle may count twice if its tasks are run again for a lost executor; then the figures of the lines don't fit
    those of the rows written, and the lines are counted in a pass of their own.
    """
    posts, comments = files.resolve_path(spark, a.posts_path), files.resolve_path(spark, a.comments_path)
    lines = ingest.read_records(spark, posts, comments, a.source_name, bool(a.strict))
    read, made = Observation("lines"), Observation("records")
    records = ingest.distinct_records(lines.observe(read, *ingest.line_counts()), copies="__copies")
    files.write_table(records.observe(made, *ingest.health_counts(), F.coalesce(F.sum("__copies"), F.lit(0)).alias("lines")).drop("malformed", "__copies"), a.output_parquet, group_rows=a.batch_size)
    counts, found = read.get, made.get
    if counts["well_formed"] != found["lines"]:
        counts = totals(lines.agg(*ingest.line_counts()))
    return {
        **{k: found[k] for k in ("total_records", "posts", "comments", "deleted")},
        "empty": found["empty_posts"] + found["empty_comments"],
        "malformed": counts["malformed"],
        "duplicate_ids": found["lines"] - found["total_records"],
        "date_range": {"min": found["min_date"], "max": found["max_date"]},
        "output_parquet": a.output_parquet,
        "parquet_size_bytes": files.size_bytes(spark, a.output_parquet),
    }


def run_clean(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The records are read once; reasons and figures are observed on the plan that writes. If the reasons don't add up to the rows of the file (tasks were run again), they are counted in a pass of their own."""
    records = files.read_table(spark, a.input_parquet)
    if "ord" not in records.columns:
        records = records.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    judged, made = Observation("reasons"), Observation("threads")
    rows = threads.kept(records, a.min_date, a.min_body_length, judged)
    files.write_table(threads.threads(rows).observe(made, *threads.report_columns()), a.output_parquet)
    reasons, total = judged.get, records.count()
    if sum(reasons.values()) != total:
        reasons = {r.reason: r.n for r in threads.reason_counts(records, min_date=a.min_date, min_body=a.min_body_length).collect()}
    rounded = {k: round(v, 2) if isinstance(v, float) else v for k, v in made.get.items()}
    names = {"pre_min_date": "filtered_pre_min_date", "bot": "filtered_bots", "negative_score": "filtered_negative_score", "invalid_body": "filtered_invalid_body"}
    return {"total_input_records": total} | {v: reasons.get(k, 0) for k, v in names.items()} | rounded | {"output_parquet": a.output_parquet, "parquet_size_bytes": files.size_bytes(spark, a.output_parquet)}


def run_curate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One pass: the model is asked once a thread, passed and rejected threads are written by one job, figures and the model's own time are observed in it."""
    rows = curate.first_rows(files.read_table(spark, a.input_parquet), "thread_id", a.limit)
    decided = curate.curate(rows, lambda asked: curate.score(asked, load(a.scorer), latency="__ms"), a.rag_threshold, a.min_quality_score)
    made = Observation("curation")
    observed = decided.observe(made, *curate.report_columns(), F.coalesce(F.sum("__ms"), F.lit(0.0)).alias("ms"))
    files.write_parts(observed.drop("__ms", "pre_filtered"), "curation_passed", {True: a.output_parquet, False: a.rejected_parquet or f"{a.output_parquet}.rejected"})
    found = dict(made.get)
    spent, asked = found.pop("ms"), found["total_evaluated"] - found["pre_filtered_promos"]
    found["pass_rate_pct"] = round(found["pass_rate_pct"], 2)
    both = spark.read.parquet(a.output_parquet).select("taxonomy_topic").union(spark.read.parquet(a.rejected_parquet or f"{a.output_parquet}.rejected").select("taxonomy_topic"))
    topics = files.counts_map(both, "taxonomy_topic", f"{a.output_parquet}.topics")
    promo = curate.PROMO_DECISION[2]
    if found["pre_filtered_promos"] and promo in topics:  # no question was asked about these
        topics[promo] -= found["pre_filtered_promos"]
    if not a.rejected_parquet:
        files.remove(spark, f"{a.output_parquet}.rejected")
    return found | {
        "thresholds": {"rag_relevance_min_prob": a.rag_threshold, "technical_quality_min_score": a.min_quality_score},
        "taxonomy_distribution": {k: n for k, n in topics.items() if n},
        "inference_stats": {"device": a.device, "avg_latency_ms": round(spent / asked, 2) if asked else 0.0, "total_inference_sec": round(spent / 1000, 2)},
        "output_parquet": a.output_parquet,
        "parquet_size_bytes": files.size_bytes(spark, a.output_parquet),
    }


def run_partition(spark: SparkSession, a: argparse.Namespace) -> dict:
    """With a benchmark, rows that ask one of its questions are left out of all splits."""
    ratios = {"train": a.train_ratio, "val": a.val_ratio, "test": a.test_ratio}
    whole = df = files.read_table(spark, a.input_parquet)
    if a.benchmark_path:
        df = split.isolated(df, files.read_benchmark(spark, a.benchmark_path), tuple(a.question_columns.split(",")))
    files.write_table(split.stratified_split(df, a.stratify_col, a.key, ratios, a.seed), f"{a.output_dir}/splits", split_by="split")
    out = {}
    for name in ratios:
        path = f"{a.output_dir}/splits/split={name}"
        part = spark.read.schema(df.schema).parquet(path) if files.exists(spark, path) else df.limit(0)
        out[name] = {"count": part.count(), "file": path, "size_bytes": files.size_bytes(spark, path), "taxonomy_distribution": files.counts_map(part, a.stratify_col, f"{a.output_dir}/{name}.counts")}
    total = sum(x["count"] for x in out.values())
    for x in out.values():
        x["pct"] = round(100 * x["count"] / total, 2) if total else 0.0
    return {"seed": a.seed, "total_records": total, "benchmark_leaks_removed": whole.count() - total if a.benchmark_path else None, "splits": out}


def run_prepare(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Prompt tables, and with a hand-off folder the same rows as shards that a trainer reads by number."""
    out = {}
    for name, source, target in (("train", a.train_input, a.train_output), ("val", a.val_input, a.val_output)):
        files.write_table(training.prompts(files.read_table(spark, source)), target)
        made = spark.read.parquet(target)
        if a.handoff_dir:
            handoff.write_shards(made, f"{a.handoff_dir}/{name}")
        out[name] = {"source_file": source, "output_file": target, "total_prompts": made.count(), "topic_distribution": files.counts_map(made, "taxonomy_topic", f"{target}.topics")}
    return out


def run_benchmark(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Items of a file, or the package's own, checked and written with their counts."""
    items = files.read_benchmark(spark, a.input_jsonl) if a.input_jsonl else evaluate.suite(spark)
    faults = totals(evaluate.benchmark_faults(items))
    if any(faults.values()):
        raise ValueError(f"the benchmark has faults: {faults}")
    files.write_json_lines(items.coalesce(1), a.output_jsonl)
    counts = {plural: files.counts_map(items, name, f"{a.output_jsonl}.{plural}") for name, plural in (("category", "categories"), ("difficulty", "difficulties"), ("test_type", "test_types"))}
    named = {"benchmark_name": a.benchmark_name, "version": a.benchmark_version, "created_at_utc": datetime.now(UTC).isoformat()}
    return named | {"total_questions": items.count()} | counts | {"isolation_rule": ISOLATION_RULE, "output_file": a.output_jsonl}


#: Result rows that a report holds itself; more are written beside the completions, and the report names the file.
REPORT_ROWS = 1000


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Completions are JSON lines of id, text, tokens, seconds, made by any model. The form is full, notebook (percent, loose match) or trained (percent, strict match, gain over a baseline)."""
    items = curate.first_rows(files.read_benchmark(spark, a.benchmark_path), "id", a.sample_limit)
    answers = spark.read.schema("id string, text string, tokens long, seconds double").json(a.completions_path)
    covered = evaluate.coverage(answers, items, evaluate.strict_match if a.form == "trained" else evaluate.loose_match)
    rows = evaluate.question_rows(evaluate.answer_rows(covered).drop("thinking_trace"))
    many = answers.join(items.select("id"), "id").limit(REPORT_ROWS + 1).count() > REPORT_ROWS
    path = a.results_path or (f"{a.completions_path}.{text.slug(a.model_id)}.results" if many else None)
    # many rows are kept as Parquet meanwhile: what is read of them again is mostly narrow, and a cached part would be read whole
    kept = f"{path}.rows" if many else None
    if many:
        files.write_table(rows, kept)
    rows = spark.read.schema(rows.schema).parquet(kept) if many else rows.persist()
    summary = evaluate.rollup(rows).collect()
    overall = next((r for r in summary if r.level == "overall"), None)
    recall, speed = (overall.avg_recall or 0.0, overall.tokens_per_second) if overall else (0.0, 0.0)
    level = lambda k, scale, digits: {r.name: round(scale * r.avg_recall, digits) for r in summary if r.level == k}
    percent = round(100 * recall, 2)
    names = {"matched": "matched_concepts", "missing": "missing_concepts", "recall": "concept_recall", "tokens": "generated_tokens"}
    if a.form == "notebook":
        shown = rows.select("id", "category", "recall", "tokens", F.col("tokens_per_second").alias("tok_per_sec"), F.col("has_thinking_trace").alias("has_think"), "matched", "missing")
        report = {"model_id": a.model_id, "avg_recall_pct": percent, "avg_speed_tok_s": round(speed, 2), "category_recall_pct": level("category", 100, 1)}
    elif a.form == "trained":
        shown = rows.withColumnsRenamed({"matched": "matched_concepts", "missing": "missing_concepts", "has_thinking_trace": "has_think", "text": "raw_completion"})
        trained = totals(evaluate.trained_report(covered, a.baseline_pct))
        report = {
            "model_id": a.model_id,
            "baseline_recall_pct": a.baseline_pct,
            "post_trained_recall_pct": percent,
            "delta_improvement_pct": round(percent - a.baseline_pct, 2),
            "thinking_trace_pct": round(trained["thinking_trace_pct"], 2),
            "category_summary": level("category", 100, 1),
        }
    else:
        shown = rows.withColumnsRenamed(names).drop("text", "seconds", "final_answer")
        report = {
            "model_id": a.model_id,
            "total_questions_evaluated": overall.questions if overall else 0,
            "overall_concept_recall": round(recall, 4),
            "total_tokens_generated": (overall.total_tokens or 0) if overall else 0,
            "overall_tokens_per_second": round(speed, 2),
            "category_summary": level("category", 1, 4),
            "difficulty_summary": level("difficulty", 1, 4),
        }
    if path:
        files.write_json_lines(shown, path)
    report["results"] = path if many else [r.asDict(recursive=True) for r in shown.orderBy("id").collect()]
    if many:
        files.remove(spark, kept)
    else:
        rows.unpersist()
    return report


def run_inspect(spark: SparkSession, a: argparse.Namespace) -> dict:
    curate.audit(files.read_table(spark, a.path), a.num_samples).show(a.num_samples, truncate=False, vertical=True)
    return {}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    stages = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, run, **flags) -> None:
        p = stages.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--report-path")
        for flag, default in flags.items():
            required = default is ...
            p.add_argument("--" + flag.replace("_", "-"), required=required, default=None if required else default, type=str if required or default is None else type(default))

    stage("ingest", run_ingest, posts_path=..., comments_path=..., output_parquet=..., source_name="community_forum", batch_size=50_000, strict=0)
    stage("clean", run_clean, input_parquet=..., output_parquet=..., min_date=threads.MIN_DATE, min_body_length=threads.MIN_BODY)
    stage("curate", run_curate, input_parquet=..., output_parquet=..., rejected_parquet=None, scorer=..., device="cpu", limit=0, rag_threshold=curate.RELEVANCE, min_quality_score=curate.QUALITY)
    stage("partition", run_partition, input_parquet=..., output_dir=..., train_ratio=0.8, val_ratio=0.1, test_ratio=0.1, seed=42, stratify_col="taxonomy_topic", key="thread_id", benchmark_path=None, question_columns="title")
    stage("prepare", run_prepare, train_input=..., val_input=..., train_output=..., val_output=..., handoff_dir=None)
    stage("benchmark", run_benchmark, input_jsonl=None, output_jsonl=..., benchmark_name=suite.NAME, benchmark_version=suite.VERSION)
    stage("evaluate", run_evaluate, model_id=..., benchmark_path=..., completions_path=..., sample_limit=0, form="full", baseline_pct=BASELINE_RECALL_PCT, results_path=None)
    stage("inspect", run_inspect, path=..., num_samples=20)
    return top


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"millrace-{args.stage}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    report = args.run(spark, args)
    return files.write_report(report, args.report_path, spark) if args.report_path else report


if __name__ == "__main__":
    main()
