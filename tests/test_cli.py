import json
import time

import pandas as pd
import pyarrow.parquet as pq
import pytest

from millrace import cli
from millrace.fixed import CONCEPTS
from millrace.operators import threads
from millrace.sources import files, handoff
from millrace.suite import SUITE, VERSION


def scorer():
    return lambda f: pd.DataFrame({"noul": 0.9, "score": 1.5, "choice": ["retrieval" if i % 2 else "other" for i in range(len(f))], "confidence": 0.8}, index=f.index)


def test_stages_in_order(spark, tmp_path):
    posts = [{"id": f"p{k}", "title": f"How to chunk text number {k}?", "selftext": "A question that is long enough.", "author": f"a{k}", "created_utc": 1704067200 + k, "score": k} for k in range(40)]
    comments = [{"id": f"c{k}", "link_id": f"t3_p{k % 30}", "parent_id": f"t3_p{k % 30}", "body": "An answer that is long enough.", "author": "b", "created_utc": 1704067300 + k, "score": k} for k in range(60)]
    (tmp_path / "posts.jsonl").write_text("\n".join(map(json.dumps, [*posts, posts[0]])) + "\n{bad\n")
    (tmp_path / "comments.jsonl").write_text("\n".join(map(json.dumps, comments)))
    d = str(tmp_path)

    def run(stage, **flags):
        report = f"{d}/{stage}.json"
        cli.main([stage, "--report-path", report, *(x for k, v in flags.items() for x in ("--" + k.replace("_", "-"), str(v)))])
        return json.load(open(report))

    got = run("ingest", posts_path=f"{d}/posts.jsonl", comments_path=f"{d}/comments.jsonl", output_parquet=f"{d}/records")
    assert (got["total_records"], got["malformed"], got["duplicate_ids"]) == (100, 1, 1)
    got = run("clean", input_parquet=f"{d}/records", output_parquet=f"{d}/threads")
    assert (got["total_cleaned_threads"], got["threads_with_comments"], got["avg_comments_per_thread"]) == (40, 30, 1.5)
    got = run("curate", input_parquet=f"{d}/threads", output_parquet=f"{d}/good", rejected_parquet=f"{d}/bad", scorer="tests.test_cli:scorer")
    assert (got["curated_passed"], got["curated_rejected"], sum(got["taxonomy_distribution"].values())) == (40, 0, 40)
    got = run("partition", input_parquet=f"{d}/good", output_dir=f"{d}/out")
    assert got["total_records"] == 40 and got["splits"]["train"]["count"] in (31, 32)
    got = run("prepare", train_input=f"{d}/out/splits/split=train", val_input=f"{d}/out/splits/split=val", train_output=f"{d}/t", val_output=f"{d}/v")
    assert got["train"]["total_prompts"] in (31, 32)
    data = handoff.Shards(run("prepare", train_input=f"{d}/out/splits/split=train", val_input=f"{d}/out/splits/split=val", train_output=f"{d}/t", val_output=f"{d}/v", handoff_dir=f"{d}/h") and f"{d}/h/train")
    assert len(data) == got["train"]["total_prompts"] and {r["thread_id"] for r in data} == {r.thread_id for r in spark.read.parquet(f"{d}/t").collect()}
    (tmp_path / "known.jsonl").write_text(json.dumps({"id": "q", "question": "how to chunk TEXT, number 7"}))
    got = run("partition", input_parquet=f"{d}/good", output_dir=f"{d}/apart", benchmark_path=f"{d}/known.jsonl")
    assert (got["total_records"], got["benchmark_leaks_removed"]) == (39, 1)
    assert run("ingest", posts_path=f"{d}/posts.jsonl", comments_path=f"{d}/comments.jsonl", output_parquet=f"{d}/strict", strict=1)["total_records"] == 100
    cli.main(["inspect", "--path", f"{d}/good", "--num-samples", "1"])

    rubric = {"correctness": "c", "grounding": "g", "tradeoffs": "t"}
    items = [{"id": f"q{k}", "category": list(CONCEPTS)[k % 6], "difficulty": "easy", "test_type": "x", "question": "What is hybrid search good for?", "expected_concepts": ["BM25", "reranker", "rank"], "reference_reasoning": "r" * 60, "scoring_rubric": rubric} for k in range(12)]
    (tmp_path / "bench.jsonl").write_text("\n".join(map(json.dumps, items)))
    got = run("benchmark", input_jsonl=f"{d}/bench.jsonl", output_jsonl=f"{d}/bench_out")
    assert (got["total_questions"], got["categories"]) == (12, dict.fromkeys(CONCEPTS, 2))
    answers = [{"id": "q0", "text": "<think>x</think>bm25 and a reranker, rank", "tokens": 10, "seconds": 2.0}, {"id": "q1", "text": "bm25 and rank", "tokens": 30, "seconds": 2.0}]
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, answers)))
    got = run("evaluate", model_id="m", benchmark_path=f"{d}/bench_out", completions_path=f"{d}/answers.jsonl")
    assert (got["overall_concept_recall"], got["overall_tokens_per_second"], got["category_summary"]) == (0.8334, 10.0, {"retrieval": 1.0, "chunking_and_indexing": 0.6667})
    notebook = run("evaluate", form="notebook", model_id="m", benchmark_path=f"{d}/bench_out", completions_path=f"{d}/answers.jsonl")
    assert (notebook["avg_recall_pct"], notebook["avg_speed_tok_s"], notebook["category_recall_pct"]["retrieval"], notebook["results"][1]["missing"]) == (83.34, 10.0, 100.0, ["reranker"])
    trained = run("evaluate", form="trained", model_id="m", benchmark_path=f"{d}/bench_out", completions_path=f"{d}/answers.jsonl", results_path=f"{d}/rows")
    assert (trained["baseline_recall_pct"], trained["delta_improvement_pct"], trained["thinking_trace_pct"]) == (23.08, 60.26, 50.0)
    assert trained["results"][0]["has_think"] and spark.read.json(f"{d}/rows").count() == 2
    built = run("benchmark", output_jsonl=f"{d}/own")
    assert (built["total_questions"], built["version"], sum(built["categories"].values())) == (len(SUITE), VERSION, len(SUITE))
    assert files.read_benchmark(spark, f"{d}/own").count() == len(SUITE)
    assert got["results"][0]["has_thinking_trace"] and got["results"][1]["missing_concepts"] == ["reranker"]


def sleepy_scorer():
    def answer(f):
        time.sleep(0.02 * len(f))
        return pd.DataFrame({"noul": [0.9 if "even" in t else 0.1 for t in f["title"]], "score": 1.5, "choice": "retrieval", "confidence": 0.8}, index=f.index)

    return answer


def bytes_read(spark):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in found if s.getScheme() == "file")


def test_each_stage_reads_its_input_once(spark, tmp_path):
    """Counters come from the pass that writes: nothing is parsed twice, and no output is read again for its figures."""
    d, body = str(tmp_path), "a body that is long enough to be kept, " * 40
    posts = [json.dumps({"id": f"p{k}", "title": f"How to chunk text number {k}?", "selftext": f"{k} {body}", "author": f"a{k}", "created_utc": 1704067200 + k, "score": k % 5 - 1}) for k in range(300)]
    comments = [json.dumps({"id": f"c{k}", "link_id": f"t3_p{k % 200}", "parent_id": f"t3_p{k % 200}", "body": f"{k} {body}", "author": "x_bot" if k % 7 == 0 else "b", "created_utc": 1704067300 + k, "score": k}) for k in range(500)]
    (tmp_path / "posts.jsonl").write_text("\n".join([*posts, *posts[:50], "{bad", "[]"]))
    (tmp_path / "comments.jsonl").write_text("\n".join(comments))
    size = sum((tmp_path / f).stat().st_size for f in ("posts.jsonl", "comments.jsonl"))
    before = bytes_read(spark)
    got = cli.main(["ingest", "--posts-path", f"{d}/posts.jsonl", "--comments-path", f"{d}/comments.jsonl", "--output-parquet", f"{d}/records", "--batch-size", "64"])
    assert size <= bytes_read(spark) - before < 1.2 * size
    assert (got["total_records"], got["posts"], got["comments"], got["malformed"], got["duplicate_ids"]) == (800, 300, 500, 2, 50)
    assert got["date_range"]["min"] == "2024-01-01T00:00:00+00:00"
    groups = [m.row_group(k).num_rows for f in (tmp_path / "records").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(groups) == 800 and max(groups) <= 64
    plan = threads.threads(threads.kept(spark.read.parquet(f"{d}/records"))).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    got = cli.main(["clean", "--input-parquet", f"{d}/records", "--output-parquet", f"{d}/threads"])
    assert (got["total_input_records"], got["filtered_negative_score"], got["filtered_bots"], got["filtered_invalid_body"]) == (800, 60, 72, 0)
    assert got["total_cleaned_threads"] == 240 == spark.read.parquet(f"{d}/threads").count()
    again = threads.thread_report(spark.read.parquet(f"{d}/threads")).first()
    assert round(again.avg_comments_per_thread, 2) == got["avg_comments_per_thread"]


def test_thread_plans_shuffle_once(spark):
    records = spark.createDataFrame([], "community string, id string, parent_id string, post_id string, author string, created_at string, title string, body string, score long, ord long")
    for out in (threads.threads(threads.kept(records)), threads.turns(threads.kept(records)), threads.best_answers(threads.kept(records))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_latency_is_the_models_own(spark, tmp_path):
    names = "thread_id string, title string, post_body string, best_answer_body string"
    rows = [(f"t{k}", "an even title" if k % 2 == 0 else "another title", "body of the post " * 2000 * (k % 2), "an answer") for k in range(40)] + [("promo", "Join our discord", "", "")]
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{tmp_path}/threads")
    got = cli.main(["curate", "--input-parquet", f"{tmp_path}/threads", "--output-parquet", f"{tmp_path}/good", "--rejected-parquet", f"{tmp_path}/bad", "--scorer", "tests.test_cli:sleepy_scorer"])
    assert 20 <= got["inference_stats"]["avg_latency_ms"] < 30
    assert got["inference_stats"]["total_inference_sec"] == pytest.approx(40 * got["inference_stats"]["avg_latency_ms"] / 1000, abs=0.01)
    assert (got["total_evaluated"], got["pre_filtered_promos"], got["curated_passed"], got["curated_rejected"], got["taxonomy_distribution"]) == (41, 1, 20, 21, {"retrieval": 40})
    good, bad = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/bad")
    assert good.count() == 20 and bad.count() == 21 and good.columns == bad.columns and {"curation_passed"} <= set(good.columns) and "__ms" not in good.columns
    quick = cli.main(["curate", "--input-parquet", f"{tmp_path}/threads", "--output-parquet", f"{tmp_path}/all", "--scorer", "tests.test_cli:scorer"])
    assert quick["inference_stats"]["avg_latency_ms"] < 10 and not (tmp_path / "all.rejected").exists() and not (tmp_path / "all.parts").exists()
    none = cli.main(["curate", "--input-parquet", f"{tmp_path}/threads", "--output-parquet", f"{tmp_path}/none", "--rag-threshold", "2", "--scorer", "tests.test_cli:scorer"])
    assert none["curated_passed"] == 0 and spark.read.parquet(f"{tmp_path}/none").count() == 0


def test_reports_lose_nothing(spark, tmp_path):
    """More result rows or categories than a report holds are all written to a file that it names."""
    items = [{"id": f"q{k}", "category": "retrieval", "difficulty": "easy", "test_type": "x", "question": "What?", "expected_concepts": ["BM25"], "reference_reasoning": "r", "scoring_rubric": None} for k in range(1001)]
    (tmp_path / "items.jsonl").write_text("\n".join(map(json.dumps, items)))
    for n in (1000, 1001):
        (tmp_path / f"answers{n}.jsonl").write_text("\n".join(json.dumps({"id": f"q{k}", "text": "bm25", "tokens": 1, "seconds": 1.0}) for k in range(n)))
        report = cli.main(["evaluate", "--model-id", "a/b c", "--benchmark-path", f"{tmp_path}/items.jsonl", "--completions-path", f"{tmp_path}/answers{n}.jsonl"])
        assert report["total_questions_evaluated"] == n
        found = report["results"] if n == 1000 else [r.asDict() for r in spark.read.json(report["results"]).collect()]
        assert sorted(r["id"] for r in found) == sorted(f"q{k}" for k in range(n))
    df = spark.range(3000).selectExpr("concat('c', id % 1500) AS c")
    assert files.counts_map(df, "c", f"{tmp_path}/counts") == {f"c{k}": 2 for k in range(1500)}
    assert files.counts_map(df, "c", f"{tmp_path}/counts", limit=1499) == {"file": f"{tmp_path}/counts"}
    assert {(r.value, r.n) for r in spark.read.json(f"{tmp_path}/counts").collect()} == {(f"c{k}", 2) for k in range(1500)}


def test_many_evaluated_rows_are_not_cached(spark, tmp_path, monkeypatch):
    """Rows with texts are read again by column, so no task reads a cached part whole; what kept them goes."""
    items = [{"id": "q", "category": "a", "difficulty": "easy", "test_type": "t", "question": "x", "expected_concepts": ["bm25", "rerank"], "reference_reasoning": "", "scoring_rubric": {"correctness": "", "grounding": "", "tradeoffs": ""}}]
    (tmp_path / "items.jsonl").write_text("\n".join(map(json.dumps, items)))
    rows = [{"id": "q", "text": "<think>x</think> " + ("bm25" if k % 2 else "rerank bm25"), "tokens": 2, "seconds": 0.5} for k in range(1001)]
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, rows)))
    write, plans = files.write_json_lines, []
    monkeypatch.setattr(files, "write_json_lines", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, path))
    got = cli.main(["evaluate", "--model-id", "m", "--benchmark-path", f"{tmp_path}/items.jsonl", "--completions-path", f"{tmp_path}/answers.jsonl"])
    assert len(plans) == 1 and "InMemoryTableScan" not in plans[0]
    assert (got["total_questions_evaluated"], got["overall_concept_recall"], got["overall_tokens_per_second"]) == (1001, round((501 + 500 * 0.5) / 1001, 4), 4.0)
    assert spark.read.json(got["results"]).count() == 1001
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["answers.jsonl", "answers.jsonl.m.results", "items.jsonl"]
