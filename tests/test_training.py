import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.fixed import CONCEPTS, SHORT_CONCEPTS
from millrace.functions import kernels, matching, rewards, text
from millrace.operators import evaluate, split, training
from millrace.suite import SUITE


def value(spark, column, **inputs):
    schema = ", ".join(f"{k} string" for k in inputs) or "x string"
    return spark.createDataFrame([tuple(inputs.values()) or ("",)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("s", ["", "  a  b ", " x y　", "\x1ca\x85b", "café² naïve_1 - b–c", "ÀÉ́ x", "\t\n"])
def test_python_strings(spark, s):
    import re

    x = F.col("x")
    assert value(spark, text.strip(x), x=s) == s.strip()
    assert value(spark, text.tokens(x), x=s) == s.split()
    if "́" not in s:  # combining marks are no word characters there and letters' parts here
        assert value(spark, text.normalize(x), x=s) == re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", " ", s.lower())).strip()


def test_reasoning(spark):
    trace, answer = text.reasoning(F.col("x"))
    both = F.struct(trace.alias("a"), answer.alias("b"))
    assert value(spark, both, x="<think> a\nb </think> c <think>d</think> ") == ("a\nb", "c")
    assert value(spark, both, x=" c ") == (None, "c")
    assert value(spark, both, x="<think></think>c") == ("", "c")
    assert value(spark, text.tagged_answer(F.col("x")), x="<think>a</think>x<answer> b </answer>") == "b"
    assert value(spark, text.tagged_answer(F.col("x")), x="<think>a</think> b ") == "b"
    assert value(spark, text.tagged_answer(F.col("x")), x="<answer>b</answer>") == "<answer>b</answer>"
    assert text.slug("org/Model-1.5B") == "org_Model-1_5B"
    messages = spark.sql("SELECT array(named_struct('role','a','content','x'), named_struct('role','b','content',null)) AS m")
    assert messages.select(text.message_text(F.col("m")).alias("v")).first().v == "x\n"


THINK = "<think>" + "t" * 50 + "</think>"


@pytest.mark.parametrize(
    ("completion", "want", "notebook"),
    [
        (THINK + "<answer>" + "a" * 30 + "</answer>", 1.0, 1.0), (THINK + "a" * 30, 0.8, 0.8), (THINK + "a" * 29, 0.5, 0.8), ("<think>short</think>" + "a" * 40, 0.0, 0.4),
        ("</think>" + "a" * 60 + "<think>", 0.0, 0.4), ("<think>" + "a" * 60, -0.5, -0.5), ("plain", -1.0, -1.0),
    ],
)
def test_format(spark, completion, want, notebook):
    assert value(spark, rewards.format_reward(F.col("x")), x=completion) == want
    assert value(spark, rewards.format_reward(F.col("x"), min_answer=None, other=0.4), x=completion) == notebook


def test_concepts(spark):
    score = rewards.concept_reward(F.col("x"), F.col("t"))
    assert value(spark, score, x="nothing", t="retrieval") == 0.0
    assert value(spark, score, x="use BM25 and graph-rag", t="retrieval") == pytest.approx(0.6)
    assert value(spark, score, x="use BM25 and graph-rag", t="unknown") == pytest.approx(0.4)
    assert value(spark, score, x="<think>bm25</think> bm25", t=None) == pytest.approx(0.35)
    assert value(spark, score, x="<think>bm25</think> bm25", t="unknown") == pytest.approx(0.2)
    assert value(spark, score, x="bi encoder", t="retrieval") == 0.0
    assert value(spark, score, x=" ".join(CONCEPTS["retrieval"]), t="retrieval") == 2.0
    assert sum(map(len, CONCEPTS.values())) == 91 and len({t for v in CONCEPTS.values() for t in v}) == 90
    assert sum(map(len, SHORT_CONCEPTS.values())) == 68


def test_grounding(spark):
    score = rewards.grounding_reward(F.col("x"), F.col("r"))
    assert value(spark, score, x="anything", r=None) == 0.5
    assert value(spark, score, x="anything", r="is it the one to") == pytest.approx(0.0)
    assert value(spark, score, x="anything", r="is it to") == 0.5
    assert value(spark, score, x="chunk overlap matters", r="Chunk overlap matters!") == 1.0
    assert value(spark, score, x="", r="chunk overlap") == 0.0
    assert value(spark, score, x="chunk alpha beta", r="chunk overlap") == pytest.approx(0.5 * 0.25 + 0.5 * 0.75, abs=1e-3)


def test_repetition(spark):
    score = rewards.repetition_reward(F.col("x"))
    healthy = " ".join(f"word{i}" for i in range(40))
    assert value(spark, score, x=healthy) == 0.0
    assert value(spark, score, x="short") == -1.5
    assert value(spark, score, x="a" * 3999) == pytest.approx(-0.499)
    assert value(spark, score, x="a" * 9000) == -1.0
    assert value(spark, score, x=healthy + " www.x.y Cheers") == pytest.approx(-0.7)
    assert value(spark, score, x=healthy + " cheersy") == 0.0
    loop = "one two three four " * 10
    assert value(spark, score, x=loop) == pytest.approx(-round((0.65 - 4 / 37) * 2, 3), abs=1e-3)
    assert value(spark, rewards.repetition_reward(F.col("x"), max_chars=None, min_chars=30), x="a" * 9000) == 0.0
    df = spark.createDataFrame([(healthy, "retrieval", None)], "x string, t string, r string")
    row = df.withColumns(rewards.all_rewards(F.col("x"), F.col("t"), F.col("r"))).first()
    assert (row.reward_format, row.reward_concepts, row.reward_grounding, row.reward_repetition) == (-1.0, 0.0, 0.5, 0.0)


def test_split(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 100, "a").when(F.col("id") < 199, "b").when(F.col("id") < 203, None).otherwise("c").alias("s"))
    out = split.stratified_split(df, "s", "id")
    got = {(r.split, r.s): r.n for r in split.split_counts(out, "s").collect()}
    assert [got.get((k, "a")) for k in ("train", "val", "test")] == [80, 10, 10]
    assert [got.get((k, "b")) for k in ("train", "val", "test")] == [79, 9, 11]
    assert [got.get((k, None)) for k in ("train", "val", "test")] == [3, None, 1]
    assert out.count() == 300 and evaluate.overlapping(out, "id").count() == 0
    again = split.stratified_split(df.repartition(7), "s", "id")
    assert out.exceptAll(again).count() == 0
    assert split.stratified_split(df, "s", "id", seed=7).exceptAll(out).count() > 0
    assert split.stratified_split(df.where("false"), "s", "id").count() == 0
    with pytest.raises(ValueError):
        split.stratified_split(df, "s", "id", {"a": 0.5, "b": 0.4})


def test_prompts_and_fine_tuning(spark):
    answer = "See [the guide](http://a.b/c) at https://x.y/z for hybrid-search. " + "Reranker words that fill the answer. " * 5 + "\nHope this helps you\nlast line"
    rows = [("t1", "Chunk size", "Which one is best for code?", answer, None), ("t2", "Hi", "", "", "retrieval"), ("t3", "Only a title that is long", None, "x" * 160, "other")]
    df = spark.createDataFrame(rows, "thread_id string, title string, post_body string, best_answer_body string, taxonomy_topic string")
    out = {r.thread_id: r for r in training.prompts(df).collect()}
    assert set(out) == {"t1", "t3"}
    assert [m.role for m in out["t1"].prompt] == ["system", "user"] and out["t1"].taxonomy_topic == "retrieval"
    assert out["t1"].prompt[1].content == "Title: Chunk size\n\nTechnical Question / Context:\nWhich one is best for code?"
    assert out["t3"].prompt[1].content == "Technical Question:\nOnly a title that is long"
    tuned = training.fine_tuning(training.prompts(df))
    reply = {r.thread_id: r.messages[2].content for r in tuned.collect()}
    assert "See the guide at for hybrid-search." in reply["t1"] and "last line" in reply["t1"] and "Hope" not in reply["t1"] and "http" not in reply["t1"]
    assert "include reranker" in reply["t1"] and reply["t1"].startswith('<think>\n1. Problem Analysis: The question asks about retrieval regarding "Chunk size".')
    assert "Formulate grounded engineering principles for other." in reply["t3"]
    assert training.fine_tuning(training.prompts(df), first=1).count() == 1
    joined = training.apply_template(tuned, lambda: lambda ms: "|".join(m["role"] for m in ms)).first()
    assert joined.text == "system|user|assistant"


def test_variants_and_coverage(spark):
    got = lambda c: set(value(spark, evaluate.variants(F.col("x")), x=c))
    assert got("BM25 / sparse retrieval") == {"bm25", "sparse retrieval"}
    assert {"reciprocal rank fusion", "rrf"} <= got("Reciprocal Rank Fusion (RRF)")
    assert got("bi-encoder") == {"bi-encoder", "bi encoder", "biencoder"}
    assert got("a or bc") == {"bc"}
    items = spark.createDataFrame([("q", ["BM25 / sparse retrieval", "Reciprocal Rank Fusion (RRF)", "bi-encoder", "ann"], "c", "d"), ("e", [], "c", "d")], "id string, expected_concepts array<string>, category string, difficulty string")
    answers = spark.createDataFrame(
        [("q", "BM25 with RRF, a bi encoder and ANN.", 10, 2.0), ("q", "érrf announces bm25", 30, 2.0), ("e", "x", 5, 0.0)], "id string, text string, tokens long, seconds double"
    )
    rows = evaluate.coverage(answers, items)
    found = {r.text: r for r in rows.collect()}
    assert found["BM25 with RRF, a bi encoder and ANN."].recall == 1.0
    assert found["érrf announces bm25"].matched == ["BM25 / sparse retrieval"] and found["érrf announces bm25"].recall == 0.25
    assert found["x"].recall == 0.0
    shown = {r.text: r for r in evaluate.question_rows(rows).collect()}
    assert shown["BM25 with RRF, a bi encoder and ANN."].tokens_per_second == 5.0 and shown["x"].tokens_per_second == 0.0
    overall = evaluate.rollup(rows).where("level = 'overall'").first()
    assert overall.questions == 3 and overall.tokens_per_second == pytest.approx(45 / 4)
    trained = evaluate.trained_report(evaluate.coverage(answers, items, evaluate.strict_match)).first()
    assert trained.delta_pct == pytest.approx(trained.recall_pct - 23.08)
    assert evaluate.answer_rows(rows).where("thinking_trace = ''").count() == 3
    assert evaluate.compare(evaluate.rollup(rows), evaluate.rollup(rows.where("false"))).first().right_pct == 0.0


def test_benchmark_checks(spark):
    whole, part = ("right", "sourced", "weighed"), ("right", None, "weighed")
    rows = [("a", "retrieval", "d", "t", "A question that is long enough", ["x", "y", "z"], "r" * 51, whole), ("a", "", "d", "t", "short", ["x"], " r ", part)]
    found = evaluate.benchmark_faults(spark.createDataFrame(rows, schemas.BENCHMARK)).first()
    assert found.asDict() == {
        "repeated_ids": 1, "blank_labels": 1, "short_questions": 1, "few_concepts": 1, "short_reasoning": 1, "blank_rubrics": 1, "missing_categories": 5, "foreign_categories": 1, "missing_items": 8,
    }
    items = evaluate.suite(spark)
    assert items.count() == len(SUITE) >= 10 and not any(evaluate.benchmark_faults(items).first())
    assert {(r.field, r.value): r.n for r in evaluate.benchmark_metadata(items).collect()}[("category", "retrieval")] == 2


def test_trainer_callables(spark):
    texts = ["<think>" + "t" * 50 + "</think> use bm25 " + "a" * 30, {"role": "assistant", "content": "bm25"}, [{"content": "good luck"}, "x"]]
    functions = kernels.callables()
    assert [f.__name__ for f in functions] == ["reward_format", "reward_concepts", "reward_grounding", "reward_repetition"]
    assert functions[0](texts) == [0.8, -1.0, -1.0]
    assert functions[1](texts, taxonomy_topic=["retrieval"] * 3, other=1) == [0.4, 0.4, 0.0]
    assert functions[2](texts, reference_answer=["", None, "good luck"])[:2] == [0.5, 0.5]
    assert text.completion_text(texts[2]) == "good luck\nx" and text.completion_text({"role": "x"}) == ""


def test_presets_are_searched_together(spark):
    df = spark.createDataFrame([("<think>bm25 and docker</think> dot product, graph rag", t) for t in ("retrieval", "tooling_and_frameworks", None, "unknown")], "x string, t string")
    got = rewards.concept_rewards(df, F.col("x"), F.col("t"), {"long": CONCEPTS, "short": SHORT_CONCEPTS}).collect()
    alone = df.select(rewards.concept_reward(F.col("x"), F.col("t")).alias("a"), rewards.concept_reward(F.col("x"), F.col("t"), SHORT_CONCEPTS).alias("b")).collect()
    assert [(r.long, r.short) for r in got] == [tuple(r) for r in alone] and len({r.long for r in got}) > 2


def test_terms_are_found_as_one_by_one(spark):
    import random
    import re

    rng = random.Random(4)
    terms = ["ab", "a-b", "b a", "abc", "c", "-", "ab-c d", "é", "cd", ""]
    texts = ["".join(rng.choice("abcdé- .\n\t'") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "<think>a-b</think> cd", "<think>ab"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    got = df.select("k", matching.concepts_in(F.col("x"), terms).alias("c"), matching.terms_in(F.col("x"), terms).alias("t")).collect()
    for r in got:
        said = texts[r.k] or ""
        plain = matching.normal(said)
        assert plain == re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", " ", said.lower())).strip()
        assert r.c.found == [t for t in terms if t in plain or t in plain.replace("-", " ")]
        block = re.search(r"<think>(.*?)</think>", said, re.DOTALL)
        assert r.c.planned == ([t for t in terms if t in matching.normal(block[1])or t in matching.normal(block[1]).replace("-", " ")] if block else [])
        assert r.t == [t for t in terms if t in re.sub(r"[^\w\s-]", " ", said.lower())]
    assert matching.Vocabulary(()).found("x") == []


def test_an_answer_is_cleaned_once(spark):
    records = spark.createDataFrame([], schemas.PROMPTS)
    plan = training.fine_tuning(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 4
    df = spark.createDataFrame([], "x string, t string, r string")
    plan = df.withColumns(rewards.all_rewards(F.col("x"), F.col("t"), F.col("r")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4


def test_variants_of_completions(spark):
    import json

    cases = ["text", {"role": "a", "content": "x"}, [{"content": "x"}, "y", {"role": "z"}], {"role": "z"}, [], [1, True, None, 2.5, "é\n"], {"content": None}, {"content": 3}, ["a", {"content": False}]]
    df = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cases)] + [(99, None)], "k int, j string")
    got = {r.k: r.x for r in df.select("k", text.variant_text(F.parse_json("j")).alias("x")).collect()}
    assert got == {k: text.completion_text(c) for k, c in enumerate(cases)} | {99: None}


def test_isolation(spark):
    items = spark.createDataFrame([("What is RRF?",), ("what is  rrf",), (None,), ("?!",)], "question string")
    rows = spark.createDataFrame([(1, " WHAT is... RRF!", "x"), (2, "What is RRF good for?", "what is rrf"), (3, None, None), (4, "?", " "), (5, "other", "thing"), (5, "other", "thing")], "id int, title string, body string")
    assert sorted(r.id for r in split.isolated(rows, items).collect()) == [2, 3, 4, 5, 5]
    assert sorted(r.id for r in split.isolated(rows, items, ("title", "body")).collect()) == [3, 4, 5, 5]
    assert split.isolated(rows, items).columns == rows.columns and split.isolated(rows, items.where("false")).count() == 6
    parts = rows.withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test"))
    assert {(r.split, r.n, r.leaks) for r in split.leaks(parts, items, ("title", "body")).collect()} == {("train", 2, 2), ("test", 4, 0)}


def test_a_template_opens_few_rows_of_a_batch_at_a_time(spark):
    class Records:
        """Hands over the map itself."""

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    opened = []
    run = training.apply_template(Records(), lambda: lambda ms: opened.append(ms) or ms[0]["content"])
    message = pa.struct([("role", pa.string()), ("content", pa.string())])
    rows = [[{"role": "user", "content": f"c{k}"}] for k in range(1001)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{k}" for k in range(1001)]), pa.array(rows, pa.list_(message))], ["thread_id", "messages"])
    got = []
    for b in run(iter([batch])):
        assert b.num_rows <= training.ROWS and len(opened) - len(got) <= training.ROWS
        got += zip(*(c.to_pylist() for c in b.columns), strict=True)
    assert got == [(f"t{k}", f"c{k}") for k in range(1001)]
