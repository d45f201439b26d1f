import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import curate, threads

COLUMNS = "community string, id string, parent_id string, post_id string, author string, created_at string, title string, body string, score long, ord long"
LONG = "a body that is long enough"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def record(id_, author="u", body=LONG, score=1, parent="", post=None, title="", at="2024-01-01", ord_=0):
    return ("rag", id_, parent, post or id_, author, at, title, body, score, ord_)


def test_reasons(spark):
    rows = [
        record("old", at="2022-12-31", title="Title"), record("undated", at="", title="Title"), record("bot", author=" AutoModerator "), record("bot2", author="x_Bot"),
        record("notbot", author="robot"), record("neg", score=-1), record("zero", score=0), record("short", body="too short body"), record("titled", body="", title="Short"),
        record("gone", parent="t3_a", body="[Removed]", title="A title counts for posts only"), record("fine", parent="t3_a", author="[deleted]"), record("none", author=None, body=None),
    ]
    got = {r.id: r.reject_reason for r in threads.with_reason(frame(spark, rows)).collect()}
    assert got == {
        "old": "pre_min_date", "undated": "pre_min_date", "bot": "bot", "bot2": "bot", "notbot": None, "neg": "negative_score", "zero": None,
        "short": "invalid_body", "titled": None, "gone": "invalid_body", "fine": None, "none": "invalid_body",
    }


@pytest.fixture
def thread(spark):
    rows = [
        record("p", "op", "My body is long enough", 3, title="How to chunk?"),
        record("lead", "op", "  leading words of the author ", 9, "t3_p", "p", at="2024-01-02", ord_=1),
        record("a", "x", 'first "answer" with enough text', 25, "t3_p", "p", at="2024-01-03", ord_=2),
        record("b", "[deleted]", "second answer with enough text\n", 25, "t3_p", "p", at="2024-01-03", ord_=3),
        record("c", "op", "thanks for all of the answers", 5, "t3_p", "p", at="2024-01-04", ord_=4),
        record("orphan", "x", "a comment without any post", 99, "t3_q", "q", ord_=5),
        record("alone", "[deleted]", "", 0, title="No comments here"),
        record("p", "op2", "a later row with the same id", 4, title="How to chunk twice?", ord_=9),
    ]
    return threads.kept_parts(frame(spark, rows))


def test_threads(thread):
    rows = {r.thread_id: r for r in threads.threads(*thread).collect()}
    assert set(rows) == {"p", "alone"}
    p = rows["p"]
    assert p.title == "How to chunk twice?" and p.comment_count == 4
    assert (p.best_answer_id, p.best_answer_score, p.best_answer_author) == ("a", 25, "x")
    messages = json.loads(p.conversation_json)
    assert [m["role"] for m in messages] == ["user", "assistant"] and p.conversation_turns == 2
    assert json.dumps(messages, ensure_ascii=False) == p.conversation_json
    alone = rows["alone"]
    assert (alone.best_answer_id, alone.best_answer_score, alone.conversation_turns, alone.total_char_count, alone.total_word_count) == ("", 0, 1, 18, 3)
    assert alone.discussion_transcript.startswith("# No comments here\n**Author:** [deleted] | **Score:** 0 | **Date:** 2024-01-01\n\n*(No body text)*\n\n---\n## Discussion & Solutions\n")


def test_leading_author_is_merged(thread, spark):
    posts, comments = thread
    posts = posts.withColumn("author", F.lit("op"))
    got = {(r.thread_id, r.turn): (r.role, r.content) for r in threads.turns(posts, comments).collect()}
    assert got[("p", 0)] == ("user", "How to chunk twice?\n\na later row with the same id\n\nleading words of the author")
    assert got[("p", 1)] == ("assistant", 'first "answer" with enough text\n\nsecond answer with enough text')
    assert got[("p", 2)][0] == "user"
    folded = json.loads(next(r for r in threads.threads(posts, comments).collect() if r.thread_id == "p").conversation_json)
    assert [m["content"] for m in folded] == [got[("p", k)][1] for k in range(3)]


def test_promo(spark):
    cases = [
        ("Join  our Discord server", LONG, True), ("discords", LONG, False), ("a", "telegram me", True), ("telegram_bot", LONG, False), ("éWhatsApp", LONG, False),
        ("WhatsApp!", LONG, True), ("x", " https://a.b one two", True), ("x", "https://a.b " + "w " * 10, False), ("x", "see http://a.b now", True),
        ("x", "one two three four five six http://a.b", False), ("x", None, False), (None, "Monthly recap", True), ("x", "HTTPS://a.b", False),
    ]
    df = spark.createDataFrame(cases, "title string, body string, want boolean")
    assert [r for r in df.select("*", curate.is_promo(F.col("title"), F.col("body")).alias("got")).collect() if r.got != r.want] == []


def scorer():
    import pandas as pd

    return lambda f: pd.DataFrame({"noul": [0.95 if "chunk" in t.lower() else 0.15 for t in f["title"]], "score": [1.7 if "chunk" in t.lower() else 0.2 for t in f["title"]], "choice": [None] * len(f)})


def test_curation(spark):
    rows = [("t1", "Chunk size?", "b" * 700, "ans"), ("t2", "Hello", LONG, ""), ("t3", "Join our discord", "", "")]
    df = spark.createDataFrame(rows, "thread_id string, title string, post_body string, best_answer_body string")
    state = {r.thread_id: r for r in curate.states(df, 50).collect()}
    assert len(state["t1"].post_body) == 50 and state["t2"].best_answer is None
    out = curate.curate(df, lambda asked: curate.score(asked, scorer))
    got = {r.thread_id: r for r in out.collect()}
    assert got["t1"].curation_passed and not got["t2"].curation_passed
    assert (got["t3"].taxonomy_topic, got["t3"].topic_confidence, got["t3"].is_rag_related) == ("meta_or_promo", 0.99, 0.05)
    assert (got["t1"].taxonomy_topic, got["t1"].topic_confidence) == ("other", 0.0)
    report = curate.curation_report(out).first()
    assert (report.total_evaluated, report.pre_filtered_promos, report.curated_passed, report.curated_rejected) == (3, 1, 1, 2)
    assert curate.curation_report(out.where("false")).first().pass_rate_pct == 0.0
    assert {r.taxonomy_topic: r.n for r in curate.topic_counts(out).collect()} == {"other": 2}
    assert curate.audit(out, 2).count() == 2
    assert curate.first_rows(df, "thread_id", 0).count() == 3 and curate.first_rows(df, "thread_id", 1).first().thread_id == "t1"


def test_thresholds_use_unrounded_values(spark):
    df = spark.createDataFrame([("t", 0.59996, 0.9, "x", 0.5)], "thread_id string, noul double, score double, choice string, confidence double")
    row = curate.decide(df).first()
    assert row.is_rag_related == 0.6 and not row.curation_passed


def test_a_thread_of_many_comments(spark):
    n = 100_000
    comments = spark.range(n).select(
        F.lit("p").alias("thread_id"), F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "op").otherwise("x").alias("author"), (F.col("id") % 50).alias("score"),
        F.lit("2024-01-02").alias("created_at"), F.concat(F.lit("body "), "id").alias("body"), F.col("id").alias("ord"),
    )
    posts = spark.createDataFrame([("p", "c", "p", "op", "2024-01-01", "Title", "Body", 1)], "thread_id string, community string, id string, author string, created_at string, title string, body string, score long")
    row = threads.threads(posts, comments).first()
    messages = json.loads(row.conversation_json)
    assert (row.comment_count, row.best_answer_id, row.best_answer_score) == (n, "c49", 49)
    assert len(messages) == row.conversation_turns and "\n\n".join(m["content"] for m in messages).split("\n\n") == ["Title", "Body", *(f"body {k}" for k in range(n))]
