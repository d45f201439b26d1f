"""Records to threads: reject rules with one reason per row, the join of comments to posts, turns, best answers, transcripts.

Posts and comments go through as one table, sorted once by thread, kind and time: a thread's post is
its first row, so no join is needed, and windows and aggregates by thread and turn share one shuffle. Windows
spill where a thread is long. Thread rows hold a thread's whole text by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..fixed import BOTS, DELETED_AUTHOR, EMPTY_BODIES
from ..functions.text import json_string, or_default, strip, tokens
from .ingest import first_of_each

MIN_DATE, MIN_BODY, MIN_TITLE = "2023-01-01", 15, 5
REASONS = ("pre_min_date", "bot", "negative_score", "invalid_body")


def is_bot(author: Column) -> Column:
    name = F.lower(strip(F.coalesce(author, F.lit(""))))
    return name.isin(BOTS) | name.endswith("bot") & (F.length(name) > 3) & name.contains("_")


def is_valid_body(body: Column, min_length: int = MIN_BODY) -> Column:
    text = strip(F.coalesce(body, F.lit("")))
    return (F.length(text) >= min_length) & ~F.lower(text).isin(EMPTY_BODIES)


def is_post() -> Column:
    return F.coalesce("parent_id", F.lit("")) == ""


def with_reason(records: DataFrame, min_date: str = MIN_DATE, min_body: int = MIN_BODY) -> DataFrame:
    """`records` plus reject_reason: the first rule that a row breaks, null if it stays."""
    titled = F.length(strip(F.coalesce("title", F.lit("")))) >= MIN_TITLE
    valid = is_valid_body(F.col("body"), min_body)
    early = ~F.coalesce(F.col("created_at") >= min_date, F.lit(False))
    reason = (
        F.when(early, REASONS[0])
        .when(is_bot(F.col("author")), REASONS[1])
        .when(F.coalesce("score", F.lit(0)) < 0, REASONS[2])
        .when(~F.when(is_post(), titled | valid).otherwise(valid), REASONS[3])
    )
    return records.withColumn("reject_reason", reason)


def keyed(rows: DataFrame, is_comment: Column) -> DataFrame:
    """`rows` with __comment and the thread_id that they belong to."""
    own = or_default(F.col("post_id"), F.col("id")) if "post_id" in rows.columns else F.col("thread_id")
    return rows.withColumns({"__comment": is_comment, "thread_id": F.when(is_comment, own).otherwise(F.col("id"))})


def kept(records: DataFrame, min_date: str = MIN_DATE, min_body: int = MIN_BODY, seen: Observation | None = None) -> DataFrame:
    """The records that stay, posts and comments in one table keyed by thread_id; `seen` gets the rows per reason of those that pass by."""
    judged = with_reason(records, min_date, min_body)
    if seen is not None:
        judged = judged.observe(seen, *(F.count_if(F.coalesce("reject_reason", F.lit("kept")) == r).alias(r) for r in (*REASONS, "kept")))
    return keyed(judged.where("reject_reason IS NULL").drop("reject_reason"), ~is_post())


def kept_parts(records: DataFrame, min_date: str = MIN_DATE, min_body: int = MIN_BODY) -> tuple[DataFrame, DataFrame]:
    """`kept` as (posts, comments), of posts with one id the last."""
    rows = kept(records, min_date, min_body)
    posts = first_of_each(rows.where("NOT __comment"), ["id"], [F.col("ord").desc()])
    return posts.drop("__comment"), rows.where("__comment").drop("__comment")


def together(rows: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """`rows` as `kept` has them, or made of posts and comments."""
    if comments is None:
        return rows
    posts = rows if "ord" in rows.columns else rows.withColumn("ord", F.lit(-1).cast("long"))
    return keyed(posts, F.lit(False)).unionByName(keyed(comments, F.lit(True)), allowMissingColumns=True)


def role_of(author: Column, post_author: Column) -> Column:
    return F.when((author != DELETED_AUTHOR) & (author == post_author), "user").otherwise("assistant")


def prompt_of(title: Column, body: Column) -> Column:
    both = strip(F.concat(title, F.lit("\n\n"), body))
    return F.when((body != "") & (body != title), both).otherwise(strip(title))


BEST = ["comment_count", "best_answer_id", "best_answer_author", "best_answer_score", "best_answer_body"]


def best_pick() -> Column:
    """The least of these over a thread's comments is its best answer: the highest score, the earliest of equals."""
    return F.struct((-F.col("score")).alias("s"), "created_at", "ord", "id", "author", strip(F.col("body")).alias("body"))


def best_columns() -> dict[str, Column]:
    """The columns BEST from n (comments) and b (the best pick), null where a thread has none."""
    text = lambda c: F.coalesce(c, F.lit(""))
    values = F.coalesce("n", F.lit(0)), text(F.col("b.id")), text(F.col("b.author")), F.coalesce(-F.col("b.s"), F.lit(0)), text(F.col("b.body"))
    return dict(zip(BEST, values, strict=True))


def best_answers(rows: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Per kept post: comment count and the best answer; '' and 0 without comments. One aggregate over all rows, partial before the shuffle."""
    comment = F.col("__comment")
    found = together(rows, comments).groupBy("thread_id").agg(F.count_if(comment).alias("n"), F.min(F.when(comment, best_pick())).alias("b"), F.bool_or(~comment).alias("posted"))
    return found.where("posted").withColumns(best_columns()).select("thread_id", *BEST)


def sequenced(rows: DataFrame) -> DataFrame:
    """The rows of threads that have a post, one post each, with __role and __turn: neighbours of one role share a turn.

    All windows have one partitioning and one order, so the rows are shuffled and sorted once, and what follows by thread is not shuffled again.
    """
    comment = F.col("__comment")
    order = Window.partitionBy("thread_id").orderBy("__comment", F.when(~comment, -F.col("ord")), "created_at", "ord")
    top = rows.withColumns({"__op": F.first(F.struct("__comment", "author")).over(order), "__place": F.row_number().over(order)})
    mine = top.where(~F.col("__op.__comment") & (comment | (F.col("__place") == 1)))
    said = mine.withColumn("__role", F.when(comment, role_of(F.col("author"), F.col("__op.author"))).otherwise("user"))
    changed = F.coalesce((F.lag("__role").over(order) != F.col("__role")).cast("long"), F.lit(0))
    return said.withColumn("__changed", changed).withColumn("__turn", F.sum("__changed").over(order))


def merged(rows: DataFrame) -> DataFrame:
    """A row a turn: its comments in order, the thread's post if it is the first turn, and the best of its comments."""
    comment = F.col("__comment")
    said = F.collect_list(F.when(comment, F.struct("created_at", "ord", "author", "score", "body")))
    post = F.max(F.when(~comment, F.struct("created_at", "author", "score", "title", "body", "community")))
    return (
        sequenced(rows)
        .groupBy("thread_id", F.col("__turn").alias("turn"), F.col("__role").alias("role"))
        .agg(F.array_sort(said).alias("said"), post.alias("post"), F.count_if(comment).alias("n"), F.min(F.when(comment, best_pick())).alias("b"))
    )


def content() -> Column:
    """The text of a turn: what its messages say, a blank line between them."""
    opening = F.when(F.col("post").isNotNull(), F.array(prompt_of(F.col("post.title"), F.col("post.body")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(opening, F.transform("said", lambda c: strip(c["body"]))), "\n\n")


def turns(rows: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """(thread_id, turn, role, content): consecutive messages of one role merged."""
    return merged(together(rows, comments)).select("thread_id", "turn", "role", content().alias("content"))


def threads(rows: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """A row per post with the 17 thread columns, of rows as `kept` has them: one scan, one shuffle; what a query doesn't select is not gathered."""
    line = lambda c: F.concat(F.lit("**["), c["author"], F.lit("]** *(Score: "), c["score"].cast("string"), F.lit(", "), c["created_at"], F.lit(")*:\n"), strip(c["body"]), F.lit("\n"))
    as_json = F.concat(F.lit('{"role": "'), "role", F.lit('", "content": '), json_string(content()), F.lit("}"))
    of_turns = lambda c, name: F.array_sort(F.collect_list(F.struct("turn", c.alias("x")))).alias(name)
    joined = (
        merged(together(rows, comments))
        .groupBy("thread_id")
        .agg(
            of_turns(as_json, "m"),
            of_turns(F.transform("said", line), "lines"),
            of_turns(F.transform("said", lambda c: c["body"]), "bodies"),
            F.max("post").alias("post"),
            F.sum("n").alias("n"),
            F.min("b").alias("b"),
            (F.max("turn") + 1).alias("turns"),
        )
        .withColumns(best_columns())
    )
    lines, bodies = (F.flatten(F.transform(k, lambda t: t["x"])) for k in ("lines", "bodies"))
    title, body, when = F.col("post.title"), F.col("post.body"), F.col("post.created_at")
    head = F.array(
        F.concat(F.lit("# "), title),
        F.concat(F.lit("**Author:** "), F.col("post.author"), F.lit(" | **Score:** "), F.col("post.score").cast("string"), F.lit(" | **Date:** "), when),
        F.lit(""),
        F.when(body == "", "*(No body text)*").otherwise(body),
        *map(F.lit, ("", "---", "## Discussion & Solutions", "")),
    )
    full = F.concat_ws(" ", title, body, F.array_join(bodies, " "))
    return joined.withColumn("full", full).select(
        "thread_id",
        F.col("post.community").alias("community"),
        title.alias("title"),
        F.col("post.author").alias("post_author"),
        when.alias("post_created_at"),
        F.col("post.score").alias("post_score"),
        body.alias("post_body"),
        *BEST,
        F.col("turns").cast("long").alias("conversation_turns"),
        F.concat(F.lit("["), F.array_join(F.transform("m", lambda x: x["x"]), ", "), F.lit("]")).alias("conversation_json"),
        F.array_join(F.concat(head, lines), "\n").alias("discussion_transcript"),
        F.size(tokens(F.col("full"))).cast("long").alias("total_word_count"),
        F.length("full").cast("long").alias("total_char_count"),
    )


def reason_counts(records: DataFrame, **rules) -> DataFrame:
    """Rows per reject reason; `kept` for those that stay."""
    return with_reason(records, **rules).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def report_columns() -> list[Column]:
    """Figures over thread rows: threads, with and without comments, averages (0 if there are none)."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("total_cleaned_threads"),
        F.count_if(F.col("comment_count") > 0).alias("threads_with_comments"),
        F.count_if(F.col("comment_count") == 0).alias("standalone_posts"),
        mean("comment_count").alias("avg_comments_per_thread"),
        mean("conversation_turns").alias("avg_turns_per_conversation"),
    ]


def thread_report(cleaned: DataFrame) -> DataFrame:
    """One row of figures over thread rows."""
    return cleaned.agg(*report_columns())
