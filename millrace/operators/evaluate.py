"""Concept recall of answers, question rows, report roll-ups, comparisons, and checks of a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..fixed import BASELINE_RECALL_PCT, CONCEPTS
from ..functions.rewards import rounded
from ..functions.text import SPACE, normalize, reasoning, spaced, strip, tagged_answer
from ..suite import SUITE


def variants(concept: Column) -> Column:
    """Spellings that count for a concept: parts between slashes or `or`, with and without brackets, the brackets' contents, hyphens kept, spaced and dropped."""
    parts = F.split(concept, rf"{SPACE}*/{SPACE}*|{SPACE}+or{SPACE}+")
    inside = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"\(([^)]+)\)"), F.lit(1))))
    outside = F.transform(parts, lambda p: F.regexp_replace(p, r"\([^)]*\)", ""))
    plain = F.transform(F.concat(parts, inside, outside), normalize)
    hyphens = F.filter(plain, lambda v: v.contains("-"))
    more = F.concat(plain, F.transform(hyphens, spaced), F.transform(hyphens, lambda v: F.replace(v, F.lit("-"), F.lit(""))))
    return F.array_distinct(F.filter(more, lambda v: F.length(v) >= 2))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def loose_match(text: Column, plain: Column, variant: Column) -> Column:
    """Long or spaced variants anywhere in a normalized text or in its spaced form `plain`, both padded; short ones at word borders.

    In a normalized text only spaces and hyphens are no word characters, so a border is one of these and needs no pattern.
    """
    short, hyphen = (F.length(variant) < 4) & ~F.contains(variant, F.lit(" ")), F.contains(variant, F.lit("-"))
    around = lambda a, b: F.contains(text, F.concat(F.lit(a), variant, F.lit(b)))
    at_border = F.when(hyphen, around(" ", " ") | around("-", " ") | around(" ", "-") | around("-", "-")).otherwise(F.contains(plain, padded(variant)))
    return F.when(short, at_border).otherwise(F.contains(text, variant) | F.contains(plain, variant))


def strict_match(text: Column, plain: Column, variant: Column) -> Column:
    """Variants as whole words between spaces, in a normalized text or in its spaced form, both padded."""
    return F.contains(text, padded(variant)) | F.contains(plain, padded(variant))


def coverage(answers: DataFrame, items: DataFrame, match=loose_match, digits: int | None = 4) -> DataFrame:
    """(id, answer columns and the item's, matched, missing, recall): answers (id, text) joined to items (id, expected_concepts)."""
    return coverages(answers, items, {"": match}, digits)


def coverages(answers: DataFrame, items: DataFrame, matches: dict, digits: int | None = 4) -> DataFrame:
    """As `coverage`, with matched, missing and recall for each matcher, under its prefix: answers are joined and normalized once for all.

    Variants are worked out once per item, not per answer; the items follow the answers by id.
    """
    known = items.withColumn("__variants", F.transform("expected_concepts", lambda c: F.struct(c.alias("concept"), variants(c).alias("v"))))
    joined = answers.join(known, "id").withColumn("__text", padded(normalize(F.col("text")))).withColumn("__plain", spaced(F.col("__text")))
    out = joined
    for prefix, match in matches.items():
        out = marked(out, prefix, match, digits)
    return out.drop("__variants", "__text", "__plain")


def marked(joined: DataFrame, prefix: str, match, digits: int | None) -> DataFrame:
    """`joined` plus matched, missing and recall by one matcher, under its prefix."""
    hit = lambda c: F.exists(c["v"], lambda v: match(F.col("__text"), F.col("__plain"), v))
    hits = joined.withColumn("__hits", F.transform("__variants", lambda c: F.struct(c["concept"].alias("concept"), hit(c).alias("hit"))))
    names = lambda yes: F.transform(F.filter("__hits", lambda h: h["hit"] == F.lit(yes)), lambda h: h["concept"])
    done = hits.withColumns({f"{prefix}matched": names(True), f"{prefix}missing": names(False)})
    recall = F.coalesce(F.try_divide(F.size(f"{prefix}matched"), F.size("expected_concepts")), F.lit(0.0))
    return done.withColumn(f"{prefix}recall", rounded(recall, digits)).drop("__hits")


def question_rows(covered: DataFrame, digits: bool = True) -> DataFrame:
    """Per answer: reasoning flags and lengths, and speed from `tokens` and `seconds`."""
    trace, answer = reasoning(F.col("text"))
    speed = F.coalesce(F.try_divide("tokens", "seconds"), F.lit(0.0))
    return covered.withColumns({"thinking_trace": trace, "generated_answer": answer}).withColumns(
        {
            "has_thinking_trace": F.col("thinking_trace").isNotNull(),
            "thinking_length_chars": F.coalesce(F.length("thinking_trace"), F.lit(0)),
            "answer_length_chars": F.length("generated_answer"),
            "latency_seconds": F.bround("seconds", 3) if digits else F.col("seconds"),
            "tokens_per_second": F.bround(speed, 2) if digits else speed,
        }
    )


def rollup(rows: DataFrame) -> DataFrame:
    """Recall and speed overall, by category and by difficulty; speed is the ratio of the sums. One pass over the rows."""
    sums = rows.groupingSets([[], ["category"], ["difficulty"]], "category", "difficulty").agg(
        F.grouping("category").alias("no_category"),
        F.grouping("difficulty").alias("no_difficulty"),
        F.count(F.lit(1)).alias("questions"),
        F.avg("recall").alias("avg_recall"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("seconds").alias("total_seconds"),
    )
    level = F.when(F.col("no_category") == 0, "category").when(F.col("no_difficulty") == 0, "difficulty").otherwise("overall")
    speed = F.coalesce(F.try_divide("total_tokens", "total_seconds"), F.lit(0.0))
    return sums.select(level.alias("level"), F.coalesce("category", "difficulty", F.lit("all")).alias("name"), "questions", "avg_recall", "total_tokens", speed.alias("tokens_per_second"))


def trained_report(rows: DataFrame, baseline_pct: float = BASELINE_RECALL_PCT) -> DataFrame:
    """One row in percent: recall after training, its gain, and the share of answers with closed reasoning."""
    think = F.contains("text", F.lit("<think>")) & F.contains("text", F.lit("</think>"))
    recall = F.coalesce(100 * F.avg("recall"), F.lit(0.0))
    return rows.agg(recall.alias("recall_pct"), (recall - baseline_pct).alias("delta_pct"), F.coalesce(100 * F.avg(think.cast("int")), F.lit(0.0)).alias("thinking_trace_pct"))


def answer_rows(covered: DataFrame) -> DataFrame:
    """The training notebook's form: trace and tagged answer as texts."""
    trace, _ = reasoning(F.col("text"))
    return covered.withColumns({"thinking_trace": F.coalesce(trace, F.lit("")), "final_answer": tagged_answer(F.col("text"))})


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Categories of the left roll-up with both recalls in percent, 0 where the right has none."""
    pick = lambda df, name: df.where("level = 'category'").select(F.col("name").alias("category"), (100 * F.col("avg_recall")).alias(name))
    return pick(left, "left_pct").join(pick(right, "right_pct"), "category", "left").withColumn("right_pct", F.coalesce("right_pct", F.lit(0.0)))


def side_by_side(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """As `compare`, of two recalls that the same answers were given in one pass; null is no answer."""
    percent = lambda c: F.coalesce(100 * F.avg(c), F.lit(0.0))
    return rows.groupBy("category").agg(percent(left).alias("left_pct"), percent(right).alias("right_pct"))


def benchmark_metadata(items: DataFrame) -> DataFrame:
    """(field, value, n): items per category, difficulty and test type."""
    fields = ["category", "difficulty", "test_type"]
    return items.unpivot([], fields, "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def suite(spark: SparkSession) -> DataFrame:
    """The package's own benchmark items."""
    return spark.createDataFrame(SUITE, schemas.BENCHMARK)


def category_recall(rows: DataFrame, digits: int | None = 1) -> DataFrame:
    """(category, recall_pct): mean recall in percent, as the notebooks' reports have it."""
    return rows.groupBy("category").agg(rounded(100 * F.avg("recall"), digits).alias("recall_pct"))


def benchmark_faults(items: DataFrame, min_question: int = 21, min_concepts: int = 3, min_reasoning: int = 51, min_items: int = 10, categories: tuple[str, ...] = tuple(CONCEPTS)) -> DataFrame:
    """One row of counts that are 0 for a sound benchmark. Lengths are those of stripped texts."""
    size = lambda c: F.coalesce(F.length(strip(F.col(c))), F.lit(0))
    rubric = [F.coalesce(F.length(f"scoring_rubric.{k}"), F.lit(0)) == 0 for k in ("correctness", "grounding", "tradeoffs")]
    known = F.size(F.array_intersect(F.collect_set("category"), F.array(*map(F.lit, categories))))
    return items.agg(
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if((size("category") == 0) | (size("difficulty") == 0) | (size("test_type") == 0)).alias("blank_labels"),
        F.count_if(size("question") < min_question).alias("short_questions"),
        F.count_if(F.coalesce(F.size("expected_concepts"), F.lit(-1)) < min_concepts).alias("few_concepts"),
        F.count_if(size("reference_reasoning") < min_reasoning).alias("short_reasoning"),
        F.count_if(rubric[0] | rubric[1] | rubric[2]).alias("blank_rubrics"),
        (F.lit(len(categories)) - known).cast("long").alias("missing_categories"),
        F.count_if(~F.col("category").isin(*categories)).alias("foreign_categories"),
        F.greatest(F.lit(min_items) - F.count(F.lit(1)), F.lit(0)).cast("long").alias("missing_items"),
    )


def overlapping(split: DataFrame, key: str = "thread_id") -> DataFrame:
    """Ids that occur in more than one split."""
    return split.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(key)
