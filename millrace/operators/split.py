"""Exact stratified splits, repeatable for a seed.

Rows are ordered within a stratum by MD5 of seed and id, and cut at the whole parts of the ratios,
the rest going to the last split. The position of a row comes from two steps, so that a stratum may
hold most of the table: counts per (stratum, first hash digits) fix where each slice begins, and rows
are ranked only within their slice.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
SLICE_DIGITS = 3


def split_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))


def stratified_split(df: DataFrame, stratum: str, key: str, ratios: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """`df` plus split. A null stratum is a stratum of its own. Equal ids are ordered by all their columns' hash."""
    ratios = ratios or RATIOS
    if abs(sum(ratios.values()) - 1.0) >= 1e-5:
        raise ValueError("ratios must sum to 1")
    part = F.substring("__h", 1, SLICE_DIGITS)
    hashed = df.withColumn("__h", split_key(F.col(key), seed)).withColumn("__part", part)
    counts = hashed.groupBy(F.col(stratum).alias("__s"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    by_part = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"__before": F.coalesce(F.sum("__c").over(by_part), F.lit(0)), "__n": F.sum("__c").over(Window.partitionBy("__s"))}).drop("__c")
    ranked = hashed.withColumn("__r", F.row_number().over(Window.partitionBy(stratum, "__part").orderBy("__h", key, F.xxhash64(*df.columns))))
    placed = ranked.join(starts, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p"))).withColumn("__at", F.col("__before") + F.col("__r"))
    *first, last = ratios
    edge, choice = F.lit(0), None
    for name in first:
        edge = edge + F.floor(F.col("__n") * F.lit(float(ratios[name])))
        choice = (F if choice is None else choice).when(F.col("__at") <= edge, name)
    return placed.withColumn("split", choice.otherwise(last)).select(*df.columns, "split")


def split_counts(split: DataFrame, stratum: str) -> DataFrame:
    """Rows per split and stratum."""
    return split.groupBy("split", stratum).agg(F.count(F.lit(1)).alias("n"))


def question_key(text: Column) -> Column:
    """What two spellings of one question share: 128 bits of its normalized text; null if nothing is left of it."""
    plain = normalize(text)
    return F.when(plain != "", F.unhex(F.md5(plain)))


def marked(rows: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("title",), question: str = "question", name: str = "leaked") -> DataFrame:
    """`rows` plus `name`: whether any of `columns` asks a question of the benchmark, case, punctuation and white space aside.

    The benchmark's distinct keys, 16 bytes each, meet the rows in a left join a column: Spark broadcasts them if they are few
    as they are found to be at run time, and shuffles and splits beyond that. Null texts and texts without a word ask nothing.
    """
    out = rows
    for k, column in enumerate(columns):
        keys = items.select(question_key(F.col(question)).alias(f"__key_{k}")).where(F.col(f"__key_{k}").isNotNull()).distinct().withColumn(f"__leak_{k}", F.lit(True))
        out = out.withColumn("__own", question_key(F.col(column))).join(keys, F.col("__own") == F.col(f"__key_{k}"), "left").drop("__own", f"__key_{k}")
    found = reduce(or_, (F.col(f"__leak_{k}").isNotNull() for k in range(len(columns))))
    return out.withColumn("__found", found).drop(*(f"__leak_{k}" for k in range(len(columns)))).withColumnRenamed("__found", name)


def isolated(rows: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("title",), question: str = "question") -> DataFrame:
    """The rows that ask no question of the benchmark: what may go into a training split."""
    return marked(rows, items, columns, question, "__leaked").where(~F.col("__leaked")).drop("__leaked")


def leaks(split: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("title",), question: str = "question") -> DataFrame:
    """Rows and benchmark leaks of each split."""
    return marked(split, items, columns, question).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaked").alias("leaks"))
