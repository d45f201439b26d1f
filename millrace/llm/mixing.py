"""Mixing sources to target weights with integer repetition plus one hash-seeded Bernoulli copy.

Tokens per source are one aggregate; targets come from a water level over the table of sources, which is
ranked in ranges (in one, unless there are more than RANGE_ROWS sources); each document is then decided on its own, so a
hot source needs no shuffle of its rows.
The table of sources is written first: Spark broadcasts it by its file size or, if it is too large,
shuffles the narrow side of a join that AQE may split.

Defined cases: null text has size 0; the null source is a source of its own, last in order; rows
that share an id share the draw (a null id draws as the empty string); sizes of 0 give a target of
0 and no copies; texts of any length are counted whole; an empty table gives no rows; other columns pass through, and those named as an output
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, quoted

MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Sources that one task ranks; more are dealt out by ranges.
RANGE_ROWS = 1 << 10


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def numbered(table: DataFrame, *order: Column) -> DataFrame:
    """`table` (a written one) with the number of each row's range of `order`; ranges are in that order, and so may be ranked each on its own. Few rows are one range."""
    if table.count() <= RANGE_ROWS:
        return table.withColumn("__range", F.lit(0))
    return materialize(table.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def earlier(ranges: DataFrame, **sums: Column) -> DataFrame:
    """Per range the sums over all ranges before it: one row a range, however many rows there are."""
    per_range = ranges.groupBy("__range").agg(*(c.alias(k) for k, c in sums.items()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select("__range", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) plus target: shares of the total by weight, no source above max_repeat times its size.

    The excess of capped sources is shared again by weight until none is above its cap. In order of
    cap / weight the capped sources are a prefix, and the level at which the others stand is the
    largest of the levels that the prefixes leave. Both orders are made by ranges that tasks rank on their own and
    offsets of the ranges, so sources may be as many as documents.
    """
    name, cap = F.col("source").asc_nulls_last(), F.col("source_size") * max_repeat
    named = numbered(sizes, name)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(name)) + F.col("__rows")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    weighed = named.join(F.broadcast(earlier(named, __rows=F.count(F.lit(1)))), "__range").select("source", "source_size", weight.alias("__w"))
    by_cap = F.col("__ratio").asc(), name
    capped = numbered(materialize(weighed.withColumn("__ratio", cap.cast("double") / F.col("__w")), "weighed"), *by_cap)
    all_size, all_weight = capped.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0))).first()
    before = Window.partitionBy("__range").orderBy(*by_cap).rowsBetween(Window.unboundedPreceding, -1)
    passed = lambda x, offset: F.coalesce(F.sum(x).over(before), F.lit(0)) + F.col(offset)
    level = (F.lit(all_size) - passed(cap, "__caps")) / (F.lit(all_weight) - passed(F.col("__w"), "__weights"))
    offsets = earlier(capped, __caps=F.sum(cap), __weights=F.sum("__w"))
    top = capped.join(F.broadcast(offsets), "__range").select(level.alias("level")).agg(F.max("level")).first()[0]
    return capped.select("source", "source_size", F.least(cap.cast("double"), F.lit(top) * F.col("__w")).alias("target"))


def draw(key: str, seed: str = SEED, *more: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over the seed and the id, and more if given."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), *(x for c in more for x in (F.lit("|"), c))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """All rows of `docs` (or its columns `keep`) plus __size, __source_size, __target and __copies (0 to 3). Without the text among them, texts are read once and their sizes written."""
    made = ["__size", "__source_size", "__target", "__copies"]
    kept, names = boxed(docs, docs.columns if keep is None else keep, made)
    sized = docs.select(*kept, quoted(source).alias("source"), word_count(text).alias("size"), draw(key).alias("draw"))
    if text not in names:
        sized = materialize(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = materialize(source_targets(materialize(sums, "sources")), "targets").withColumnRenamed("source", "name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.least(F.lit(MAX_REPEAT).cast("long"), F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long"))
    joined = sized.join(table, F.col("source").eqNullSafe(F.col("name")), "left")
    return joined.select(*(f"c{k}" for k in range(len(names))), "size", "source_size", "target", copies).toDF(*names, *made)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """`docs` with each row as often as the mix takes it."""
    box = [f"c{k}" for k in range(len(docs.columns))]
    planned = mix_plan(docs.toDF(*box), *(box[docs.columns.index(c)] for c in (text, source, key))).where("__copies > 0")
    return planned.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*box).toDF(*docs.columns)
