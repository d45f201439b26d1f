"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Light keys (length, prefix hash) are counted with map-side aggregation; only rows whose length and
prefix both recur have their full text hashed. The keys that recur and the groups of equal texts are
written as narrow tables and, if they are few enough, broadcast, so that no text is shuffled. Beyond
the bound of the prefixes that recur the rows are shuffled once by length and prefix, with their texts where `same`
names no hash; beyond that of the groups only rows with a recurring key meet again. AQE may split both
joins. No group is collected: a group of any size is two aggregate rows per task.

Defined cases: null text counts as empty; a null id never wins against another id (a group of null
ids only has a null __keep_id and keeps them all); rows repeating both id and text share one decision;
texts of any length are compared whole; an empty table gives no rows; other columns pass through, and those named as an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, boxed, discard, materialize, quoted

PREFIX_CHARS = 64


def refine(rows: DataFrame, body: Column, full: Column) -> DataFrame:
    """`rows` plus `full`: the full hash where length and prefix hash of `body` recur, else null."""
    keyed = rows.withColumns({"len": F.octet_length(body), "pre": F.xxhash64(F.substring(body, 1, PREFIX_CHARS))})
    recur = F.col("count") > 1
    lengths = materialize(keyed.groupBy("len").count().where(recur).select("len"), "lengths")
    prefixes = keyed.select("len", "pre").join(bounded(lengths), "len", "left_semi").groupBy("len", "pre").count().where(recur)
    survivors = materialize(prefixes.select("len", "pre", F.lit(True).alias("hit")), "prefixes")
    discard(lengths)
    return keyed.join(bounded(survivors), ["len", "pre"], "left").withColumn("full", F.when(F.col("hit"), full)).drop("len", "pre", "hit")


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", same: str | None = None, limit: int = BROADCAST_ROWS // 4) -> DataFrame:
    """All rows of `docs` plus __keep_id, __group_size, __kept. Of equal texts the row with the largest key stays.

    `same` names a column that takes the place of the full hash (SHA-256 of the text) if the caller has one at hand.
    """
    made = ["__keep_id", "__group_size", "__kept"]
    kept, names = boxed(docs, docs.columns, made)
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = docs.select(*kept, quoted(text).alias("body"), quoted(key).alias("key"), *([quoted(same).alias("same")] if same else []))
    marked = refine(rows, body, F.col("same") if same else F.sha2(body, 256)).drop("body", "same")
    groups = marked.where("full IS NOT NULL").groupBy("full").agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups, "groups")
    if groups.count() <= limit:
        out = marked.join(F.broadcast(groups), "full", "left")
    else:  # rows that are alone stay where they are
        alone = marked.where("full IS NULL").withColumns({"keep": F.lit(None).cast(docs.schema[key].dataType), "n": F.lit(None).cast("long")})
        out = marked.where("full IS NOT NULL").join(groups, "full", "left").unionByName(alone)
    keep = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("keep"))
    box = [f"c{k}" for k in range(len(names))]
    return out.select(*box, keep, F.coalesce("n", F.lit(1)).cast("long"), F.col("key").eqNullSafe(keep)).toDF(*names, *made)


def drop_exact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of `docs`."""
    box = [f"c{k}" for k in range(len(docs.columns))]
    found = exact_duplicates(docs.toDF(*box), box[docs.columns.index(text)], box[docs.columns.index(key)])
    return found.where("__kept").select(*box).toDF(*docs.columns)
