"""Raw forum objects to normalized records: field rules, first-wins identity over posts then comments, health figures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import DELETED_AUTHOR, DELETED_BODIES
from ..functions.text import or_default, strip
from ..sources.files import kind, read_json_lines, read_lines

#: Epoch seconds of the years that are taken for timestamps (2000 to 2100).
EARLIEST, LATEST = 946684800, 4102444800
#: The order of lines in which the first of an id wins: posts before comments, then as files have them.
ORDER = ["src", "file", "block", "ord"]

MEMBERS = ["id", "link_id", "parent_id", "created_utc", "created", "subreddit", "community", "author", "title", "selftext", "body", "score"]
TEXT_MEMBERS = MEMBERS[:-1]


def with_members(raw: DataFrame) -> DataFrame:
    """`raw` with, for each member, __text_*, __kind_* and __given_*, its text or null where Python takes it for false (absent, null, "", 0, false, empty), in place of v.

    Plain columns in projections of their own: a line is searched once for each member, however often the rules refer to it.
    """
    found = {f"__text_{k}": F.try_variant_get("v", f"$.{k}", "string") for k in MEMBERS} | {f"__kind_{k}": kind(F.try_variant_get("v", f"$.{k}", "variant")) for k in MEMBERS}
    number = F.try_variant_get("v", "$.score", "double")

    def given(name: str) -> Column:
        text = F.col(f"__text_{name}")
        false = (text == "") | (F.col(f"__kind_{name}") != "STRING") & text.rlike(r"^(-?0+(\.0+)?([eE].*)?|false|\[\]|\{\})$")
        return F.when(~F.coalesce(false, F.lit(True)), text)

    members = raw.withColumns(found | {"__number": number, "__broken": F.col("v").isNull()}).drop("v")
    score = whole_number(F.col("__text_score"), F.col("__kind_score"), F.col("__number"))
    return members.withColumns({f"__given_{k}": given(k) for k in TEXT_MEMBERS} | {"__score": score})


def python_members(line: str) -> tuple | None:
    """The members of a line as Python reads them: texts of those it takes for true, the score as an integer; None if the line holds no object."""
    try:
        found = json.loads(line)
    except ValueError:
        return None
    except RecursionError:
        return None
    if isinstance(found, dict) and isinstance(found.get("data"), dict):
        found = found["data"]
    if not isinstance(found, dict):
        return None
    try:
        score = int(found.get("score") or 0)
    except (ValueError, TypeError, OverflowError):
        score = 0
    return (*(str(found[k]).encode("utf-8", "replace").decode() if found.get(k) else None for k in TEXT_MEMBERS), score if -(1 << 63) <= score < 1 << 63 else 0)


def with_python_members(lines: DataFrame) -> DataFrame:
    """`lines` (line and other columns) with __given_*, __score and __broken in place of line, by Python's own reader in Arrow batches."""
    names = [*TEXT_MEMBERS, "score", "broken"]
    kinds = [*[pa.string()] * len(TEXT_MEMBERS), pa.int64(), pa.bool_()]

    @F.arrow_udf(", ".join(f"{k} {'long' if k == 'score' else 'boolean' if k == 'broken' else 'string'}" for k in names))
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            rows = [(*found, False) if (found := python_members(x)) else (*[None] * len(TEXT_MEMBERS), 0, True) for x in a.to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    read_once = lines.withColumn("__read", read.asNondeterministic()("line")).drop("line")
    members = {f"__given_{k}": F.col(f"__read.{k}") for k in TEXT_MEMBERS}
    return read_once.withColumns(members | {"__score": F.col("__read.score"), "__broken": F.col("__read.broken")}).drop("__read")


def field(name: str) -> Column:
    return F.col(f"__given_{name}")


def iso_time(seconds: Column) -> Column:
    """ISO 8601 in UTC of epoch seconds, microseconds only if there are any; null beyond the bounds. No session time zone is involved."""
    number = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    shown = number.cast("string")
    part = F.substring(shown, 21, 6)
    text = F.concat(F.replace(F.substring(shown, 1, 19), F.lit(" "), F.lit("T")), F.when(part == "", "").otherwise(F.concat(F.lit("."), F.rpad(part, 6, "0"))), F.lit("+00:00"))
    return F.when(seconds.between(EARLIEST, LATEST), text)


def whole_number(text: Column, value: Column, number: Column) -> Column:
    """Integer text, or a number cut to an integer; 0 for all else. `value` is the kind of the member."""
    text = strip(text)
    as_text = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    flag = F.when(text == "true", 1).otherwise(0)
    return F.coalesce(F.when(value == "STRING", as_text).when(value == "BOOLEAN", flag).otherwise(F.coalesce(as_text, number.try_cast("bigint"))), F.lit(0)).cast("long")


def post_of(link: Column, parent: Column) -> Column:
    """The post that a comment hangs on: `t3_` links win, then `t3_` parents, then either as it stands."""
    tail = lambda c: F.substr(c, F.lit(4))
    return F.when(link.startswith("t3_"), tail(link)).when(parent.startswith("t3_"), tail(parent)).otherwise(or_default(link, parent))


def normalize(raw: DataFrame, comments: bool, source: str = "community_forum", keep: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Records plus ord, malformed and the columns `keep`, of VARIANT objects v; malformed rows have no id.

    `strict` takes lines of text in place of v and reads them with Python's rules: the last of repeated keys counts, NaN is a number, text
    after a value is an error, numbers read as Python writes them. Integers beyond 64 bits, which no table can hold, are 0, and lines that hold no object are malformed.
    """
    text = lambda *names: strip(F.coalesce(*map(field, names), F.lit("")))
    made = {"__id": F.coalesce(strip(field("id")), F.lit("")), "__link": text("link_id"), "__parent": text("parent_id")}
    rows = (with_python_members if strict else with_members)(raw).withColumns(made | {"__when": F.coalesce(field("created_utc"), field("created")).try_cast("double")})
    ident, link, parent, when = map(F.col, ("__id", "__link", "__parent", "__when"))
    return rows.select(
        F.lit(source).alias("source"),
        F.lower(strip(F.coalesce(field("subreddit"), field("community"), F.lit("rag")))).alias("community"),
        ident.alias("id"),
        (parent if comments else F.lit("")).alias("parent_id"),
        (post_of(link, parent) if comments else ident).alias("post_id"),
        strip(F.coalesce(field("author"), F.lit(DELETED_AUTHOR))).alias("author"),
        F.coalesce(iso_time(when), F.lit("")).alias("created_at"),
        (F.lit("") if comments else text("title")).alias("title"),
        (text("body") if comments else text("selftext", "body")).alias("body"),
        F.col("__score").alias("score"),
        "ord",
        # a partition's number is never negative; as it isn't deterministic, filters on this column stay above the parsing instead of repeating it
        ((F.col("__broken") | (ident == "")) & (F.spark_partition_id() >= 0)).alias("malformed"),
        *(keep or []),
    )


def first_of_each(records: DataFrame, keys: list[str], order: list, copies: str | None = None) -> DataFrame:
    """The first row of each key in the given order; with the number of the key's rows if `copies` names a column for it."""
    group = Window.partitionBy(*keys)
    ranked = records.withColumn("__rank", F.row_number().over(group.orderBy(*order)))
    if copies:
        ranked = ranked.withColumn(copies, F.count(F.lit(1)).over(group))
    return ranked.where("__rank = 1").drop("__rank")


def union_records(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts before comments: src tells them apart and comes first in every order."""
    return posts.withColumn("src", F.lit(0)).unionByName(comments.withColumn("src", F.lit(1)))


def read_records(spark: SparkSession, posts: str, comments: str, source: str = "community_forum", strict: bool = False) -> DataFrame:
    """All lines of both files, normalized, duplicates and malformed lines included."""
    lines = read_lines if strict else read_json_lines
    read = lambda path, of_comments: normalize(lines(spark, path), of_comments, source, keep=["file", "block"], strict=strict)
    return union_records(read(posts, False), read(comments, True))


def distinct_records(lines: DataFrame, copies: str | None = None) -> DataFrame:
    """Well-formed lines, the first of each id; one id space for posts and comments."""
    order = [c for c in ORDER if c in lines.columns]
    return first_of_each(lines.where(~F.col("malformed")), ["id"], order, copies)


def line_counts() -> list[Column]:
    """Figures over all lines."""
    return [F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed")).alias("well_formed")]


def health_counts() -> list[Column]:
    """Figures over de-duplicated records (src 0: posts, 1: comments)."""
    post, comment = F.col("src") == 0, F.col("src") == 1
    deleted = (F.col("author") == DELETED_AUTHOR) | F.col("body").isin(DELETED_BODIES)
    dated = F.nullif("created_at", F.lit(""))
    return [
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(post).alias("posts"),
        F.count_if(comment).alias("comments"),
        F.count_if(deleted).alias("deleted"),
        F.count_if(post & (F.col("title") == "") & (F.col("body") == "")).alias("empty_posts"),
        F.count_if(comment & (F.col("body") == "")).alias("empty_comments"),
        F.min(dated).alias("min_date"),
        F.max(dated).alias("max_date"),
    ]


def health(records: DataFrame) -> DataFrame:
    """One row of figures over de-duplicated records."""
    return records.agg(*health_counts())
