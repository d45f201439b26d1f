"""Readers and writers: tolerant JSON lines, strict benchmark files, zstd Parquet, JSON lines and JSON reports."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip

FALLBACK = "export"


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path)"""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)


def resolve_path(spark: SparkSession, path: str) -> str:
    """`path`, or the file of that name in the `export` folder beside it if only that exists."""
    folder, _, name = path.rpartition("/")
    other = f"{folder}/{FALLBACK}/{name}" if folder else f"{FALLBACK}/{name}"
    return other if not exists(spark, path) and exists(spark, other) else path


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a path, 0 if there is none."""
    fs, where = filesystem(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def line_place() -> list[Column]:
    """file, block, ord: where a line stands, files by name, blocks of a file by offset, lines of a block by number."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, ord, line): the non-blank lines of a file or folder, stripped; (file, block, ord) is their order. Invalid UTF-8 becomes U+FFFD; a missing file has no lines."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, block long, ord long, line string")
    return spark.read.text(path).select(*line_place(), strip(F.make_valid_utf8("value")).alias("line")).where("line <> ''")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, ord, v): `read_lines` with a VARIANT object per line, null where the line is not a JSON object.

    A line must end with the closing brace, since the parser ignores what follows a value.
    """
    return open_objects(read_lines(spark, path))


def open_objects(lines: DataFrame) -> DataFrame:
    """`lines` with v, the object that a line holds or its envelope's, in place of line; null if it holds none."""
    parsed = lines.withColumn("v", F.when(F.endswith("line", F.lit("}")), F.try_parse_json("line"))).drop("line")
    whole = parsed.withColumn("v", F.when(kind(F.col("v")).startswith("OBJECT"), F.col("v")))
    inner = F.try_variant_get("v", "$.data", "variant")
    return whole.withColumn("v", F.when(kind(inner).startswith("OBJECT"), inner).otherwise(F.col("v")))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items, strictly; blank lines are skipped."""
    return spark.read.schema(schemas.BENCHMARK).option("mode", "FAILFAST").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; FileNotFoundError if it is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def writer(df: DataFrame, group_rows: int | None = None):
    """A zstd Parquet writer; `group_rows` bounds the rows of a row group."""
    out = df.write.mode("overwrite").option("compression", "zstd")
    return out.option("parquet.block.row.count.limit", group_rows) if group_rows else out


def write_table(df: DataFrame, path: str, split_by: str | None = None, group_rows: int | None = None) -> None:
    """zstd Parquet, one folder per value of `split_by` if given. Zero rows leave a file with the schema alone."""
    out = writer(df, group_rows)
    (out.partitionBy(split_by) if split_by else out).parquet(path)


def write_parts(df: DataFrame, flag: str, paths: dict[bool, str | None], group_rows: int | None = None) -> None:
    """One write of `df` into two tables by a boolean column, which both keep: a folder per value beside the first path, then moved. A table without a path is deleted, one without rows is a file with the schema alone."""
    spark, whole = df.sparkSession, f"{paths[True]}.parts"
    writer(df.withColumn("__part", F.col(flag)), group_rows).partitionBy("__part").parquet(whole)
    fs, base = filesystem(spark, whole)
    for value, path in paths.items():
        _, made = filesystem(spark, f"{whole}/__part={str(value).lower()}")
        if path is None:
            continue
        _, target = filesystem(spark, path)
        fs.delete(target, True)
        if not fs.exists(made):
            write_table(spark.createDataFrame([], df.schema), path)
        elif not fs.rename(made, target):
            raise OSError(f"{made} could not be moved to {path}")
    fs.delete(base, True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(report: dict, path: str, spark: SparkSession | None = None) -> dict:
    """Write a report with its UTC time as indented JSON, through the file system of `path` if a session is given."""
    report = {"timestamp_utc": datetime.now(UTC).isoformat()} | report
    text = json.dumps(report, indent=2, ensure_ascii=False, default=str)
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    else:
        fs, where = filesystem(spark, path)
        out = fs.create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
    return report


#: Values of a category column that a report holds itself.
REPORT_VALUES = 10_000


def counts_map(df: DataFrame, key: str, path: str, limit: int = REPORT_VALUES) -> dict[str, int] | dict[str, str]:
    """Rows per value of a category column, for a report. More than `limit` values are all written to `path` as JSON lines, and the report names it."""
    counts = df.groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.limit(limit + 1).collect()
    if len(found) > limit:
        write_json_lines(counts, path)
        return {"file": path}
    return {r.value: r.n for r in sorted(found, key=lambda r: (-r.n, str(r.value)))}
