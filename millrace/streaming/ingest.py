"""Continuous ingestion: the records of `operators.ingest` from folders of JSON lines that grow, the first of each id by the order of files and lines.

A file arrives when it was last written, so a replay of files whose copies of an id arrive within `delay` of each other gives
the same records however they fall into micro-batches. The first row of an id, by (src, file, block, ord), is held in state until the
watermark has passed its first arrival by `delay`, then given out; so a post that arrives after a comment of its id,
or a file that arrives after a later one, still wins. The id is remembered for `remember` more, during which copies are
dropped, and then forgotten: state is bounded by what arrives within delay + remember.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import strip
from ..operators.ingest import ORDER, normalize, union_records
from ..sources.files import open_objects

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def milliseconds(at: datetime) -> int:
    return round((at if at.tzinfo else at.astimezone(UTC)).timestamp() * 1000)


class FirstWins(StatefulProcessor):
    """Two states an id: the least row while it is held, then a mark while it is remembered. One timer an id at any time."""

    def __init__(self, schema: T.StructType, remember_ms: int):
        self.schema, self.remember_ms = schema, remember_ms
        self.order = [schema.fieldNames().index(c) for c in ORDER]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.done = handle.getValueState("done", T.StructType([T.StructField("until", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N803
        if self.done.exists():
            until = self.done.get()[0]
            if timerValues.getCurrentWatermarkInMs() < until:
                return iter(())
            # forgotten by now, though its timer only fires after this batch's rows
            self.done.clear()
            self.handle.deleteTimer(until)
        place = lambda row: tuple(row[k] for k in self.order)
        old = self.held.get() if self.held.exists() else None
        best, arrived = old, None
        for row in rows:
            at = row["arrived"]
            arrived = at if arrived is None else min(arrived, at)
            row = tuple(row[f] for f in self.schema.fieldNames())
            if best is None or place(row) < place(best):
                best = row
        if best is not old:
            self.held.update(tuple(best))
        if old is None:
            self.handle.registerTimer(milliseconds(arrived) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N803
        if not self.held.exists():
            self.done.clear()
            return
        found = self.held.get()
        self.held.clear()
        until = expiredTimerInfo.getExpiryTimeInMs() + self.remember_ms
        self.done.update((until,))
        self.handle.registerTimer(until)
        yield Row(**dict(zip(self.schema.fieldNames(), found, strict=True)))


def first_wins(records: DataFrame, delay: str = "1 hour", remember: str = "1 hour") -> DataFrame:
    """The first row of each id of a stream of records with `arrived`, given out when the watermark has passed the id's first arrival. Needs the RocksDB state store."""
    if records.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"first_wins keeps typed state and timers: set {PROVIDER} to {ROCKSDB}")
    schema = T.StructType([f for f in records.schema if f.name != "arrived"])
    wait = records.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {remember})").first()[0]
    grouped = records.withWatermark("arrived", delay).groupBy("id")
    return grouped.transformWithState(FirstWins(schema, wait), outputStructType=schema, outputMode="append", timeMode="eventTime")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their number within the task, which reads the lines of a block in order."""
    at = 0
    for b in batches:
        yield b.append_column("ord", pa.array(range(at, at + b.num_rows), pa.int64()))
        at += b.num_rows


def stream_lines(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """(file, block, ord, line, arrived) of the non-blank lines of the files that arrive in `folder`."""
    reader = spark.readStream if files_at_once is None else spark.readStream.option("maxFilesPerTrigger", files_at_once)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("arrived")
    lines = reader.text(folder).select(strip(F.make_valid_utf8("value")).alias("line"), *place).where("line <> ''")
    return lines.mapInArrow(numbered, "line string, file string, block long, arrived timestamp, ord long")


def stream_records(
    spark: SparkSession, posts: str, comments: str, source: str = "community_forum", delay: str = "1 hour", remember: str = "1 hour", files_at_once: int | None = None
) -> DataFrame:
    """Well-formed records of the files that arrive in two folders, one id space for posts and comments, the first of each id."""

    def read(folder: str, of_comments: bool) -> DataFrame:
        raw = open_objects(stream_lines(spark, folder, files_at_once))
        return normalize(raw, of_comments, source, keep=["file", "block", "arrived"]).where(~F.col("malformed")).drop("malformed")

    return first_wins(union_records(read(posts, False), read(comments, True)), delay, remember)
