"""Hand-off to a trainer: a table as Arrow IPC shards, one or more a partition, and a reader that picks rows by number without Spark.

Tasks write their rows in the shared folder as they stand in the DataFrame and report (file, rows); the driver gets a row per file and
writes the manifest, which fixes the numbers of rows. A lost task's files are named by no manifest. The reader maps a
shard into memory where the file system is local and reads it by record batch elsewhere, so a trainer's worker holds the batches it looks at.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
#: Schemes of Spark's URIs and those by which Arrow opens the same store.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}
SHARD_ROWS, BATCH_ROWS = 1 << 18, 4096


def arrow_uri(uri: str) -> str:
    """A URI of Spark's as Arrow's file systems know it; ValueError if they know none for its scheme. A path without a scheme is local."""
    scheme, mark, rest = uri.partition(":")
    if not mark or "/" in scheme:
        return uri
    if scheme not in SCHEMES:
        raise ValueError(f"nothing can be kept under {uri}: the schemes are {', '.join(sorted(SCHEMES))}")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES[scheme]}:{rest}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    uri = arrow_uri(uri)
    return fs.FileSystem.from_uri(uri) if ":" in uri.partition("/")[0] else (fs.LocalFileSystem(), uri)


def write_shards(df: DataFrame, folder: str, shard_rows: int = SHARD_ROWS, batch_rows: int = BATCH_ROWS) -> dict:
    """Write `df` under `folder` and return its manifest: files in the order of the DataFrame's partitions, their rows, and the total. An empty table has no files."""
    store, base = opened(folder)
    store.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        part, attempt, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        writer = sink = None
        rows, name = 0, ""
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                if writer is None:
                    name = f"{part:06}-{number:06}-{attempt}.arrow"
                    sink = store.open_output_stream(f"{base}/{name}")
                    writer, rows, number = pa.ipc.new_file(sink, whole.schema), 0, number + 1
                piece = whole.slice(at, min(batch_rows, shard_rows - rows))
                writer.write_batch(piece)
                at, rows = at + piece.num_rows, rows + piece.num_rows
                if rows >= shard_rows:
                    writer.close()
                    sink.close()
                    writer = None
                    yield listed(part, name, rows)
        if writer is not None:
            writer.close()
            sink.close()
            yield listed(part, name, rows)

    def listed(part: int, name: str, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": [part], "name": [name], "rows": [rows]}, schema=pa.schema([("part", pa.int64()), ("name", pa.string()), ("rows", pa.int64())]))

    made = sorted((r["part"], r["name"], r["rows"]) for r in df.mapInArrow(run, "part long, name string, rows long").collect())
    manifest = {"columns": df.columns, "schema": json.loads(df.schema.json()), "files": [{"name": name, "rows": rows} for _, name, rows in made], "rows": sum(rows for *_, rows in made)}
    with store.open_output_stream(f"{base}/{MANIFEST}") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def shard_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a hand-off as a DataFrame: its files are dealt out, and each is read batch by batch."""
    store, base = opened(folder)
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    schema = StructType.fromJson(manifest["schema"])
    names = [(f["name"],) for f in manifest["files"]]
    if not names:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as f:
                    reader = pa.ipc.open_file(f)
                    yield from (reader.get_batch(i) for i in range(reader.num_record_batches))

    return spark.createDataFrame(names, "name string").repartition(min(len(names), 8 * spark.sparkContext.defaultParallelism)).mapInArrow(read, schema)


class Shards:
    """Rows of a hand-off by number; `select` gives a view of some of them, in any order."""

    def __init__(self, folder: str, rows: range | list[int] | None = None):
        self.folder, (self.store, self.base) = folder, opened(folder)
        with self.store.open_input_stream(f"{self.base}/{MANIFEST}") as f:
            self.manifest = json.loads(f.read())
        self.column_names = self.manifest["columns"]
        self.starts = [0, *itertools.accumulate(f["rows"] for f in self.manifest["files"])]
        self.rows = range(self.starts[-1]) if rows is None else rows

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "rows": self.rows}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def __len__(self) -> int:
        return len(self.rows)

    @functools.lru_cache(maxsize=8)  # noqa: B019
    def shard(self, k: int) -> tuple[pa.ipc.RecordBatchFileReader, list[int]]:
        path = f"{self.base}/{self.manifest['files'][k]['name']}"
        source = pa.memory_map(path) if isinstance(self.store, fs.LocalFileSystem) else self.store.open_input_file(path)
        reader = pa.ipc.open_file(source)
        return reader, [0, *itertools.accumulate(reader.get_batch(i).num_rows for i in range(reader.num_record_batches))]

    @functools.lru_cache(maxsize=64)  # noqa: B019
    def batch(self, k: int, i: int) -> pa.RecordBatch:
        return self.shard(k)[0].get_batch(i)

    def row(self, number: int) -> dict:
        """The row of that number in the whole table."""
        k = bisect.bisect_right(self.starts, number) - 1
        _, edges = self.shard(k)
        i = bisect.bisect_right(edges, number - self.starts[k]) - 1
        return self.batch(k, i).slice(number - self.starts[k] - edges[i], 1).to_pylist()[0]

    def __getitem__(self, index: int) -> dict:
        if not -len(self) <= index < len(self):
            raise IndexError(index)
        return self.row(self.rows[index])

    def __iter__(self) -> Iterator[dict]:
        return map(self.row, self.rows)

    def select(self, indices: range | list[int]) -> Shards:
        """A view of the rows at `indices` of this one."""
        some = self.rows[indices.start : indices.stop : indices.step] if isinstance(indices, range) and isinstance(self.rows, range) and indices.start >= 0 and indices.step > 0 else [self.rows[i] for i in indices]
        return Shards(self.folder, some)

    def batches(self, size: int) -> Iterator[list[dict]]:
        """Rows in order, `size` at a time."""
        rows = iter(self)
        while some := list(itertools.islice(rows, size)):
            yield some
