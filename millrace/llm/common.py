"""Shared pieces: durable intermediate tables, size-checked broadcasts and the byte-level text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import re
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of fixed-width keys that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one is set on a local master only: on a cluster nobody else would see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the driver's JVM removes when it exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str = "step", batch_rows: int = 1000) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back.

    Python workers get at most `batch_rows` rows at a time meanwhile, so that rows with long texts need
    little memory on both sides; the session's own setting is restored.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    old = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(batch_rows, int(old))) if int(old) > 0 else str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, old)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and nothing reads any more; without it they go when the driver exits."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_keys(text: str) -> tuple[Column, Column]:
    """128 bits by which equal texts are known; null counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(body), F.xxhash64(F.lit("second"), body)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame, keep: list[str], made: list[str]) -> tuple[list[Column], list[str]]:
    """The columns `keep` under the names c0, c1, ..., which clash with nothing, and their own names; those that `made` replaces go."""
    names = [c for c in keep if c not in made]
    return [quoted(c).alias(f"c{k}") for k, c in enumerate(names)], names


def give_back() -> None:
    """Give the free memory of a Python worker, which lives on after its task, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(drop: Callable[[], None] | None = None) -> Callable:
    """A decorator of maps of batches: at the end of a task the worker, which lives on, runs `drop` and gives its free memory back to the system."""

    def wrap(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @functools.wraps(rows)
        def run(batches: Iterator) -> Iterator:
            try:
                yield from rows(batches)
            finally:
                if drop:
                    drop()
                give_back()

        return run

    return wrap


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """`df` (already materialized, narrow rows) with a broadcast hint if it has at most `limit` rows, else as it is. Rows that may be wide count by `weight`."""
    size = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


#: Bits of a sieve: for each key at least, at least, and at most (32 MB; more keys let more strange ones pass).
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST, SIEVE_BLOCK = 8, 1 << 16, 1 << 28, 1 << 18


def sieve(keys: DataFrame, n: int) -> Broadcast:
    """A bit table of the `n` 64-bit keys in the one column of `keys`, shipped to the workers: `sieved` lets all of them pass and, up to 32 million keys, at most one in eight others."""
    size = SIEVE_LEAST
    while size < min(SIEVE_BITS * n, SIEVE_MOST):
        size *= 2
    block, name = min(SIEVE_BLOCK, size), keys.columns[0]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = sieve_bits(column(b, name), size)
            yield pa.RecordBatch.from_arrays([pa.array(bit // block), pa.array(bit % block)], ["block", "low"])

    def run(key: tuple, found: pa.Table) -> pa.Table:
        packed = np.zeros(block, bool)
        packed[found.column("low").to_numpy()] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(packed, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(size // 8)
    for r in keys.mapInArrow(bits, "block long, low long").groupBy("block").applyInArrow(run, "block long, bits binary").collect():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = r["bits"]
    return keys.sparkSession.sparkContext.broadcast(bytes(out))


def sieve_bits(keys: pa.Array, size: int) -> np.ndarray:
    return (mix(keys.to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def sieved(keys: pa.Array, table: bytes) -> np.ndarray:
    """For each key whether the table has its bit."""
    bit = sieve_bits(keys, 8 * len(table))
    return (np.frombuffer(table, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).view(bool)


def may_be_in(shipped: Broadcast, key: str) -> Column:
    """Whether a sieve lets a key pass. Only the key goes to the Python workers."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(sieved(a, shipped.value))

    return run(F.col(key))


def positions(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """`df`, written to the shared folder, with `name`: the place of each row, from 0 on, among those of equal `by`.

    Rows are dealt out by ranges of (`by`, `order`) and numbered in each range; a group that spans several is carried on from the ranges before, so it may hold any share of the rows.
    """
    ranged = materialize(df.repartitionByRange(F.col(by).asc_nulls_first(), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range", by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # groups that lie in one range begin at 0
    spread = counts.withColumn("__before", F.sum("__n").over(before)).where("__before IS NOT NULL").select("__range", F.col(by).alias("__by"), "__before")
    place = F.row_number().over(Window.partitionBy("__range", by).orderBy(*order)) - 1
    out = ranged.withColumn(name, place).join(bounded(materialize(spread, "spread")).withColumnRenamed("__range", "__at"), (F.col("__range") == F.col("__at")) & F.col(by).eqNullSafe(F.col("__by")), "left")
    return out.withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("long")).drop("__range", "__at", "__by", "__before")


def with_copies(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """`rows` plus copy: 1, or for rows that share `key` their place in `order`. Only rows whose key repeats (found by counts) are ranked, so texts in `order` stay where they are."""
    mark = F.xxhash64(*(c for k in key for c in (F.col(k).isNull(), F.col(k))))
    marked = rows.withColumn("__mark", mark)
    again = materialize(marked.groupBy("__mark").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__mark"), "again")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(1).cast("long"))
    hint = bounded(again)
    alone = marked.join(hint, "__mark", "left_anti").drop("__mark").withColumn("copy", F.lit(1).cast("long"))
    group = F.to_json(F.struct(*key))
    tied = positions(marked.join(hint, "__mark", "left_semi").drop("__mark").withColumn("__group", group), "__group", [F.col(c).asc() for c in order], "copy")
    return alone.unionByName(tied.withColumn("copy", F.col("copy") + 1).drop("__group"))


def annotate(docs: DataFrame, text: str, keep: list[str], schema: str, work: Callable[[list[str | None]], list[pa.Array]], drop: Callable[[], None] | None = None, rows: int = 500) -> DataFrame:
    """The columns `keep` of `docs` plus those of `schema`, which `work` makes of `rows` texts at a time. Only the text goes to the Python workers."""
    kind = T.StructType.fromDDL(schema)
    kept, names = boxed(docs, keep, kind.names)

    @tidy(drop)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            parts = [work(a.slice(i, rows).to_pylist()) for i in range(0, max(len(a), 1), rows)]
            yield pa.StructArray.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], kind.names)

    made = F.arrow_udf(run, kind).asNondeterministic()(quoted(text)).alias("made")
    out = docs.select(*kept, made)
    return out.select(*(f"c{k}" for k in range(len(names))), *(f"made.{k}" for k in kind.names)).toDF(*names, *kind.names)


# --- byte-level text kernels -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words of more bytes are hashed by BLAKE2b one by one.
BLOCKS = 8


def new_key() -> int:
    """A random key for `word_hashes`, drawn on the driver once per run and shipped with its tasks: no text can be made to collide."""
    return secrets.randbits(64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: bytes, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keyed 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a buffer; equal words have equal hashes anywhere under one key.

    A word is read in blocks of 8 bytes, and each is mixed into the state of the one before, all words at a time.
    """
    a = np.frombuffer(buf, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[a].view(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    sizes = ends - starts
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    padded = np.frombuffer(buf + bytes(8), np.uint8)
    at = np.ndarray((len(a) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes that begin anywhere
    secret = mix(np.uint64([key & 0xFFFFFFFFFFFFFFFF, (key ^ 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF]))
    state = mix(sizes.astype(np.uint64) ^ secret[0])
    mask = np.uint64([(1 << 8 * k) - 1 for k in range(9)])
    todo = np.arange(len(starts))
    for k in range(BLOCKS):
        left = sizes[todo] - 8 * k
        state[todo] = mix(state[todo] ^ (at[starts[todo] + 8 * k] & mask[np.minimum(left, 8)])) + secret[1]
        todo = todo[left > 8]
        if not len(todo):
            break
    salt = secret.tobytes()
    for i in todo.tolist():
        state[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, key=salt).digest(), "little")
    return starts, state


def packs_of(items: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of items of about `limit` bytes in all; a longer item is a range of its own."""
    i = size = 0
    for j, x in enumerate(items):
        if j > i and size + len(x) > limit:
            yield i, j
            i, size = j, 0
        size += len(x) + 1
    if i < len(items):
        yield i, len(items)


def doc_words(items: list[bytes], key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all items and, per item, the offset of its first word (one more offset ends the last)."""
    starts, hashes = word_hashes(b" ".join(items), key)
    begins = np.cumsum([0, *(len(x) + 1 for x in items)])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(items: list[bytes], key: int = 0, width: int = 5) -> Iterator[np.ndarray]:
    """Per item (lower-cased bytes) the sorted distinct hashes of its word shingles; a shorter text is one shingle of all its words."""
    hashes, offsets = doc_words(items, key)
    m = len(hashes) - width + 1
    rolled = np.zeros(max(0, m), np.uint64)
    for k in range(width if m > 0 else 0):
        rolled = mix(rolled ^ hashes[k : k + m]) + np.uint64(k + 1)
    for i, j in zip(offsets[:-1], offsets[1:], strict=True):
        if j - i >= width:
            s = np.sort(rolled[i : j - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif j > i:
            whole = hashlib.blake2b(hashes[i:j].tobytes(), digest_size=8).digest()
            yield np.frombuffer(whole, np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column(batch, name).cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
