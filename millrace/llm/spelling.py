r"""Spelling variant grouping: an even-partition pigeonhole join of words that differ by one code point.

A word of L code points is indexed under two segments, its first L // 2 code points and the rest. One
edit leaves one of them whole, so a word of the same length is probed with its own segments and a word that is one
longer with the substrings that an inserted code point may have shifted. Candidates that share a segment
are verified by their edit distance. A pair may meet under both segments if the edit lies at their
border; it counts where the first difference of the two words lies, so pairs need no `distinct`.

A segment that more than CROWD words share is split again: the part in which the edit must lie is halved,
and its words are indexed and probed under the segment and the half that stays whole, until
buckets are small or the part is one code point. So no bucket is compared pair by pair unless it is
small or (nearly) all its words are near each other, and none is dropped.

Counting words is a map that counts a run of texts at a time; only words and their counts are shuffled.

Defined cases: a null text has no words; a null id counts as the empty string; rows that share id
and text count as often as they occur; texts and words of any length are taken whole; an empty table
gives no words; other columns are ignored. Ties of forms go to the smallest word in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, column, discard, materialize, quoted, slices, tidy

LEAST_LENGTH, LEAST_COUNT, DELETED = 5, 3, 97
CROWD = 48
#: Distinct words that a task counts before it hands them on.
HELD = 100_000
#: Latin-1 bytes of a run as they count: A-Z lower-cased, letters from U+00C0 on kept, all else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The runs `[A-Za-z\\u00C0-\\u00FF]+` of a text in Latin-1, A-Z lower-cased; a byte is a code point."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def words_of(ident: str, text: str, least: int = LEAST_LENGTH, deleted: int = DELETED) -> Counter[bytes]:
    """Words of a document with their counts: of a run whose CRC-32 behind the id `deleted` divides one code point is missing."""
    found: Counter[bytes] = Counter()
    start = zlib.crc32(f"{ident}:".encode())
    for run, n in Counter(runs(text)).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % deleted == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least `least` times in all documents."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for b in slices(batches, 100):
            for ident, body in zip(column(b, "key").to_pylist(), column(b, "text").to_pylist(), strict=True):
                total.update(words_of(ident or "", body or ""))
                if len(total) >= HELD:
                    yield from handed(total)
                    total.clear()
        yield from handed(total)

    def handed(total: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        items = list(total.items())
        for i in range(0, len(items), 10_000):
            words, counts = zip(*items[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(counts, pa.int64())], ["word", "k"])

    counted = docs.select(quoted(key).cast("string").alias("key"), quoted(text).alias("text")).mapInArrow(run, "word string, k long")
    return counted.groupBy("word").agg(F.sum("k").alias("n")).where(F.col("n") >= least)


def segment_key(word: Column, size: Column, low: Column, high: Column, longer: Column) -> Column:
    """A hash of what stays whole when the edit lies in [low, high) of a word of `size`; of a word one longer the part has one code point more."""
    return F.xxhash64(size, low, high, F.left(word, low), F.substr(word, high + longer + 1))


def halves(rows: DataFrame) -> DataFrame:
    """Each row (word, n, size, longer, low, high), whose edit lies in [low, high), under both halves of it, with the key of what then stays whole."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    part = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    split = rows.select("word", "n", "size", "longer", F.explode(F.array(part(F.col("low"), middle), part(middle, F.col("high")))).alias("p")).select("word", "n", "size", "longer", "p.*")
    return split.withColumn("key", segment_key(F.col("word"), F.col("size"), F.col("low"), F.col("high"), F.col("longer")))


def met(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the pairs within buckets of one key that differ by one code point, each pair once."""
    size, low, high, a, b = (F.col(k) for k in ("size", "low", "high", "a", "b"))
    more = F.col("longer")
    index = rows.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), "size", "low", "high")
    probe = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer", F.col("size").alias("b_size"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    same_part = (size == F.col("b_size")) & (low == F.col("b_low")) & (high == F.col("b_high")) & (F.left(a, low) == F.left(b, low)) & (F.substr(a, high + 1) == F.substr(b, high + more + 1))
    ordered = (more == 1) | (b > a)
    here = (high == size) | (F.left(a, high) != F.left(b, high))  # the first difference lies in this part
    middle = lambda c, extra: F.substr(c, low + 1, high - low + extra)
    one_edit = F.levenshtein(middle(a, F.lit(0)), middle(b, more), 1) == 1
    return index.join(probe, "key").where(ordered & same_part & here & one_edit).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, a_n, b, b_n) for any two of `words` (word, n) that differ by exactly one inserted, deleted or replaced code point."""
    length = F.length("word")
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    rows = words.select("word", "n", roles).withColumn("size", (length - F.col("longer")).cast("int")).where("size > 0")
    rows = rows.select("word", "n", "size", "longer", F.lit(0).alias("low"), F.col("size").alias("high"))
    pairs = None
    while True:
        rows = materialize(halves(rows), "segments")
        buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("longer").alias("least"), F.max(F.col("high") - F.col("low")).alias("wide"))
        crowded = materialize(buckets.where((F.col("rows") > crowd) & (F.col("least") == 0) & (F.col("wide") > 1)).select("key"), "crowded")
        hint = bounded(crowded)
        calm = met(rows.join(hint, "key", "left_anti"))
        pairs = calm if pairs is None else pairs.unionByName(calm)
        if crowded.isEmpty():
            return pairs
        rows = rows.join(hint, "key", "left_semi").drop("key")


def variant_groups(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of `words` (word, n): n_near words are near; the form is the near word of largest n if that is at least twice the word's own, the root where the forms end."""
    words = materialize(words.select("word", "n"), "words")
    link = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n"))
    links = near_pairs(words, crowd).select(F.explode(F.array(link("a", "b"), link("b", "a"))).alias("l")).select("l.*")
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    often = -F.col("best.m") >= 2 * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n")
    )
    formed = materialize(formed, "forms")
    return formed.join(bounded(roots(formed)), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling: each round halves the way that is left, and a way has at most log2 of the largest count steps."""
    reached = materialize(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = bounded(reached.select(F.col("word").alias("root"), F.col("root").alias("next")))
        moved = materialize(reached.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(reached)
        reached = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return reached
