"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs without punctuation, symbols or white space of any script. Every mask of MASKS, laid on
every position, hashes the words under its ones and ignores those under its zeros. The seeds of the
benchmark and of the documents are joined on their hashes; each hit fixes an alignment of an item with
a document, and the overlap around it is verified: a window of WINDOW aligned words that holds the
seed must agree in all but ALLOWED of them. Items of fewer words are a window of their own with a
tolerance in proportion (one word from 7 words on, none below), and items too short for the masks
are looked up whole. The masks find every window that is tolerated (tests check all placements).

A seed goes with the words around it, SIDE on either side, as hashes; so a hit is verified where the
join finds it, and neither texts nor items are gathered. Seeds of documents pass a bit table before they
are shuffled. It has BITS_A_SEED bits for each distinct seed of the benchmark (LEAST_BITS at least), which let 0.4 % of
all other positions pass at most, and it is built by tasks, a block of bits each. A benchmark of more seeds than
TABLE_SEEDS is worked off in slices of the seeds' hashes: the texts are read once for each, so the table
stays within its bound and as tight. Within one text or item equal seeds
with equal surroundings count once. The seeds of the benchmark are broadcast only if they are few
(SEED_ROWS), else the join shuffles. Hashes are 64 bits under a random key drawn for each run.

Defined cases: null and empty texts or items match nothing; item ids may be of any type that can be ordered, and a null
one is reported as null; repeated items all are reported, in ascending order; repeated documents get the same answer;
texts and items of any length are read whole; an empty table gives no rows, an empty benchmark leaves every document
clean; other columns pass through, and those named as an output column are replaced.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, boxed, column, discard, doc_words, free_name, materialize, mix, new_key, packs_of, slices, text_keys, tidy

WINDOW, ALLOWED = 13, 2
MASKS = ("11111", "11011", "1100111")
SIDE = WINDOW - 1
BITS_A_SEED, LEAST_BITS, BLOCK = 32, 1 << 24, 1 << 18
#: Distinct seeds of the benchmark that one bit table holds: 64 MB at most.
TABLE_SEEDS = 1 << 24
SEED_ROWS = 1 << 17
_DROP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))



@functools.cache
def odd(beyond: bool) -> re.Pattern:
    """Runs of punctuation, symbols, separators and controls between ASCII and U+FFFF, or beyond: apart, since a set of both is searched range by range."""
    ranges: list[list[int]] = []
    for c in range(0x10000, sys.maxunicode + 1) if beyond else range(0x80, 0x10000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "PSZ" or kind in ("Cc", "Cf"):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]+")


#: What stands in a document's or an item's surroundings beyond its ends.
NO_WORD, NO_ITEM = np.uint64(0), np.uint64(1)


def normal(text: str | None) -> bytes:
    """UTF-8 of a text with each letter lower-cased on its own, whatever stands around it, and a space for all that belongs to no word."""
    text = text or ""
    if not text.isascii():
        text = odd(False).sub(" ", text.replace("\u03a3", "\u03c3").replace("\u0130", "i"))
        if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text):  # it has characters beyond U+FFFF
            text = odd(True).sub(" ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(_DROP)


def window_of(words: int) -> tuple[int, int]:
    """(words of the window that an item is judged by, words of it that must agree)"""
    window = min(words, WINDOW)
    return window, window - window * ALLOWED // WINDOW


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask's ones, for every position where the mask fits."""
    n = len(hashes) - len(mask) + 1
    total = np.full(max(n, 0), int("1" + mask, 2), np.uint64)
    if n > 0:
        for k, c in enumerate(mask):
            if c == "1":
                total = mix(total ^ hashes[k : k + n]) + np.uint64(k + 1)
    return total


def surroundings(hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, outside: np.uint64) -> np.ndarray:
    """The SIDE words before each place and the SIDE + 1 from it on; `outside` for those not in [low, high)."""
    around = at[:, None] + np.arange(-SIDE, SIDE + 1)
    inside = (around >= low[:, None]) & (around < high[:, None])
    return np.where(inside, hashes[np.clip(around, 0, max(len(hashes) - 1, 0))], outside)


def item_seeds(key: int):
    """A map of items to their seeds: item, seed, words of the item, surroundings; equal ones of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "seed", "n", "around"]
        for b in slices(batches, 200):
            out = []
            for item, text in zip(column(b, "item").to_pylist(), column(b, "text").to_pylist(), strict=True):
                words = doc_words([normal(text)], key)[0]
                n, found = len(words), set()
                for mask in MASKS if n >= len(MASKS[0]) else ("1" * n,):
                    got = seeds(words, mask) if n else words
                    at = np.arange(len(got))
                    around = surroundings(words, at, np.zeros(len(got), int), np.full(len(got), n), NO_ITEM)
                    found |= set(zip(got.view(np.int64).tolist(), (x.tobytes() for x in around), strict=True))
                out += [(item, seed, n, around) for seed, around in sorted(found)]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "around" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

    return run


class SeedFilter:
    """A bit table: two bits of a hash, of its highest bits and of some in the middle. A small table is unpacked, a byte a bit, to be looked up in one step."""

    def __init__(self, packed: bytes, part: tuple[int, int]):
        self.packed, self.part = np.frombuffer(packed, np.uint8), part
        self.size = 8 * len(packed)
        self.bits = np.unpackbits(self.packed, bitorder="little").view(bool) if self.size <= LEAST_BITS else None

    def has(self, bit: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return self.bits[bit]
        return (self.packed[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).view(bool)

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes of slice `part` (number, slices) whose two bits are set."""
        number, slices_ = self.part
        first, second = shifts(self.size)
        at = np.flatnonzero(self.has(hashes >> np.uint64(first)))
        at = at[self.has(hashes[at] >> np.uint64(second) & np.uint64(self.size - 1))]
        return at if slices_ == 1 else at[hashes[at] % np.uint64(slices_) == np.uint64(number)]


def shifts(size: int) -> tuple[int, int]:
    """By how much a hash is shifted for its two bits in a table of `size` bits, a power of two: what the first leaves fits the table."""
    return 64 - (size.bit_length() - 1), 12


def document_seeds(key: int, masks: tuple[str, ...], shipped, part: tuple[int, int]):
    """A map of texts to their seeds of slice `part` that the bit table lets pass: k1, k2, seed, surroundings; equal ones of a text once."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "seed", "around"]
        table = SeedFilter(shipped.value, part)
        for b in slices(batches):
            k1, k2 = column(b, "k1").to_pylist(), column(b, "k2").to_pylist()
            texts = [normal(t) for t in column(b, "text").to_pylist()]
            out = []
            for i, j in packs_of(texts):
                hashes, offsets = doc_words(texts[i:j], key)
                found = set()
                for mask in masks:
                    got = seeds(hashes, mask)
                    at = table.passing(got)
                    doc = np.searchsorted(offsets, at, "right") - 1
                    at, doc = at[whole := at + len(mask) <= offsets[doc + 1]], doc[whole]
                    for lo in range(0, len(at), 20_000):
                        some, of = at[lo : lo + 20_000], doc[lo : lo + 20_000]
                        around = surroundings(hashes, some, offsets[of], offsets[of + 1], NO_WORD)
                        found |= set(zip(of.tolist(), got[some].view(np.int64).tolist(), (x.tobytes() for x in around), strict=True))
                out += [(k1[i + d], k2[i + d], seed, around) for d, seed, around in sorted(found)]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "around" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

    return run


def agreements(document: np.ndarray, item: np.ndarray, words: int) -> np.ndarray:
    """Per hit the most agreeing words of a window that holds the seed's first word and lies in both, 0 if they are too few."""
    window, least = window_of(words)
    first = SIDE - window + 1
    cut = slice(first, SIDE + window)
    same = np.cumsum(np.pad(document[:, cut] == item[:, cut], ((0, 0), (1, 0))), axis=1)
    missing = np.cumsum(np.pad((document[:, cut] == NO_WORD) | (item[:, cut] == NO_ITEM), ((0, 0), (1, 0))), axis=1)
    held = np.where(missing[:, window:] == missing[:, :-window], same[:, window:] - same[:, :-window], 0).max(axis=1)
    return np.where(held >= least, held, 0)


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits whose surroundings agree, with the number of words that do."""
    for b in slices(batches, 5000):
        words = column(b, "n").to_numpy()
        matrix = lambda name, b=b: np.frombuffer(b"".join(column(b, name).to_pylist()), np.uint64).reshape(-1, 2 * SIDE + 1)
        document, item = matrix("around"), matrix("item_around")
        agree = np.zeros(b.num_rows, np.int64)
        for n in np.unique(np.minimum(words, WINDOW)).tolist():
            some = np.flatnonzero(np.minimum(words, WINDOW) == n)
            agree[some] = agreements(document[some], item[some], n)
        hit = pa.array(agree > 0)
        cols = [*(column(b, k).filter(hit) for k in ("k1", "k2", "item")), pa.array(agree[agree > 0], pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "item", "agree"])


def bit_table(known: DataFrame, seeds_in_all: int) -> bytes:
    """Two bits for each of the distinct seeds, made by tasks in blocks; the driver joins the blocks."""
    size = LEAST_BITS
    while size < BITS_A_SEED * seeds_in_all:
        size *= 2
    block = min(BLOCK, size)

    def run(key: tuple, bits: pa.Table) -> pa.Table:
        packed = np.zeros(block, bool)
        packed[bits.column("low").to_numpy()] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(packed, bitorder="little").tobytes()], pa.binary())})

    bit = F.explode(F.array(*(F.shiftrightunsigned("seed", k).bitwiseAND(size - 1) for k in shifts(size)))).alias("bit")
    bits = known.select(bit).distinct().select((F.col("bit") / block).cast("long").alias("block"), (F.col("bit") % block).alias("low"))
    out = bytearray(size // 8)
    for r in bits.groupBy("block").applyInArrow(run, "block long, bits binary").collect():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = r["bits"]
    return bytes(out)


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", seed_rows: int = SEED_ROWS, table_seeds: int = TABLE_SEEDS
) -> DataFrame:
    """(k1, k2, items, overlap): the texts, by two hashes of each, in which items were found; written to the shared folder."""
    key, spark = new_key(), docs.sparkSession
    items = materialize(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("id"), F.col(item_text).alias("text")), "items")
    known = materialize(items.select("item", "text").mapInArrow(item_seeds(key), "item long, seed long, n long, around binary"), "seeds")
    short = [r["n"] for r in known.where(F.col("n") < len(MASKS[0])).select("n").distinct().collect()]  # at most four lengths
    masks = (*MASKS, *("1" * n for n in sorted(short)))
    distinct = known.select("seed").distinct()
    n_seeds = distinct.count()
    slices_ = max(1, -(-n_seeds // table_seeds))
    one, two = text_keys(text)
    texts = docs.select(one.alias("k1"), two.alias("k2"), F.col(text).alias("text"))
    hits = []
    for k in range(slices_):
        # the remainder of the seed as an unsigned number
        own = F.pmod(F.pmod("seed", F.lit(slices_)) + F.when(F.col("seed") < 0, (1 << 64) % slices_).otherwise(0), F.lit(slices_)) == k
        shipped = spark.sparkContext.broadcast(bit_table(distinct.where(own), -(-n_seeds // slices_)))
        hits.append(materialize(texts.mapInArrow(document_seeds(key, masks, shipped, (k, slices_)), "k1 long, k2 long, seed long, around binary"), "hits"))
        shipped.unpersist()
    met = functools.reduce(DataFrame.unionByName, hits).join(bounded(known.withColumnRenamed("around", "item_around"), seed_rows), "seed").select("k1", "k2", "item", "n", "around", "item_around")
    found = met.mapInArrow(verified, "k1 long, k2 long, item long, agree int").groupBy("k1", "k2", "item").agg(F.max("agree").alias("agree"))
    named = found.join(bounded(items.select("item", "id")), "item")
    held = named.groupBy("k1", "k2").agg(F.array_sort(F.transform(F.collect_list(F.struct("id")), lambda x: x["id"])).alias("items"), F.max("agree").alias("overlap"))
    held = materialize(held, "contaminated")
    discard(known, items, *hits)
    return held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", keep: list[str] | None = None, seed_rows: int = SEED_ROWS
) -> DataFrame:
    """`docs` plus __items (ids of the items found) and __overlap (most agreeing words of one window, 0 if there is none)."""
    made = ["__items", "__overlap"]
    kept, names = boxed(docs, docs.columns if keep is None else keep, made)
    held = contaminated_texts(docs, benchmark, text, item_key, item_text, seed_rows)
    one, two = text_keys(text)
    ids = F.size("items") if benchmark.schema[item_key].dataType.typeName() != "string" else F.octet_length(F.concat_ws(" ", "items"))
    rows = docs.select(*kept, one.alias("k1"), two.alias("k2")).join(bounded(held, weight=ids + 4), ["k1", "k2"], "left")
    none = F.array().cast(held.schema["items"].dataType)
    return rows.select(*(f"c{k}" for k in range(len(names))), F.coalesce("items", none), F.coalesce("overlap", F.lit(0))).toDF(*names, *made)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no item was found, with their columns."""
    held = contaminated_texts(docs, benchmark, text)
    names = [free_name(docs, k) for k in ("__k1", "__k2")]
    keyed = docs.withColumns(dict(zip(names, text_keys(text), strict=True)))
    return keyed.join(bounded(held.select("k1", "k2").toDF(*names)), names, "left_anti").select(*docs.columns)
