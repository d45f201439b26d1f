"""Removal of byte strings that repeat anywhere in the corpus, by interval expansion on a Burrows-Wheeler transform.

A byte goes if it is covered by a MIN_LENGTH-byte string that also starts somewhere else, in the same
document or another; matches never cross documents.

1. Anchors. Every MIN_LENGTH window owns one anchor, the rightmost smallest of the hashes of its
   GRAM-byte substrings (winnowing). Equal windows own equal anchors at equal offsets, so windows only
   need comparing within an anchor's occurrences. An occurrence is the anchor's hash and the context
   that its windows cover, less than two windows long.
2. One aggregate over (anchor) finds the anchors that occur more than once, and those whose contexts
   differ. A bit table of them goes to the tasks that read the texts again, so that hardly any other
   occurrence is shuffled. Where all contexts are equal, every window repeats.
3. The others' contexts are counted by hash, and each distinct one is cut from one text. They are indexed, some anchors per
   index: suffixes are sorted to MIN_LENGTH, the transform is formed, and breadth-first backward
   extension, level by level, gives every common prefix shorter than MIN_LENGTH in increasing order.
   It stops there: boundaries without a value are common prefixes of MIN_LENGTH or more.
4. Runs of repeated windows are merged per text and the bytes removed.

An anchor with more than HOT distinct contexts is split before it is indexed: its windows are dealt
into blocks of neighbouring anchor offsets, and a block's windows by the bytes that all of them
share. Equal windows stay together, so each part is indexed on its own; parts that are still hot are split
into smaller blocks, down to single windows, of which a part has only one. Every index is bounded.
Contexts are told apart by BLAKE2b of their bytes. Identical texts share their spans (keyed by two
64-bit hashes of the text), so copies are not gathered; a long text's places are gathered in parts of
PART window starts.

Defined cases: null text is empty; texts under MIN_LENGTH bytes lose nothing; repeated rows are copies
of each other; null ids are kept as they are; an empty table gives no rows; extra columns pass through, and
those named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, boxed, column, discard, materialize, may_be_in, mix, packs_of, sieve, sieved, slices, tidy, utf8

MIN_LENGTH = 200
GRAM = 64
#: Distinct contexts that are indexed together; an anchor with more is split into blocks of so many offsets, one width after the other.
HOT = 256
WIDTHS = (24, 4, 1)
INDEX_BYTES = 1 << 18
#: A document is read in pieces of this many window starts; positions in a run of pieces fit POSITION bits.
PIECE = 1 << 24
POSITION = 26
#: Bytes of text whose occurrences are worked out together, a longer piece alone.
RUN_BYTES = 1 << 19
#: An occurrence's place: first window start, then windows - 1 and the anchor's offset, 8 bits each.
SPAN, OFFSET = 256, 256
PART = 1 << 21

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers or more of the rolling hash's base and of its inverse."""
    if len(_POW.get("up", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for name, base in (("up", _MULT), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["up"], _POW["down"]


def occurrences(items: list[bytes], length: int = MIN_LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Occurrences of anchors, as parallel arrays: item, anchor hash, first window start, windows - 1, anchor's offset from that start.

    The rolling hash only picks anchors: equal strings have equal hashes, and nothing else is asked of it.
    """
    pieces, owner, base = [], [], []
    for k, x in enumerate(items):
        for o in range(0, len(x) - length + 1, PIECE):
            pieces.append(x[o : o + PIECE + length - 1])
            owner.append(k)
            base.append(o)
    owner, base = np.array(owner, np.int64), np.array(base, np.int64)
    low = np.uint64((1 << POSITION) - 1)
    for i, j in packs_of(pieces, RUN_BYTES):
        run = pieces[i:j]
        a = np.frombuffer(b"".join(run), np.uint8)
        n = len(a)
        up, down = powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[a] * up[:n], out=prefix[1:])
        grams = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
        low_grams = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
        width, least = length - gram + 1, low_grams
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            rest = width - size
            least = np.minimum(least[:-rest], least[rest:])
        anchor = (low - (least & low)).astype(np.int64)  # of the window that starts here
        sizes = np.array([len(x) for x in run])
        begins = np.cumsum(sizes) - sizes
        valid = np.ones(n - length + 1, bool)
        for b in begins[1:]:
            valid[max(0, b - length + 1) : b] = False
        starts = np.flatnonzero(valid)
        at = anchor[starts]
        new = np.concatenate(([True], at[1:] != at[:-1]))
        first = starts[new]
        count = np.diff(np.append(np.flatnonzero(new), len(starts)))
        at = at[new]
        piece = np.searchsorted(begins, first, "right") - 1
        yield owner[i:j][piece], grams[at].view(np.int64), first - begins[piece] + base[i:j][piece], count - 1, at - first


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` (values 0 to 256) ordered by their first `depth` values at least, by doubling."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(7, text.dtype))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | padded[k : k + n]
    sorted_to = 7
    while True:
        order = np.argsort(key, kind="quicksort")
        ordered = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1])), dtype=np.uint32)
        if sorted_to >= depth or int(rank[order[-1]]) == n:
            return order.astype(np.int32)
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: max(0, n - sorted_to)] |= rank[sorted_to:]
        sorted_to *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each rank, the common prefix with the suffix one rank before, as far as it is below `depth`; `depth` otherwise.

    Breadth-first: the intervals of strings of one length are extended backward by every character
    that precedes them; an extension's end fixes the value of the boundary after it, once. Values come
    in increasing order; intervals whose boundary is fixed already are not followed.
    """
    n = len(text)
    bwt = text[order - 1]
    by_char = np.argsort(bwt, kind="stable").astype(np.int32)
    back = np.empty(n, np.int32)  # the rank of the suffix that begins one character earlier
    back[by_char] = np.arange(n, dtype=np.int32)
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    following, previous = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_char[:-1][same]] = by_char[1:][same]
    previous[by_char[1:][same]] = by_char[:-1][same]
    values = np.full(n + 1, depth, np.int32)
    values[0] = values[n] = -1
    fixed = np.zeros(n + 1, bool)
    fixed[0] = True
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    for level in range(depth):
        sizes = high - low + 1
        ends = np.cumsum(sizes, dtype=np.int32)
        inner = np.repeat(low - (ends - sizes), sizes) + np.arange(int(ends[-1]), dtype=np.int32)
        real = (bwt[inner] != 0) | (level == 0)  # a separator may end a string, never stand inside one
        first = real & (previous[inner] < np.repeat(low, sizes))
        last = real & (following[inner] > np.repeat(high, sizes))
        low, high = np.sort(back[inner[first]]), np.sort(back[inner[last]])
        open_ = ~fixed[high + 1]
        low, high = low[open_], high[open_]
        if not len(low):
            break
        fixed[high + 1] = True
        values[high + 1] = level
    values[n] = -1
    return values


def repeated_windows(strings: list[bytes], counts: list[int], length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Per string, for each window start, whether its `length` bytes occur at another place of the strings or in a string that counts twice."""
    sizes = np.array([len(s) for s in strings])
    text = np.zeros(int(sizes.sum()) + len(strings), np.uint16)
    begins = np.cumsum(sizes + 1) - sizes - 1
    flat = np.frombuffer(b"".join(strings), np.uint8)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(strings)), sizes)] = flat
    inside = np.ones(len(text), bool)
    inside[begins + sizes] = False
    text[inside] += 1
    order = suffix_order(text, length)
    values = common_prefixes(text, order, length)
    shared = np.zeros(len(text), bool)
    shared[order] = (values[:-1] >= length) | (values[1:] >= length)
    return [np.ones(n - length + 1, bool) if c > 1 else shared[b : b + n - length + 1] for b, n, c in zip(begins, sizes, counts, strict=True)]


def place(start: np.ndarray, more: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start * SPAN + more) * OFFSET + offset


def unplace(x: int) -> tuple[int, int]:
    """(first window start, windows - 1)"""
    return x // (SPAN * OFFSET), x // OFFSET % SPAN


@tidy(_POW.clear)
def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence's anchor and a hash of its context."""
    for b in slices(batches, 200):
        texts = utf8(b, "text")
        for item, fp, start, more, offset in occurrences(texts):
            context = [window_hash(texts[k][s : s + m + MIN_LENGTH], o) for k, s, m, o in zip(item.tolist(), start.tolist(), more.tolist(), offset.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(context, pa.int64())], ["fp", "context"])


def located(shipped: Broadcast):
    """A map of texts to the occurrences whose anchors pass the sieve: anchor, hash of the context, text and place."""

    @tidy(_POW.clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            k1, k2, texts = column(b, "k1").to_numpy(), column(b, "k2").to_numpy(), utf8(b, "text")
            for found in occurrences(texts):
                passing = sieved(pa.array(found[1]), shipped.value)
                item, fp, start, more, offset = (x[passing] for x in found)
                sid = [window_hash(texts[k][s : s + m + MIN_LENGTH], o) for k, s, m, o in zip(item.tolist(), start.tolist(), more.tolist(), offset.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(sid, pa.int64()), *(pa.array(x) for x in (k1[item], k2[item], place(start, more, offset)))], ["fp", "sid", "k1", "k2", "place"])

    return run


def window_hash(text: bytes, offset: int) -> int:
    """64 bits of a string and the anchor's place in it."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, person=b"%d" % offset).digest(), "little", signed=True)


#: Contexts that a task remembers to have given out.
SEEN = 1 << 18


@tidy(_POW.clear)
def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that are asked of the texts, once a task where copies of a text are in it; n is 1, or 2 for those that occur more than once."""
    names, seen = ["fp", "sid", "n", "bytes", "offset"], set()
    for b in slices(batches, 200):
        out, grams = [], []
        for text, asked in zip(utf8(b, "text"), column(b, "open").to_pylist(), strict=True):
            for x in asked:
                if (sid := x["sid"]) not in seen:
                    seen.add(sid)
                    start, more = unplace(x["place"] // 2)
                    offset = x["place"] // 2 % OFFSET
                    grams.append(text[start + offset : start + offset + GRAM])
                    out.append((sid, 1 + x["place"] % 2, text[start : start + more + MIN_LENGTH], offset))
        if len(seen) > SEEN:
            seen.clear()
        cols = [anchor_hashes(grams).tolist(), *(list(zip(*out, strict=True)) or [[]] * 4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "bytes" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)


def anchor_hashes(grams: list[bytes]) -> np.ndarray:
    """The hash of an anchor from its bytes, as `occurrences` has it."""
    a = np.frombuffer(b"".join(grams), np.uint8).reshape(-1, GRAM)
    return mix((_BYTE[a] * powers(GRAM)[0][:GRAM]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def runs_of(repeated: np.ndarray) -> list[int]:
    """Begin and end of each run of repeated windows, in one list."""
    return np.flatnonzero(np.diff(repeated.view(np.int8), prepend=0, append=0)).tolist()


@tidy()
def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index the contexts, whole anchors at a time; contexts with repeated windows come out with the runs of these. Equal ones come together and count once."""
    held: list[tuple] = []
    size, at, last = 0, None, None

    def batch() -> pa.RecordBatch:
        runs = [runs_of(m) for m in repeated_windows([h[2] for h in held], [h[3] for h in held])] if held else []
        some = [(h[0], h[1], r) for h, r in zip(held, runs, strict=True) if r]
        cols = list(zip(*some, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["fp", "sid", "runs"])

    for b in batches:
        for row in zip(*(column(b, n).to_pylist() for n in ("fp", "sid", "bytes", "n")), strict=True):
            if row[:2] == last:
                continue
            last = row[:2]
            if row[0] != at and size >= INDEX_BYTES:
                yield batch()
                held, size = [], 0
            at = row[0]
            held.append(row)
            size += len(row[2])
    if held:
        yield batch()


def split(width: int):
    """A map of hot contexts to their windows in blocks of `width` offsets of the anchor; windows that share the bytes common to their block get one fp2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "sid", "shift", "n", "fp2", "sid2", "bytes", "offset"]
        for b in slices(batches, 500):
            out: list[tuple] = []
            for fp, sid, data, n, offset in zip(*(column(b, k).to_pylist() for k in ("fp", "sid", "bytes", "n", "offset")), strict=True):
                windows = len(data) - MIN_LENGTH + 1
                for block in range((offset - windows + 1) // width, offset // width + 1):
                    low, high = block * width, min(block * width + width - 1, MIN_LENGTH - GRAM)
                    first, last = max(0, offset - high), min(windows - 1, offset - low)
                    common = hashlib.blake2b(data[offset - low : offset - high + MIN_LENGTH], digest_size=8, person=b"%d.%d" % (block, width))
                    cut = data[first : last + MIN_LENGTH]
                    out.append((fp, sid, first, n, int.from_bytes(common.digest(), "little", signed=True), window_hash(cut, offset - first), cut, offset - first))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "bytes" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

    return run


def collapsed(contexts_: DataFrame, name: str) -> DataFrame:
    """(fp, sid, n, bytes, offset): the distinct contexts with the number of their occurrences."""
    found = contexts_.groupBy("fp", "sid").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"), F.first("offset").alias("offset"))
    return materialize(found, name)


def repeated_runs(distinct: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(fp, sid, runs): the repeated windows of each context that has any; a context of a split anchor has several rows. A context may be given more than once."""
    sorted_ = lambda some: some.select("fp", "sid", "n", "bytes").repartition("fp").sortWithinPartitions("fp", "sid")
    index = lambda some: sorted_(some).mapInArrow(resolve, "fp long, sid long, runs array<int>")
    counts = distinct.select("fp", "sid").distinct().groupBy("fp").count()
    hot = materialize(counts.where(F.col("count") > HOT).select("fp"), "hot") if widths else None
    if hot is None or hot.isEmpty():
        return index(distinct)
    cool = distinct.join(bounded(hot), "fp", "left_anti")
    schema = "fp long, sid long, shift long, n long, fp2 long, sid2 long, bytes binary, offset long"
    parts = materialize(distinct.join(bounded(hot), "fp", "left_semi").dropDuplicates(["fp", "sid"]).mapInArrow(split(widths[0]), schema), "parts")
    smaller = collapsed(parts.select(F.col("fp2").alias("fp"), F.col("sid2").alias("sid"), "n", "bytes", "offset"), "split")
    found = repeated_runs(smaller, widths[1:]).withColumnsRenamed({"fp": "fp2", "sid": "sid2"})
    moved = F.transform("runs", lambda x: x + F.col("shift").cast("int")).alias("runs")
    return index(cool).unionByName(parts.select("fp", "sid", "shift", "fp2", "sid2").join(found, ["fp2", "sid2"]).select("fp", "sid", moved))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def covered(whole: list[int], places: list[int], runs: list[list[int]]) -> list[tuple[int, int]]:
    """Removed byte ranges from places that repeat whole and places with runs of repeated windows."""
    spans = []
    for x in whole:
        start, more = unplace(x)
        spans.append((start, start + more + MIN_LENGTH))
    for x, run in zip(places, runs, strict=True):
        start = unplace(x)[0]
        spans += [(start + a, start + b - 1 + MIN_LENGTH) for a, b in zip(run[::2], run[1::2], strict=True)]
    return merged(spans)


#: Places or spans, of two numbers each, that may be broadcast, and keys of texts.
PLACES, KEYS = 1 << 20, BROADCAST_ROWS
OUTPUT = ["__spans", "__n_bytes", "__n_removed", "__kept_sha256", "__kept"]


def meeting(rows: DataFrame, some: DataFrame, weight: Column) -> DataFrame:
    """`rows` (k1, k2, texts) joined with `some` (k1, k2, places of `weight` numbers in all). Where they are too many to be broadcast, only texts that they are likely to be of are shuffled."""
    keys = some.select("k1", "k2")
    n = keys.count()
    likely = rows.join(F.broadcast(keys.distinct()), ["k1", "k2"], "left_semi") if n <= KEYS else rows.where(may_be_in(sieve(keys.select("k1"), n), "k1"))
    return likely.join(bounded(some, PLACES, weight), ["k1", "k2"])


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, payload: bool = True) -> DataFrame:
    """`docs` (or its columns `keep`) plus __spans (removed byte ranges, merged), __n_bytes, __n_removed, __kept_sha256, and, with `payload`, __kept: the remaining bytes."""
    kept, names = boxed(docs, docs.columns if keep is None else keep, OUTPUT)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*kept, body.alias("text"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit("second"), body).alias("k2"))
    long = rows.select("k1", "k2", "text").where(F.octet_length("text") >= MIN_LENGTH)

    repeats = (
        long.select("text").mapInArrow(anchors, "fp long, context long")
        .groupBy("fp")
        .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
        .where("n > 1")
        .select("fp", (F.col("lo") != F.col("hi")).alias("open"))
    )
    repeats = materialize(repeats, "anchors")
    shipped = sieve(repeats.select("fp"), repeats.count())
    found = long.mapInArrow(located(shipped), "fp long, sid long, k1 long, k2 long, place long").join(bounded(repeats), "fp")
    found = materialize(found, "occurrences")
    shipped.unpersist()
    part = F.floor(F.col("place") / (SPAN * OFFSET * PART)).alias("part")
    opened = found.where("open").drop("open")

    # a context is read where it stands first; the lowest bit of its place tells whether it occurs again
    twice = F.col("place") * 2 + (F.col("n") > 1).cast("long")
    first = opened.groupBy("fp", "sid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at")).select("fp", "sid", "n", "at.*")
    asked = materialize(first.groupBy("k1", "k2", part).agg(F.collect_list(F.struct(twice.alias("place"), "sid")).alias("open")).drop("part"), "asked")
    cut = materialize(meeting(long, asked, F.size("open")).mapInArrow(contexts, "fp long, sid long, n long, bytes binary, offset long"), "contexts")
    partial = opened.join(repeated_runs(cut), ["fp", "sid"]).groupBy("k1", "k2", part).agg(F.collect_set(F.struct("place", "runs")).alias("parts"))
    whole = found.where("NOT open").groupBy("k1", "k2", part).agg(F.collect_set("place").alias("whole"))
    none = F.array().cast("array<long>")
    places = whole.select("k1", "k2", "whole", none.alias("places"), F.array().cast("array<array<int>>").alias("runs")).unionByName(
        partial.select("k1", "k2", none.alias("whole"), F.transform("parts", lambda p: p["place"]).alias("places"), F.transform("parts", lambda p: p["runs"]).alias("runs"))
    )
    merged_parts = places.mapInArrow(merge_spans, "k1 long, k2 long, spans array<struct<lo:long,hi:long>>")
    spans = materialize(merged_parts.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(repeats, found, asked, cut)

    n = spans.count()
    keys = spans.select("k1", "k2")
    box = [f"c{k}" for k in range(len(names))]
    utf = F.encode("text", "UTF-8")
    likely = may_be_in(sieve(keys.select("k1"), n), "k1") if n > KEYS else None
    clean = (rows.join(F.broadcast(keys), ["k1", "k2"], "left_anti") if likely is None else rows.where(~likely)).select(
        *box,
        F.array().cast("array<struct<lo:long,hi:long>>").alias("__spans"),
        F.octet_length("text").cast("long").alias("__n_bytes"),
        F.lit(0).cast("long").alias("__n_removed"),
        F.sha2(utf, 256).alias("__kept_sha256"),
        (utf if payload else F.lit(None).cast("binary")).alias("__kept"),
    )
    # texts that only look as if they had spans go the same way, with none
    some = rows.join(F.broadcast(keys), ["k1", "k2"], "left_semi") if likely is None else rows.where(likely)
    hit = some.join(bounded(spans, PLACES, F.size("spans") + 1), ["k1", "k2"], "left").select(*box, "text", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            gone, sizes, removed, digests, rests = [], [], [], [], []
            for data, found in zip(utf8(b, "text"), column(b, "spans").to_pylist(), strict=True):
                parts, at = [], 0
                gone.append([{"lo": lo, "hi": hi} for lo, hi in merged([(s["lo"], s["hi"]) for s in found])])
                for s in gone[-1]:
                    parts.append(data[at : s["lo"]])
                    at = s["hi"]
                rest = b"".join([*parts, data[at:]])
                sizes.append(len(data))
                removed.append(len(data) - len(rest))
                digests.append(hashlib.sha256(rest).hexdigest())
                rests.append(rest if payload else None)
            made = [pa.array(gone, RANGES), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(rests, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(column(b, k) for k in box), *made], [*box, *OUTPUT])

    return clean.unionByName(hit.mapInArrow(cut_out, clean.schema)).toDF(*names, *OUTPUT)


RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        k1, k2, out = [], [], []
        for a, c, *found in zip(*(column(b, n).to_pylist() for n in ("k1", "k2", "whole", "places", "runs")), strict=True):
            if spans := covered(*found):
                k1.append(a)
                k2.append(c)
                out.append([{"lo": lo, "hi": hi} for lo, hi in spans])
        yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(out, RANGES)], ["k1", "k2", "spans"])
