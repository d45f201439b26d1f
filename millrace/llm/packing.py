"""Token ids packed into fixed-length rows by best-fit decreasing with a segment tree over capacities.

One map over the documents: each task tokenises whole texts, cuts documents longer than a row into
full rows and one rest (nothing is lost: every segment carries its document and token offset), packs
the rests of a bounded buffer by best fit in decreasing order, and emits binary matrix rows. No row
is shuffled and a task holds one buffer, so packing neither skews nor grows with the corpus.

Output, per packed row: pack_id, n_tokens, input_ids (little-endian ids, padded to the row length),
position_ids (same layout, 0 at each segment's begin), cu_seqlens (0, then the end of each segment),
doc_ids, doc_offsets (token offset of the segment in its document).

Defined cases: null and empty texts have no tokens and no segment; ids are integers (others are refused before any work),
null ids stay null in doc_ids; texts of any length are tokenized whole; repeated rows are packed as often as they occur; equal lengths are packed in input order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

from .common import column, slices, tidy
from .vocabulary import BYTE_RANKS, load_ranks, text_runs

ROW = 2048
BUFFER = 1 << 20
#: Characters that are tokenized at once; a word that recurs within is encoded once.
RUN = 1 << 22
#: Fixed value: the pre-token pattern that belongs to the public ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_offsets array<long>"


class CapacityTree:
    """Bins by free capacity; a segment tree over 0..size finds the smallest capacity that holds a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        at = capacity + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) of the tightest fit."""
        at = length + self.leaves
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        bin_ = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self.any[at] = 0
            while (at := at >> 1) and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
        return capacity, bin_


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers; every length is between 1 and size."""
    tree, bins = CapacityTree(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        found = tree.take(n)
        if found is None:
            capacity, b = size, len(bins)
            bins.append([k])
        else:
            capacity, b = found
            bins[b].append(k)
        if capacity > n:
            tree.add(capacity - n, b)
    return bins


class Tokenizer:
    """Byte-level BPE over public ranks. Words between single spaces are encoded once a run of texts; ids equal a plain encoding."""

    #: White space as Python and the pattern know it, for a regular expression that knows no Unicode classes of that name.
    SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    #: Texts that are encoded whole, and words that are encoded one by one.
    ODD, ALONE = SPACES + "{2}" + r"|\x00|\A\z", r"\n|\A\z|" + SPACES + r"\z"
    BEGIN, SPACE, FEED, NOTHING = (pa.scalar(x, pa.large_string()) for x in ("\0", " ", "\n", ""))

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.encoding = ranks, None

    def __getstate__(self):
        return {"ranks": self.ranks, "encoding": None}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        import tiktoken

        if self.encoding is None:
            self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        every = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(every, self.ODD)
        # a single space between other characters always begins a pre-token; a text's first word has none before it
        split = pc.split_pattern(pc.binary_join_element_wise(self.BEGIN, every.filter(pc.invert(odd)), self.NOTHING), " ")
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        ids, begins, sizes = self.encode_words(words.dictionary)
        each = sizes[codes]
        ends = np.cumsum(each)
        ids = ids[np.repeat(begins[codes] - ends + each, each) + np.arange(int(each.sum()))]
        bounds = iter(np.concatenate(([0], ends))[split.offsets.to_numpy()].tolist())
        out, at = [], next(bounds)
        for text, whole in zip(texts, odd.to_pylist(), strict=True):
            if whole:
                out.append(self.encoding.encode_to_numpy(text).astype(np.uint32))
            else:
                begin, at = at, next(bounds)
                out.append(ids[begin:at])
        return out

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, each word's begin in them, its number of ids). Words without a line feed are encoded in one call, a line each: a line feed is a token of its own."""
        full = pc.if_else(pc.starts_with(words, "\0"), pc.utf8_slice_codeunits(words, 1), pc.binary_join_element_wise(self.SPACE, words, self.NOTHING))
        alone = pc.match_substring_regex(full, self.ALONE)
        is_line = ~alone.to_numpy(zero_copy_only=False)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, int(is_line.sum())], full.filter(pc.invert(alone))), self.FEED)
        lines = self.encoding.encode_to_numpy(joined[0].as_py()).astype(np.uint32)
        feed = lines == self.ranks[b"\n"]
        ends = np.append(np.flatnonzero(feed), len(lines))[: int(is_line.sum())]
        others = [self.encoding.encode_to_numpy(w).astype(np.uint32) for w in full.filter(alone).to_pylist()]
        sizes = np.zeros(len(words), np.int64)
        sizes[is_line] = np.diff(ends, prepend=-1) - 1
        sizes[~is_line] = [len(x) for x in others]
        begins = np.zeros(len(words), np.int64)
        ranked = np.concatenate((np.flatnonzero(is_line), np.flatnonzero(~is_line)))
        begins[ranked] = np.cumsum(sizes[ranked]) - sizes[ranked]
        return np.concatenate((lines[~feed], *others)), begins, sizes


def pack(segments: list[tuple[int | None, int, np.ndarray]], size: int) -> Iterator[list[tuple[int | None, int, np.ndarray]]]:
    """Rows of segments (document, offset, ids): full segments alone, the others by best fit decreasing."""
    rest = [s for s in segments if len(s[2]) < size]
    yield from ([s] for s in segments if len(s[2]) == size)
    yield from ([rest[k] for k in b] for b in best_fit_decreasing([len(s[2]) for s in rest], size))


def pack_documents(docs: DataFrame, path: str = BYTE_RANKS, size: int = ROW, key: str = "doc_id", text: str = "text", buffer: int = BUFFER, run: int = RUN) -> DataFrame:
    """Packed rows of `docs`. A smaller `run` needs less memory and encodes more words again."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"packed rows hold integer ids; {key} is of another type")
    ranks = load_ranks(path)
    vocabulary = max(ranks.values()) + 1
    kind = np.dtype("<u2" if max(vocabulary, size) < 1 << 16 else "<u4")
    shipped = docs.sparkSession.sparkContext.broadcast(Tokenizer(ranks))
    ramp = np.arange(size, dtype=kind)

    def rows(first: int, packs: list) -> pa.RecordBatch:
        out = {k: [] for k in ("pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets")}
        for k, segments in enumerate(packs):
            ids, pos, cu = np.full(size, vocabulary, kind), np.zeros(size, kind), [0]
            for _, _, x in segments:
                ids[cu[-1] : cu[-1] + len(x)] = x
                pos[cu[-1] : cu[-1] + len(x)] = ramp[: len(x)]
                cu.append(cu[-1] + len(x))
            row = (first + k, cu[-1], ids.tobytes(), pos.tobytes(), cu, [s[0] for s in segments], [s[1] for s in segments])
            for name, x in zip(out, row, strict=True):
                out[name].append(x)
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], list(out))

    @tidy()
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, waiting = TaskContext.get().partitionId() << 33, 0, []
        for b in slices(batches, 1000):
            keys, texts = column(b, key).to_pylist(), [t or "" for t in column(b, text).to_pylist()]
            for i, j in text_runs(texts, run):
                for k, ids in zip(keys[i:j], shipped.value.encode(texts[i:j]), strict=True):
                    waiting += [(k, o, ids[o : o + size]) for o in range(0, len(ids), size)]
                    held += len(ids)
                if held >= buffer:
                    packs = list(pack(waiting, size))
                    for p in range(0, len(packs), 256):
                        yield rows(first + p, packs[p : p + 256])
                    first, held, waiting = first + len(packs), 0, []
        if waiting:
            yield rows(first, list(pack(waiting, size)))

    return docs.select(key, text).mapInArrow(work, SCHEMA)
