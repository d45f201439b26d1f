"""Fixed public vocabularies. Paths are parameters; only the driver reads the files, executors get the parsed tables.

A vocabulary has some tens of thousands of pieces whatever the corpus, so shipping it with a task is bounded.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np

FOLDER = "/opt/tokenizers"
PIECES = f"{FOLDER}/piece_bpe_32k.model"
BYTE_RANKS = f"{FOLDER}/byte_bpe_50k.tiktoken"
#: Fixed value: marks the begin of a word in the pieces.
WORD_MARK = "▁"


def load_pieces(path: str = PIECES) -> list[str]:
    """Ordinary pieces in order of id, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not skip(i)]


def load_ranks(path: str = BYTE_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PieceIndex:
    """Piece numbers by a 64-bit rolling hash of their characters, in two direct tables; `absent` is the number of pieces."""

    STEP = np.uint64(0x9E3779B97F4A7C15)
    BITS = 21

    def __init__(self, pieces: list[str]):
        self.absent, self.longest = len(pieces), max(map(len, pieces))
        self.keys = np.zeros(self.absent + 1, np.uint64)
        for size in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == size]
            hashes = np.zeros(len(at), np.uint64)
            for column in char_matrix([pieces[i] for i in at], size).T:
                hashes = self.extend(hashes, column)
            self.keys[at] = hashes
        if len(np.unique(self.keys[:-1])) < self.absent:
            raise ValueError("two pieces have one hash")
        self.tables, left = [], np.arange(self.absent)
        while len(left):
            table = np.full(1 << self.BITS, self.absent, np.int32)
            table[self.slots(self.keys[left], len(self.tables))] = left
            self.tables.append(table)
            left = left[table[self.slots(self.keys[left], len(self.tables) - 1)] != left]

    def extend(self, hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Hashes of strings with one more character each."""
        return (hashes ^ (hashes >> np.uint64(31))) * self.STEP + (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    def slots(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return (hashes * np.uint64(2 * k + 1) ^ hashes >> np.uint64(k)) >> np.uint64(64 - self.BITS)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or `absent`."""
        out = np.full(hashes.shape, self.absent, np.int32)
        for k, table in enumerate(self.tables):
            got = table[self.slots(hashes, k)]
            out = np.where(self.keys[got] == hashes, got, out)
        return out


def char_matrix(words: list[str], size: int) -> np.ndarray:
    """Code points of words of at most `size` characters, a row each, filled up with 0."""
    flat = np.frombuffer("".join(w.ljust(size, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.reshape(len(words), size)


def text_runs(texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `chars` characters in all, so that a batch of long texts stays small in memory."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > chars:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def factorize(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """(number of each word among the distinct ones, distinct words in order of appearance)."""
    seen: dict[str, int] = {}
    first = np.fromiter(map(seen.setdefault, words, range(len(words))), np.int64, len(words))
    number = np.zeros(len(words), np.int64)
    number[np.fromiter(seen.values(), np.int64, len(seen))] = np.arange(len(seen))
    return number[first], list(seen)


class WordTable:
    """Values per distinct word, computed once for each word of a run of texts and kept for the first `keep` words."""

    def __init__(self, compute, width: int, dtype, keep: int = 200_000):
        self.compute, self.keep, self.index = compute, keep, {}
        self.values = np.zeros((keep, width), dtype)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code per word, values per code)."""
        codes, distinct = factorize(words)
        at = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        out = self.values[at]
        if len(new := np.flatnonzero(at < 0)):
            fresh = [distinct[k] for k in new.tolist()]
            out[new] = got = self.compute(fresh)
            n, room = len(self.index), self.keep - len(self.index)
            if room > 0:
                self.values[n : n + len(fresh)] = got[:room]
                self.index.update(zip(fresh[:room], range(n, self.keep), strict=False))
        return codes, out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of its words and the sum of their values."""
        split = [t.split() for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        total = np.zeros((len(texts), self.values.shape[1]), np.float64)
        if counts.sum():
            codes, values = self.lookup([w for s in split for w in s])
            filled = np.flatnonzero(counts)
            total[filled] = np.add.reduceat(values[codes].astype(np.float64), (np.cumsum(counts) - counts)[filled])
        return counts, total
