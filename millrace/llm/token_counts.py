"""Token counts by a unigram model whose forward scores are shared along a trie of distinct pre-tokens.

The distinct pre-tokens (words after a word mark) of a run of texts form a trie. A walk over it
computes, once per trie node, the best forward score of the prefix it spells and the number of
pieces of that best segmentation; the terminal counts of the pre-tokens are stored and summed per
document. The walk goes level by level, all nodes of a depth at once, and for long words path by path. Every piece has the score of its rank under Zipf's law; a character outside the vocabulary
costs one byte piece per UTF-8 byte. Counting is one map over the documents without a shuffle.

Defined cases: null and empty texts have 0 pre-tokens and 0 tokens; equal scores take the fewer
pieces; repeated rows repeat their counts; ids may be of any type; texts and words of any length are scored whole; an
empty table gives no rows; other columns pass through, and those named as an output
column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotate
from .vocabulary import PIECES, WORD_MARK, PieceIndex, WordTable, char_matrix, load_pieces, text_runs

#: A level of the trie costs as much for one node as for many: levels of words of up to so many characters are scored at once, longer words path by path.
LONG = 64


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by rank: 1 / rank, normalised over the vocabulary."""
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}


def byte_score(scores: dict[str, float]) -> float:
    """Score of a byte piece: below every ordinary piece."""
    return min(scores.values()) - 10.0


class Trie:
    """A level per character: each node's parent and character. Words end at terminal nodes."""

    def __init__(self, words: list[str]):
        size = max(map(len, words))
        chars, lengths = char_matrix(words, size).astype(np.int64), np.array([len(w) for w in words])
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []
        alive, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        for depth in range(size):
            alive, node = alive[longer := lengths[alive] > depth], node[longer]
            edges, node = np.unique(node << 21 | chars[alive, depth], return_inverse=True)
            self.levels.append((edges >> 21, edges & (1 << 21) - 1))
            ending = lengths[alive] == depth + 1
            self.ends.append((alive[ending], node[ending]))

    def terminal_counts(self, index: PieceIndex, scores: np.ndarray, per_byte: float) -> np.ndarray:
        """Per word the pieces of its best segmentation. Every node is scored once, from the nodes on the path above it.

        `scores` has a last entry of -inf for no piece.
        """
        out = np.zeros(sum(len(w) for w, _ in self.ends), np.int64)
        hashes = np.zeros((1, 1), np.uint64)  # of the last 0, 1, ... characters of each node's path
        best, used = np.zeros((1, 1)), np.zeros((1, 1), np.int64)  # at the node and at its ancestors upwards
        for (parent, char), (words, nodes) in zip(self.levels, self.ends, strict=True):
            spread = min(hashes.shape[1], index.longest)
            hashes = np.concatenate((np.zeros((len(parent), 1), np.uint64), index.extend(hashes[parent, :spread], char[:, None])), axis=1)
            above, above_used = best[parent, :spread], used[parent, :spread]
            found = index.find(hashes[:, 1:])
            bytes_ = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
            top, count = above[:, 0] + bytes_ * per_byte, above_used[:, 0] + bytes_
            for k in range(spread):
                s, m = above[:, k] + scores[found[:, k]], above_used[:, k] + 1
                better = (s > top) | ((s == top) & (m < count))
                top, count = np.where(better, s, top), np.where(better, m, count)
            best, used = np.concatenate((top[:, None], above), axis=1), np.concatenate((count[:, None], above_used), axis=1)
            out[words] = count[nodes]
        return out


def deep_counts(words: list[str], scores: dict[str, float], longest: int, per_byte: float) -> list[int]:
    """Per word the pieces of its best segmentation, by a walk down the trie path after path.

    In sorted order a word's node hangs below the last common prefix with the word before, whose scores
    are kept: every node of the trie is scored once, and only one path is held. For long words, where
    a level holds few nodes.
    """
    out, last, best, used = [0] * len(words), "", [0.0], [0]
    for k in sorted(range(len(words)), key=words.__getitem__):
        word, i = words[k], 0
        while i < len(word) and i < len(last) and word[i] == last[i]:
            i += 1
        del best[i + 1 :], used[i + 1 :]
        for end in range(i + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, count = best[-1] + size * per_byte, used[-1] + size
            for j in range(max(0, end - longest), end):
                if (s := scores.get(word[j:end])) is not None:
                    s, m = s + best[j], used[j] + 1
                    if s > top or s == top and m < count:
                        top, count = s, m
            best.append(top)
            used.append(count)
        out[k], last = used[-1], word
    return out


class Counter:
    """Picklable: the scores; the table of words belongs to one worker."""

    def __init__(self, pieces: list[str]):
        by_piece = zipf_scores(pieces)
        self.pieces, self.per_byte = pieces, byte_score(by_piece)
        self.scores = np.append([by_piece[p] for p in pieces], -np.inf)
        self.words = self.index = self.by_piece = None

    def __getstate__(self):
        return self.__dict__ | {"words": None, "index": None, "by_piece": None}

    def word_counts(self, words: list[str]) -> np.ndarray:
        marked = [WORD_MARK + w for w in words]
        out = np.zeros((len(words), 1), np.int64)
        if short := [i for i, w in enumerate(marked) if len(w) <= LONG]:
            out[short, 0] = Trie([marked[i] for i in short]).terminal_counts(self.index, self.scores, self.per_byte)
        if deep := [i for i, w in enumerate(marked) if len(w) > LONG]:
            out[deep, 0] = deep_counts([marked[i] for i in deep], self.by_piece, self.index.longest, self.per_byte)
        return out

    def forget(self) -> None:
        """Give up what belongs to one worker."""
        self.words = self.index = self.by_piece = None

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.words is None:
            self.index, self.by_piece = PieceIndex(self.pieces), zipf_scores(self.pieces)
            self.words = WordTable(self.word_counts, 1, np.int64)
        parts = [self.words.sums(texts[i:j]) for i, j in text_runs(texts)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1][:, 0] for p in parts]).astype(np.int64)


def count_tokens(docs: DataFrame, path: str = PIECES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) plus __pretokens and __tokens."""
    shipped = docs.sparkSession.sparkContext.broadcast(Counter(load_pieces(path)))

    def work(texts: list[str | None]) -> list[pa.Array]:
        pre, tokens = shipped.value.count([t or "" for t in texts])
        return [pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())]

    return annotate(docs, text, docs.columns if keep is None else keep, "__pretokens long, __tokens long", work, lambda: shipped.value.forget())
