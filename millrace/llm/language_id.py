"""Language ID by unigram models over one fixed public vocabulary, marginalised over all segmentations.

A language is a distribution over the pieces of the vocabulary, fitted by expectation maximisation.
The probability of a text is the product over its words of the sum, over every way to cut the word
into pieces, of the product of piece probabilities; the forward algorithm computes it. Pieces do
not cross words, so a word's scores are computed once per run of texts. Scoring is one map over the
documents without a shuffle.

Fitting reads at most MAX_FIT_ROWS labelled rows (a documented bound, shared evenly by the languages,
one row each at least; those with the smallest hashes of id and text); their words are learned from whatever their
length, so unspaced scripts are too; each language is fitted in a task of its own, and the driver gets a number for
each piece of the vocabulary and language, of which there may be MAX_LANGUAGES (more are refused: a column of so
many values is no column of languages). Everything else covers every row and whole texts.

Defined cases: null texts and texts without a letter are `und` with score 0; rows with a null id
are not held out and not learned from; a language whose sampled rows have no word is not learned; an empty training
set makes every text `und`; rows that repeat get the same answer; ties go to the first language in code point order; other columns pass through, and
those named as an output column are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .common import annotate, bounded, free_name, give_back, materialize, text_keys
from .mixing import draw
from .vocabulary import PIECES, WORD_MARK, PieceIndex, WordTable, char_matrix, load_pieces, text_runs

MAX_FIT_ROWS = 800
MAX_LANGUAGES = 1024
ROUNDS = 3
SMOOTHING = 0.1
#: Probability of a character that no piece covers; the same in all languages.
UNKNOWN = 1e-7
UNDETERMINED = "und"
LEAST_SCORE = 0.5
LONG = 40
#: Up to so many words the pieces that end at a character are added up at once.
FEW = 16


class Lattice:
    """For some words, shorter ones filled up, the ids of all pieces by end and length; the last row of a table of probabilities is 0."""

    def __init__(self, words: list[str], index: PieceIndex):
        self.ends = np.array([len(w) for w in words])
        n = int(self.ends.max())
        self.n, self.longest = n, min(index.longest, n)
        chars = char_matrix(words, n)
        self.ids = np.full((len(words), n + 1, self.longest + 1), index.absent, np.int32)
        hashes = np.zeros((len(words), n), np.uint64)
        for size in range(1, self.longest + 1):
            hashes = index.extend(hashes[:, : n - size + 1], chars[:, size - 1 :])
            self.ids[:, size:, size] = index.find(hashes)

    def forward(self, table: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Scaled sums over segmentations of every prefix, (word, end, language), and the logs of the scales with the first end each holds for.

        Every LONG positions the window that later ones read is divided by its newest sum. A sum is at least
        UNKNOWN times the one before it, so that the newest falls to 1e-280 at the lowest until the next time,
        and the others of the window are at most 1e280 for pieces of up to LONG characters.
        """
        w, langs = len(self.ids), table.shape[1]
        alpha = np.zeros((w, self.n + 1, langs))
        alpha[:, 0] = 1
        scales = []
        for i in range(1, self.n + 1):
            total, k = alpha[:, i - 1] * UNKNOWN, min(self.longest, i)
            if w <= FEW:
                total += np.einsum("wkl,wkl->wl", alpha[:, i - k : i][:, ::-1], table[self.ids[:, i, 1 : k + 1]])
            else:
                for size in range(1, k + 1):
                    total += alpha[:, i - size] * table[self.ids[:, i, size]]
            alpha[:, i] = total
            if i % LONG == 0 and i < self.n:
                back = slice(max(0, i - self.longest), i + 1)
                scale = alpha[:, i].copy()
                alpha[:, back] /= scale[:, None]
                scales.append((back.start, np.log(scale)))
        return alpha, scales

    def counts(self, table: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
        """Add to `total` the expected uses of each piece over all segmentations (one language), scaled as in `forward`."""
        alpha, scales = self.forward(table)
        before = np.log(alpha[:, :, 0])
        for start, log in scales:
            before[:, start:] += log
        before -= before[np.arange(len(self.ids)), self.ends, None]
        beta, logs = np.zeros((len(self.ids), self.n + 1)), np.zeros(len(self.ids))
        after = np.full(beta.shape, -np.inf)
        for i in range(self.n, 0, -1):
            beta[self.ends == i, i] = 1
            k, begun = min(self.longest, i), self.ends >= i
            if i % LONG == 0:
                scale = np.where(begun, beta[:, i], 1)
                beta[:, i - k : i + 1] /= scale[:, None]
                logs += np.log(scale)
            after[begun, i] = np.log(beta[begun, i]) + logs[begun]
            beta[:, i - k : i] += table[self.ids[:, i, k:0:-1], 0] * beta[:, i, None]
            beta[:, i - 1] += beta[:, i] * UNKNOWN
        for size in range(1, self.longest + 1):
            ids = self.ids[:, size:, size]
            used = table[ids, 0] * np.exp(before[:, :-size] + after[:, size:]) * weights[:, None]
            total += np.bincount(ids.ravel(), used.ravel(), len(total))


def by_length(words: list[str], at_once: int = 5000, chars: int = 200_000) -> Iterator[list[int]]:
    """Words of one length each, at most `at_once` and about `chars` characters."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for size, g in groups.items():
        step = max(1, min(at_once, chars // max(size, 1)))
        for i in range(0, len(g), step):
            yield g[i : i + step]


def long_groups(words: list[str], chars: int = 200_000) -> Iterator[list[int]]:
    """The words of more than LONG characters by rising length, in groups of about `chars` characters; a longer word is a group of its own."""
    group: list[int] = []
    for i in sorted((i for i, w in enumerate(words) if len(w) > LONG), key=lambda i: len(words[i])):
        if group and (len(group) + 1) * len(words[i]) > chars:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def fit_language(words: list[str], weights: np.ndarray, index: PieceIndex, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of a language by expectation maximisation over its distinct words, of any length.

    Lattices of words of up to LONG characters are kept for all rounds, those of longer ones are made again.
    """
    size = index.absent
    table = np.append(np.full(size, 1 / size), 0)[:, None]
    marked = [WORD_MARK + w for w in words]
    made = lambda g: (Lattice([marked[i] for i in g], index), weights[g])
    lattices = [made(g) for g in by_length(marked) if len(marked[g[0]]) <= LONG]
    for _ in range(rounds):
        total = np.zeros(size + 1)
        for lattice, w in chain(lattices, map(made, long_groups(marked))):
            lattice.counts(table, w, total)
        total = total[:size] + SMOOTHING
        table = np.append(total / total.sum(), 0)[:, None]
    return table[:, 0]


class Model:
    """Languages in code point order and their piece probabilities; picklable and bounded by vocabulary times languages."""

    def __init__(self, pieces: list[str], langs: list[str], table: np.ndarray):
        self.pieces, self.langs, self.table = pieces, langs, table
        self.words = self.index = None

    def __getstate__(self):
        return self.__dict__ | {"words": None, "index": None}

    def forget(self) -> None:
        """Give up what belongs to one worker."""
        self.words = self.index = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, all segmentations summed."""
        out = np.zeros((len(words), len(self.langs)))
        marked = [WORD_MARK + w for w in words]
        for g in by_length(marked):
            lattice = Lattice([marked[i] for i in g], self.index)
            alpha, scales = lattice.forward(self.table)
            out[g] = np.log(alpha[:, -1]) + sum(log for _, log in scales)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if self.words is None:
            self.index = PieceIndex(self.pieces)
            self.words = WordTable(self.word_scores, len(self.langs), np.float64)
        names, scores = [], []
        for i, j in text_runs([t or "" for t in texts]):
            some = [t or "" for t in texts[i:j]]
            counts, sums = self.words.sums(some)
            for text, n, row in zip(some, counts, sums, strict=True):
                if not n or not self.langs or not any(map(str.isalpha, text)):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                best = int(row.argmax())
                names.append(self.langs[best])
                scores.append(float(1 / np.exp(row - row[best]).sum()))
        return names, scores


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str = PIECES, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_FIT_ROWS) -> Model:
    """The model of the languages in `lang`, from a bounded sample of the rows that are not held out."""
    pieces = load_pieces(path)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    luck = draw(key, "fit", F.xxhash64(F.col(text)).cast("string"))
    drawn = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"), luck.alias("draw"))
    sizes = {r["lang"]: r for r in drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn in column {lang}")
    none = Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    if not sizes:
        return none
    share = max(1, max_rows // len(sizes))
    # several times the share by rate, and the row of the smallest draw anyhow, then the first of each language: only few are ranked
    most = F.create_map(*[F.lit(x) for k, r in sizes.items() for x in (k, max(min(1.0, (4 * share + 40) / r.n), float(r.least)))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key", "text"))
    chosen = drawn.where(F.col("draw") <= most[F.col("lang")]).withColumn("rank", rank).where(F.col("rank") <= share)
    counted = chosen.select("lang", F.explode(tokens(F.col("text"))).alias("word")).groupBy("lang", "word").count()

    def fitted(key: tuple, words: pa.Table) -> pa.Table:
        words = words.sort_by("word")
        table = fit_language(words.column("word").to_pylist(), words.column("count").to_numpy().astype(float), PieceIndex(pieces))
        give_back()
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "table": pa.array([table.tobytes()], pa.binary())})

    tables = {r["lang"]: np.frombuffer(r["table"], float) for r in counted.groupBy("lang").applyInArrow(fitted, "lang string, table binary").collect()}
    return Model(pieces, sorted(tables), np.stack([tables[k] for k in sorted(tables)], axis=1)) if tables else none


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) plus __lang (a learned language or `und`) and __score (its posterior at equal priors, 0 to 1)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> list[pa.Array]:
        names, scores = shipped.value.predict(texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return annotate(docs, text, docs.columns if keep is None else keep, "__lang string, __score double", work, lambda: shipped.value.forget())


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` in a learned language with a score of at least `least`, with their columns.

    The answer depends on the text alone, so the hashes of the texts that are refused are written, each once, and the rows that have one go: no
    text comes back from Python, and while the refused are few none is shuffled.
    """
    names = [free_name(docs, k) for k in ("__k1", "__k2")]
    keyed = docs.withColumns(dict(zip(names, text_keys(text), strict=True)))
    box = ["k1", "k2", "text"]
    found = identify(keyed.select(*names, text).toDF(*box), model, "text", keep=box[:2])
    stays = (F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least)
    refused = materialize(found.where(~stays).select("k1", "k2").distinct().toDF(*names), "refused")
    return keyed.join(bounded(refused), names, "left_anti").select(*docs.columns)
