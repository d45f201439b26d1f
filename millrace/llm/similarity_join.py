"""Jaccard self-join of documents on word shingles by a count-vector R-tree, and its connected classes.

Texts with the same set of shingles form a class (named by BLAKE2b of the set); only one of each goes
on. A class's shingles are hashed into GROUPS groups; the counts per group are a point. For two points
the sum of the coordinate minima is an upper bound of the overlap, and for a box of points the minima
with its upper corner are. An R-tree over the points of a routing bucket finds the pairs whose bound
reaches the threshold; those are verified on the full sets.

Routing: two sets at similarity 0.8 or more share a hash among the n / 5 + 1 smallest of each, their
prefixes. A class goes to the buckets of its prefix, of SKETCH hashes at most, and a pair belongs to the bucket of
its smallest shared hash alone, so no pair is counted twice. Hashes are 64 bits under a random key
that is drawn for each run, so that no text can be written to collide, and whatever the texts, a pair of
sets with longer prefixes shares none of its sketches with probability at most 0.2 ** SKETCH, 1.7e-17: as
likely as a collision among a few dozen hashes. `sketch=None` routes by whole prefixes and loses nothing
but costs four times the shuffle.

A bucket of more than BUCKET classes is split: classes of one band of sizes (a factor of 5 / 4) are
dealt into chunks, and only chunks of the same or of neighbouring bands meet, in buckets of their own, since sizes of
linked sets differ by a factor of 5 / 4 at most. Groups to verify are split by GROUP sets and by
SHINGLES in the same way: memory stays bounded and no pair is lost.

Buckets emit classes with a group number, verification emits one row per class and group (its number
of links and a neighbour towards the group's root); neither emits pairs, so rows grow with the
classes and not with the square of a group. Connected components come from alternating large-star
and small-star steps on those rows, cut by written tables.

Defined cases: null text, no words: empty set, linked with nothing; null ids are allowed and never
are the smallest id of a class that has another; rows that repeat are copies in one class; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded, column, discard, free_name, materialize, new_key, packs_of, shingle_sets, slices, tidy, utf8

GROUPS = 64
SKETCH = 24
BUCKET = 1536
GROUP = 1024
SHINGLES = 1 << 22
LEAF = 32
#: Hashes that a bucket sees of each class: those that precede its own in the prefix; verification sees them all.
RECENT = 24
#: Linked: SHARE[0] * intersection >= SHARE[1] * (size + size), which is 100 * intersection >= 80 * union.
SHARE = (9, 4)
COUNT, FULL = np.dtype("u1"), 255


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes (in ascending order)."""
    one, two = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(one), int(two)


def prefix(s: np.ndarray, sketch: int | None) -> np.ndarray:
    """The smallest hashes of a set, one more than may be missing from a set that is linked to it, or `sketch` of them."""
    return s[: min(len(s) // 5 + 1, sketch or len(s))]


def features(docs: DataFrame, key: str, text: str, secret: int, carry: dict[str, Column] | None = None, sketch: int | None = SKETCH) -> DataFrame:
    """Per document: n, its class (c1, c2), its prefix, its point, and the columns (longs) of `carry`."""
    carry = carry or {}
    names = ["key", "n", "c1", "c2", "prefix", "point", *carry]

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            items = [x.translate(LOWER) for x in utf8(b, "text")]
            n, c1, c2, first, point = [], [], [], [], []
            for i, j in packs_of(items):
                for s in shingle_sets(items[i:j], secret):
                    one, two = signature(s)
                    n.append(len(s))
                    c1.append(one)
                    c2.append(two)
                    first.append(prefix(s, sketch).view(np.int64))
                    point.append(np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), FULL).astype(COUNT).tobytes())
            cols = [column(b, "key"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(point, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *(column(b, k) for k in names[6:])], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n long, c1 long, c2 long, prefix array<long>, point binary" + "".join(f", {k} long" for k in carry)
    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(c.alias(k) for k, c in carry.items())).mapInArrow(run, schema)
    return made.withColumn("row", F.monotonically_increasing_id())


class RTree:
    """Points in leaves of at most LEAF by recursive median cuts along the widest coordinate; boxes keep the upper corner and the least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes, self.leaves = points, sizes, []
        todo = [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                self.leaves.append(at)
                continue
            p = points[at]
            order = np.argsort(p[:, int(np.argmax(p.max(axis=0) - p.min(axis=0)))], kind="stable")
            todo += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
        self.corner = np.stack([points[at].max(axis=0) for at in self.leaves])
        self.least = np.array([sizes[at].min() for at in self.leaves])

    def leaf_pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of leaves k <= l that the bound of their boxes leaves."""
        for k in range(len(self.leaves)):
            bound = np.minimum(self.corner[k], self.corner[k:]).sum(axis=1, dtype=np.int64)
            for o in np.flatnonzero(SHARE[0] * bound >= SHARE[1] * (self.least[k] + self.least[k:])).tolist():
                yield k, k + o

    def fits(self, k: int, other: int) -> np.ndarray:
        """Which points of two leaves may be linked by their bound; of a leaf with itself each pair once."""
        at, to = self.leaves[k], self.leaves[other]
        bound = np.minimum(self.points[at][:, None], self.points[to][None]).sum(axis=2, dtype=np.int64)
        fits = SHARE[0] * bound >= SHARE[1] * (self.sizes[at][:, None] + self.sizes[to][None])
        return np.triu(fits, 1) if k == other else fits


class Sets:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """Matrix of common elements of any two lists of distinct hashes; elements in one list only are left out first."""
    m = len(lists)
    if m == 2 and len(lists[0]) and len(lists[1]):
        both = len(np.intersect1d(lists[0], lists[1], assume_unique=True))
        return np.array([[len(lists[0]), both], [both, len(lists[1])]])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))[: len(flat)]
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1 if len(flat) else np.zeros(0, bool)
    number, owner = number[many], owner[many]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    out, width = np.zeros((m, m)), 4096
    for lo in range(0, int(number.max()) + 1 if len(number) else 0, width):
        i, j = np.searchsorted(number, (lo, lo + width))
        part = np.zeros((m, width), np.float32)
        part[owner[i:j], number[i:j] - lo] = 1
        out += part @ part.T
    return out


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys in a sorted stream."""
    at, rows = None, []
    for b in slices(batches, 500):
        for k, row in zip(zip(*(column(b, n).to_pylist() for n in keys), strict=True), zip(*(column(b, n).to_pylist() for n in names), strict=True), strict=True):
            if k != at:
                if rows:
                    yield at, rows
                at, rows = k, []
            rows.append(row)
    if rows:
        yield at, rows


def owned(smaller: list[np.ndarray]) -> np.ndarray:
    """Pairs that share no hash below the bucket's own: a pair belongs to the bucket of its smallest shared hash."""
    return overlaps(smaller) == 0


@tidy()
def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: the classes that have a partner by the R-tree's bound, numbered by connected group."""
    names = ["token", "i", "j", "root", "c1", "c2", "n", "chunk"]
    out = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    for (token, i, j), rows in groups_of(batches, ["token", "i", "j"], ["c1", "c2", "n", "chunk", "point", "recent"]):
        if len(rows) < 2:
            continue
        chunk = np.array([r[3] for r in rows])
        points = np.frombuffer(b"".join(r[4] for r in rows), COUNT).reshape(-1, GROUPS).astype(np.int32)
        points[points == FULL] = 1 << 24  # a count that did not fit bounds nothing
        tree = RTree(points, np.array([r[2] for r in rows]))
        recent = [np.array(r[5], np.int64) for r in rows]
        shared = [frozenset.intersection(*(frozenset(rows[x][5]) for x in at)) for at in tree.leaves]
        joined, partner = Sets(len(rows)), np.zeros(len(rows), bool)
        for k, other in tree.leaf_pairs():
            if shared[k] & shared[other]:
                continue  # all pairs belong to the bucket of a smaller hash
            at, to = tree.leaves[k], tree.leaves[other]
            if partner[at].all() and partner[to].all() and len({joined.root(x) for x in (*at.tolist(), *to.tolist())}) == 1:
                continue  # nothing to find out: all are in one group
            keep = tree.fits(k, other)
            if keep.any():
                keep &= owned([recent[x] for x in (*at.tolist(), *to.tolist())])[: len(at), len(at) :]
                if i != j:
                    keep &= chunk[at][:, None] != chunk[to][None]
            for x, y in zip(*(v.tolist() for v in np.nonzero(keep)), strict=True):
                joined.join(int(at[x]), int(to[y]))
                partner[at[x]] = partner[to[y]] = True
        out += [(token, i, j, joined.root(k), *rows[k][:4]) for k in np.flatnonzero(partner).tolist()]
        if len(out) >= 5000:
            yield batch()
            out.clear()
    yield batch()


def lowest_linked(linked: np.ndarray) -> list[int]:
    """Per row the smallest row of its component."""
    first = np.arange(len(linked), dtype=np.int32)
    while True:
        step = np.minimum(first, np.where(linked, first, len(linked)).min(axis=1))
        if (step == first).all():
            return first.tolist()
        first = step


def verify(sketch: int | None):
    """A map of groups to each linked class, its links in documents, and the first class of its component in the group."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c1", "c2", "links", "p1", "p2"]
        out = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        keys = ["token", "i", "j", "root", "gi", "gj"]
        for (token, i, j, _, gi, gj), rows in groups_of(batches, keys, ["c1", "c2", "chunk", "part", "copies", "hashes"]):
            rows = list({(r[0], r[1]): r for r in rows}.values())
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            n = np.array([len(s) for s in sets], np.float64)
            linked = SHARE[0] * overlaps(sets) >= SHARE[1] * (n[:, None] + n[None])
            np.fill_diagonal(linked, False)
            for split, values in ((i != j, [r[2] for r in rows]), (gi != gj, [r[3] for r in rows])):
                if split:
                    linked &= np.array(values)[:, None] != np.array(values)[None]
            if not linked.any():
                continue
            own = np.array(token, np.int64).view(np.uint64)
            linked &= owned([(first := prefix(s, sketch))[first < own] for s in sets])
            links = np.where(linked, np.array([r[4] for r in rows]), 0).sum(axis=1)
            lowest = lowest_linked(linked)
            for k in np.flatnonzero(linked.any(axis=1)).tolist():
                out.append((rows[k][0], rows[k][1], int(links[k]), rows[lowest[k]][0], rows[lowest[k]][1]))
            if len(out) >= 5000:
                yield batch()
                out.clear()
        yield batch()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node of u's connected component, u itself left out. `edges` has u, v, any direction."""
    flip = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m"))
    current = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            return current
        seen = state
        both = flip(current)
        large = both.join(least(both).select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = least(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, current = current, materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(before)


def node(a: str, b: str) -> Column:
    """The name of a class in the graph of links."""
    return F.concat(F.hex(a), F.lit("."), F.hex(b))


def bucketed(reps: DataFrame) -> DataFrame:
    """(token, i, j, c1, c2, n, chunk, point, recent): the classes of `reps` in the buckets of their prefixes that others go to as well."""
    placed = reps.select(F.posexplode("prefix").alias("at", "token"), "row", "n")
    tokens = materialize(placed.groupBy("token").count().where("count > 1"), "tokens")
    band = F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("long")
    # a hot token has BUCKET classes or more, and bands grow with the logarithm of the sizes: both tables are small
    hot = bounded(tokens.where(F.col("count") > BUCKET).select("token"))
    sizes = placed.join(hot, "token").groupBy("token", band.alias("band")).count()
    chunks = F.ceil(F.col("count") / BUCKET).cast("long")
    bands = bounded(materialize(sizes.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", chunks))).alias("bands")), "bands"))
    routed = placed.join(tokens.select("token"), "token").join(bands, "token", "left").withColumn("band", band)
    code = lambda band, k: band * F.lit(1 << 32) + k
    own = F.when(F.col("bands").isNotNull(), code(F.col("band"), F.pmod(F.xxhash64("row"), F.col("bands")[F.col("band")]))).otherwise(F.lit(0).cast("long"))
    near = F.filter(F.sequence(F.col("band") - 1, F.col("band") + 1), lambda b: F.col("bands")[b].isNotNull())
    met = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), F.col("bands")[b] - 1), lambda k: code(b, k))))
    others = F.when(F.col("bands").isNotNull(), met).otherwise(F.array(F.lit(0).cast("long")))
    split = routed.withColumn("chunk", own).withColumn("other", F.explode(others)).select("token", "at", "row", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    recent = F.slice("prefix", F.greatest(F.col("at") - (RECENT - 1), F.lit(1)), F.least(F.col("at"), F.lit(RECENT)))
    return split.join(reps, "row").select("token", "i", "j", "c1", "c2", "n", "chunk", "point", recent.alias("recent"))


def linked_classes(docs: DataFrame, rows: DataFrame, key: str, text: str, secret: int, sketch: int | None = SKETCH) -> tuple[DataFrame, DataFrame]:
    """From the features of `docs`: (c1, c2, first, copies) of every class, and (c1, c2, root, component, links) of those that are linked."""
    some = rows.where("n > 0")
    classes = materialize(some.groupBy("c1", "c2").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")), "classes")
    reps = materialize(some.select("row", "key", "n", "c1", "c2", "prefix", "point").join(bounded(classes.select("row")), "row", "left_semi"), "reps")

    buckets = bucketed(reps).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    members = materialize(buckets.mapInArrow(route, "token long, i long, j long, root long, c1 long, c2 long, n long, chunk long"), "members")

    wanted = members.select("c1", "c2").distinct().join(reps.select("c1", "c2", "key"), ["c1", "c2"])
    wanted = materialize(wanted.select("key").distinct(), "wanted")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(bounded(wanted).withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")), "left_semi")
    sets = texts.select("text").mapInArrow(full_sets(secret), "c1 long, c2 long, hashes binary")
    group = ["token", "i", "j", "root"]
    many = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / SHINGLES))
    large = bounded(materialize(members.groupBy(*group).agg(many.alias("parts")).where("parts > 1"), "large"))
    split = members.join(large, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", F.pmod("c2", "parts"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    split = split.withColumns({"gi": F.least("part", "other"), "gj": F.greatest("part", "other")}).drop("other", "parts", "n")
    groups = (
        split.join(classes.drop("first", "row"), ["c1", "c2"]).join(sets, ["c1", "c2"]).repartition(*group, "gi", "gj").sortWithinPartitions(*group, "gi", "gj")
    )
    found = materialize(groups.mapInArrow(verify(sketch), "c1 long, c2 long, links long, p1 long, p2 long"), "links")
    discard(members, reps, wanted)

    roots = components(found.select(node("c1", "c2").alias("u"), node("p1", "p2").alias("v")))
    linked = found.groupBy("c1", "c2").agg(F.sum("links").alias("links")).join(classes.drop("row"), ["c1", "c2"]).withColumn("u", node("c1", "c2"))
    rooted = linked.join(roots, "u", "left").withColumn("root", F.coalesce("v", "u"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    placed = materialize(rooted.join(smallest, "root").select("c1", "c2", "root", "component", "links"), "placed")
    discard(found, roots)
    return classes, placed


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """Per row of `docs`: key, n_shingles, component_id (smallest key reachable by links), n_links (rows linked to it)."""
    secret = new_key()
    rows = materialize(features(docs, key, text, secret, sketch=sketch), "features")
    classes, placed = linked_classes(docs, rows, key, text, secret, sketch)
    table = classes.join(bounded(placed.drop("root")), ["c1", "c2"], "left").select("c1", "c2", F.coalesce("component", "first").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    empty = F.col("n") == 0
    return rows.join(table, ["c1", "c2"], "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("key")).otherwise(F.col("component")).alias("component_id"),
        F.when(empty, F.lit(0).cast("long")).otherwise(F.col("links")).alias("n_links"),
    )


def full_sets(secret: int):
    """A map of texts to their classes and whole sets."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            items = [x.translate(LOWER) for x in utf8(b, "text")]
            sets = [s for i, j in packs_of(items) for s in shingle_sets(items[i:j], secret)]
            ids = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["c1", "c2", "hashes"]
            )

    return run


def marks(key: str, text: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart by key (null is a key of its own) and text."""
    row = F.isnull(key), F.col(key), F.col(text)
    return F.xxhash64(*row), F.xxhash64(F.lit("second"), *row)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each component, one with its smallest key, with the columns of `docs`; rows with an empty set all stay.

    Survivors are chosen by component and told apart by key and text, so keys may be null or repeat: unlike
    texts all stay. A component without a key keeps one row; of rows equal in key and text any one stays.
    """
    secret, one, two, again = new_key(), *(free_name(docs, n) for n in ("__m1", "__m2", "__again"))
    rows = materialize(features(docs, key, text, secret, dict(zip(("m1", "m2"), marks(key, text), strict=True))), "features")
    _, placed = linked_classes(docs, rows, key, text, secret)
    equal = rows.where("n > 0").groupBy("c1", "c2", "m1", "m2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("rows"))
    best = equal.groupBy("c1", "c2").agg(F.min(F.struct(F.isnull("key").alias("none"), "key", "m1", "m2", "rows")).alias("best"))
    rooted = best.join(bounded(placed.select("c1", "c2", "root")), ["c1", "c2"], "left")
    first = rooted.groupBy(F.coalesce("root", node("c1", "c2")).alias("root")).agg(F.min("best").alias("best"))
    kept = first.select(F.col("best.m1").alias(one), F.col("best.m2").alias(two), (F.col("best.rows") > 1).alias(again))
    empty = rows.where("n = 0").select(F.col("m1").alias(one), F.col("m2").alias(two), F.lit(False).alias(again)).distinct()
    kept = materialize(kept.unionByName(empty), "kept")
    discard(rows, placed)
    found = docs.withColumns(dict(zip((one, two), marks(key, text), strict=True))).join(bounded(kept), [one, two])
    out = found.where(~F.col(again)).select(*docs.columns)
    if kept.where(again).isEmpty():
        return out
    return out.unionByName(found.where(again).dropDuplicates([one, two]).select(*docs.columns))
