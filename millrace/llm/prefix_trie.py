"""Conversation prefix trie by prefix-doubling naming.

A turn is known by the SHA-256 of its role and text; texts are read once and never shuffled. Equal turns get one
dense number as their name. A block of 2^k turns that begins at a multiple of 2^k is named by the pair of the names of its
halves, in one join round for each k; there are no more blocks than turns. A prefix of d turns is cut by the binary
digits of d into such blocks: without the last of them it is a shorter prefix, so its name comes from
the pair (name of that prefix, name of that block), one round for each digit, highest first. Equal names
mean equal prefixes, so a group of rows of one name is a node of the trie. A conversation of n turns costs O(n) rows and
O(log n) rounds, and no row holds more than two names.

Sums over subtrees need no walk: each node belongs to the path of its smallest member, and a node's subtree is
made of the paths of its members from its own depth on. So sums from the end of each path, made in chunks, and one aggregate over
(member, node) rows give them at any depth.

Turns are numbered in ranges of their order that tasks number on their own, so a conversation may hold any
share of the rows. Joins back from names are broadcast within the bound of `bounded`, else AQE splits
hot names. One thing is sequential by its definition: the digest of the ids that end at a node streams through one task a node.

Defined cases: rows without a conversation id belong to no conversation and are left out; a null role or
text is empty, a null turn comes first; turns of one number are in order of role and text, and repeated
rows count as often as they occur; texts and conversations may be of any length; an empty table has no nodes,
not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, column, discard, materialize, positions, tidy, with_copies

#: Conversations are rebuilt upon the first turns of the first of each so many ids, of which they take fewer than SHARED.
FAMILY, SHARED = 100, 6
#: Turns of a conversation that are summed in one window.
CHUNK = 1024


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv, pos, key, chars) of rows (conv_id, turn, role, text): the turns of each conversation from 0 on, each by a digest and its length in code points."""
    role, text = (F.coalesce(F.col(k), F.lit("")) for k in ("role", "text"))
    some = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    narrow = with_copies(some, ["conv", "turn"], ["role", "text"]).select("conv", "turn", "copy", key.alias("key"), F.length("text").cast("long").alias("chars"))
    return positions(narrow, "conv", [F.col("turn").asc_nulls_first(), F.col("copy").asc()], "pos").select("conv", "pos", "key", "chars")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """(conv, pos, key, chars) of the conversations c, each with the first h turns of c - c % family in place of its own first h, h = crc32(c) % shared; plus a row of pos -1 for each conversation."""
    turns = materialize(turns, "turns")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    head = F.crc32(F.col("conv").cast("string")) % shared
    convs = materialize(sizes.select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), head.alias("h")), "conversations")
    firsts = convs.where(F.col("conv") == F.col("base")).select("base", F.col("n").alias("base_n"))
    heads = convs.join(firsts, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m"))
    lent = turns.where((F.col("pos") < shared) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    begin = heads.select("conv", "base", "h").join(lent, "base").where("pos < h").select("conv", "pos", "key", "chars")
    # as turns of one conversation may be most of the table, the narrow side is broadcast if it is small
    rest = turns.join(bounded(materialize(heads.select("conv", "h", "m"), "heads")), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "key", "chars")
    roots = convs.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"))
    return begin.unionByName(rest).unionByName(roots)


def named(rows: DataFrame, what: list[str], first: int) -> tuple[DataFrame, int]:
    """`rows` with `name` in place of the columns `what`: dense numbers from `first` on, one for each of their distinct values; and the number that follows."""
    values = materialize(rows.select(*what).distinct().withColumn("__id", F.monotonically_increasing_id()), "names")
    part = F.shiftright("__id", 33)
    sizes = {r["part"]: r["n"] for r in values.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    offsets, total = {}, first
    for k in sorted(sizes):
        offsets[k], total = total, total + sizes[k]
    if not offsets:
        return rows.withColumn("name", F.lit(0).cast("long")).drop(*what), first
    offset = F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair])[part.cast("long")]
    numbered = values.select(*what, (F.col("__id").bitwiseAND((1 << 33) - 1) + offset).alias("name"))
    return rows.join(F.broadcast(numbered) if total - first <= BROADCAST_ROWS else numbered, what).drop(*what), total


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv, d, name) of all prefixes of turns (conv, pos, key) with pos >= 0, and of the empty prefix (d 0, name 0) of the rows with pos -1."""
    longest = turns.agg(F.max("pos")).first()[0]
    level, after = named(turns.where("pos >= 0").select("conv", F.col("pos").alias("j"), "key"), ["key"], 1)
    blocks = [materialize(level, "blocks")]
    while 2 << len(blocks) - 1 <= (longest or 0) + 1:  # blocks[k]: (conv, j, name) of the 2^k turns from j * 2^k on
        side = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name"))).alias("ab"[odd])
        pairs = blocks[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(side(0), side(1)).where("a IS NOT NULL AND b IS NOT NULL")
        pairs = materialize(pairs, "pairs")
        level, after = named(pairs, ["a", "b"], after)
        blocks.append(materialize(level, "blocks"))
        discard(pairs)
    pieces = [turns.where("pos = -1").select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"))]
    known = pieces[0]
    for k in reversed(range(len(blocks))):
        step = known.select("conv", F.shiftright("d", k).alias("j"), "d", F.col("name").alias("a"))
        joined = step.join(blocks[k].withColumnRenamed("name", "b"), ["conv", "j"]).select("conv", (F.col("d") + (1 << k)).alias("d"), "a", "b")
        level, after = named(materialize(joined, "steps"), ["a", "b"], after)
        pieces.append(materialize(level.select("conv", "d", "name"), "prefixes"))
        known = known.unionByName(pieces[-1])
    return known


def suffix_sums(rows: DataFrame, sums: list[str]) -> DataFrame:
    """`rows` (conv, d, ...) with the columns `sums` summed from each row to its conversation's end: windows of CHUNK rows upon sums of the chunks behind them."""
    chunked = rows.withColumn("chunk", F.floor(F.col("d") / CHUNK))
    later = Window.partitionBy("conv").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = chunked.groupBy("conv", "chunk").agg(*(F.sum(c).alias(c) for c in sums)).select("conv", "chunk", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in sums))
    own = Window.partitionBy("conv", "chunk").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = chunked.join(total, ["conv", "chunk"])
    return joined.select(*(c for c in rows.columns if c not in sums), *((F.sum(c).over(own) + F.col(f"later_{c}")).alias(c) for c in sums))


def ends(rows: DataFrame) -> DataFrame:
    """(name, ends_sha256): the digest of the ids, ascending and joined by commas, of the rows (name, conv); a node's ids are streamed."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for b in batches:
            for name, conv in zip(column(b, "name").to_pylist(), column(b, "conv").to_pylist(), strict=True):
                if name != at:
                    if digest:
                        out.append((at, digest.hexdigest()))
                    at, digest = name, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield batch_of(out)
            out = []
        yield batch_of([(at, digest.hexdigest())] if digest else [])

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["name", "ends_sha256"])

    return rows.select("name", "conv").repartition("name").sortWithinPartitions("name", "conv").mapInArrow(run, "name long, ends_sha256 string")


def nodes(turns: DataFrame) -> DataFrame:
    """A row a node of the trie of turns (conv, pos, key, chars; pos -1 for each conversation): conv_id (smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (summed over its subtree, (n_convs - 1) times the code points of a node's last turn), ends_sha256 (of the members that end there)."""
    turns = materialize(turns, "rebuilt")
    prefixes = materialize(prefix_names(turns), "prefixes")
    none = F.lit(None).cast("long")
    own = prefixes.select("conv", "d", "name", none.alias("up"), none.alias("chars"), F.lit(False).alias("more"))
    above = prefixes.select("conv", (F.col("d") + 1).alias("d"), none.alias("name"), F.col("name").alias("up"), none.alias("chars"), F.lit(False).alias("more"))
    said = turns.where("pos >= 0").select("conv", (F.col("pos") + 1).alias("d"), none.alias("name"), none.alias("up"), "chars", F.lit(False).alias("more"))
    follows = prefixes.where("d > 0").select("conv", (F.col("d") - 1).alias("d"), none.alias("name"), none.alias("up"), none.alias("chars"), F.lit(True).alias("more"))
    both = own.unionByName(above).unionByName(said).unionByName(follows)
    rows = both.groupBy("conv", "d").agg(F.max("name").alias("name"), F.max("up").alias("up"), F.max("chars").alias("chars"), F.bool_or("more").alias("more")).where("name IS NOT NULL")
    rows = materialize(rows, "members")
    grouped = rows.groupBy("name").agg(F.min("conv").alias("conv"), F.max("d").alias("d"), F.max("up").alias("up"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n_convs"))
    grouped = materialize(grouped, "nodes")
    children = grouped.where("up IS NOT NULL").groupBy(F.col("up").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    found = materialize(grouped.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")
    discard(grouped)
    saved = (F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))
    paths = found.select("conv", "d", none.alias("name"), saved.alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    zero = F.lit(0).cast("long")
    members = rows.select("conv", "d", "name", zero.alias("saved"), zero.alias("leaves")).unionByName(paths).groupBy("conv", "d").agg(F.max("name").alias("name"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    sums = suffix_sums(members, ["saved", "leaves"]).groupBy("name").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    top = bounded(found.select(F.col("name").alias("up"), F.col("conv").alias("parent_conv_id")))
    out = found.join(sums, "name").join(ends(rows.where("NOT more")), "name", "left").join(top, "up", "left")
    nobody: Column = F.sha2(F.lit(""), 256)
    return out.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
