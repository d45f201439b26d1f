"""URL filters: a sort-merge range join of urls with prefix rules.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's.
The canonical key of a host is its labels in reverse, each followed by a dot, so the hosts that a rule
host covers are the interval of keys that start with its key; with a path behind it, so are the urls
of one host. A subdomain and a path prefix at once are no single interval in any order, so two sweeps are made:
one over hosts finds the rule hosts that are open at each, one over (rule host, path) finds the
innermost rule of each of them. A sweep takes rules and rows in the order of their keys and keeps the
rules that are open as a stack, since intervals of prefixes are nested or apart. Of the rules that fit,
that with the longest host wins, then that with the longest path.

Up to BROADCAST_RULES rules (of RULE_BYTES in all) are shipped to the tasks, each of which sorts the keys of
its own rows, a batch at a time, and sweeps: nothing is shuffled. Beyond it rules and rows are dealt out
by ranges of the key, however many share a host; a range is given the rules that are open where it
begins, and a task streams its ranges.

Defined cases: a null url or one without `://` has empty host and path and the default verdict; hosts are taken
literally (user, port and trailing dot belong to it), A-Z lower-cased; a rule path that neither is empty
nor starts with `/` fits nothing; a null host fits nothing, a null path is empty; of rules for one
host and path the greatest verdict holds (`block` over `allow`); repeated and null ids are rows of
their own; no rules leave the default; empty tables give no rows; urls of any length are read whole;
other columns pass through, and those named as an output column are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, bounded, boxed, column, discard, materialize, quoted, tidy

DEFAULT = "allow"
BROADCAST_RULES, RULE_BYTES = 1 << 14, 1 << 22
BATCH = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what stands after the first `://` up to `/`, `?`, `#` or the end; path: from there up to `?`, `#` or the end."""
    rest = F.coalesce(F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def canonical(rules: DataFrame) -> DataFrame:
    """(host_key, path, rule, verdict) of the rules that can fit, one a host and path."""
    path = F.coalesce("path", F.lit(""))
    host = F.translate("host", UPPER, LOWER)
    usable = rules.where(F.col("host").isNotNull() & ((path == "") | path.startswith("/")))
    return usable.groupBy(host.alias("host"), path.alias("path")).agg(F.max("verdict").alias("verdict")).select(host_key(F.col("host")).alias("host_key"), "path", F.concat("host", "path").alias("rule"), "verdict")


def sweep(events: Iterable[tuple]) -> Iterator[tuple]:
    """Events (key, 0, rule) and (key, 1, row) in order; each row with the stack of the (key, rule) open at it, which is valid until the next step."""
    stack: list[tuple] = []
    for key, kind, what in events:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind:
            yield what, stack
        elif not stack or stack[-1][0] != key:
            stack.append((key, what))


class Rules:
    """Few rules, in the order of their keys."""

    def __init__(self, rows: list):
        self.hosts = [(k, 0, k) for k in sorted({r.host_key for r in rows})]
        self.rules = sorted((r.host_key + r.path, 0, (len(r.host_key), r.rule, r.verdict)) for r in rows)

    def judge(self, urls: list[str], default: str) -> tuple[list, list]:
        """Rules and verdicts of urls given as host and path in one string: a host has no `/`, and a path is empty or begins with it."""
        split = [u.partition("/") for u in urls]
        open_at = {host: [k for k, _ in stack] for host, stack in sweep(heapq.merge(self.hosts, sorted((reversed_host(h), 1, h) for h in {s[0] for s in split})))}
        probes = sorted((key + slash + path, 1, row) for row, (host, slash, path) in enumerate(split) for key in open_at[host])
        best = [(0, None, default)] * len(urls)
        for row, stack in sweep(heapq.merge(self.rules, probes)):
            if stack and stack[-1][1][0] > best[row][0]:
                best[row] = stack[-1][1]
        return [b[1] for b in best], [b[2] for b in best]


def swept(rules: DataFrame, rows: DataFrame, whole_stack: bool) -> DataFrame:
    """(row, size, rule, verdict): for each of `rows` (key, row) the innermost of `rules` (key, size, rule, verdict) that is open at it, or all of them.

    Both are dealt out by ranges of the key; rules open at the first key of a range are prefixes of it, and are looked up as such.
    """
    none = lambda kind: F.lit(None).cast(kind)
    opening = rules.select("key", F.lit(0).alias("kind"), none("string").alias("row"), "size", "rule", "verdict")
    events = opening.unionByName(rows.select("key", F.lit(1).alias("kind"), F.col("row").cast("string").alias("row"), none("int").alias("size"), none("string").alias("rule"), none("string").alias("verdict")))
    ranged = materialize(events.repartitionByRange("key", "kind", "row").withColumn("part", F.spark_partition_id()), "ranges")
    longest = rules.agg(F.max(F.length("key"))).first()[0] or 0
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    sizes = F.sequence(F.lit(1), F.least(F.length("first"), F.lit(longest)))
    prefixes = firsts.where(F.length("first") > 0).select("part", "first", F.explode(sizes).alias("n")).select("part", F.left("first", F.col("n")).alias("key"))
    carried = prefixes.join(opening, "key").select(*ranged.columns)
    names = ["row", "size", "rule", "verdict"]

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events() -> Iterator[tuple]:
            at = None
            for b in batches:
                for part, key, kind, *what in zip(*(column(b, n).to_pylist() for n in ("part", "key", "kind", *names)), strict=True):
                    if part != at:
                        yield "", 1, None  # a range begins: what is open in the one before is closed
                        at = part
                    yield key, kind, what[0] if kind else what[1:]

        out = []
        for row, stack in sweep(events()):
            if row is None:
                continue
            out += [(row, *rule) for _, rule in (stack if whole_stack else stack[-1:])]
            if len(out) >= BATCH:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "size" else pa.string()) for c, n in zip(cols, names, strict=True)], names)

    ordered = ranged.unionByName(carried).repartition("part").sortWithinPartitions("part", "key", "kind")
    return ordered.mapInArrow(run, "row string, size int, rule string, verdict string")


def judged_by_ranges(keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """`keyed` (host, path and other columns) plus rule and verdict, rules and urls dealt out by ranges of their keys."""
    rows = materialize(keyed.withColumn("at", F.monotonically_increasing_id()), "urls")
    hosts = rules.groupBy(F.col("host_key").alias("key")).agg(F.first("host_key").alias("rule")).select("key", F.length("key").alias("size"), "rule", F.lit("").alias("verdict"))
    seen = rows.select("host").distinct().select(host_key(F.col("host")).alias("key"), F.col("host").alias("row"))
    open_at = materialize(swept(hosts, seen, True).select(F.col("row").alias("host"), F.col("rule").alias("host_key")), "open")
    probes = rows.join(bounded(open_at), "host").select(F.concat("host_key", "path").alias("key"), F.col("at").alias("row"))
    ranked = rules.select(F.concat("host_key", "path").alias("key"), F.length("host_key").alias("size"), "rule", "verdict")
    best = swept(ranked, probes, False).groupBy("row").agg(F.max(F.struct("size", "rule", "verdict")).alias("b"))
    found = best.select(F.col("row").cast("long").alias("at"), F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    return rows.join(found, "at", "left").withColumn("verdict", F.when(F.col("rule").isNull(), default).otherwise(F.col("verdict"))).drop("at")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, keep: list[str] | None = None, limit: int = BROADCAST_RULES) -> DataFrame:
    """`pages` (or its columns `keep`) plus __host, __path, __rule (host and path of the rule that wins, else null) and __verdict (the rule's, else `default`)."""
    made = ["__host", "__path", "__rule", "__verdict"]
    kept, names = boxed(pages, pages.columns if keep is None else keep, made)
    box = [f"c{k}" for k in range(len(names))]
    host, path = host_and_path(quoted(url))
    keyed = pages.select(*kept, host.alias("host"), path.alias("path"))
    table = materialize(canonical(rules), "rules")
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host_key") + F.octet_length("rule")), F.lit(0))).first()
    if n > limit or size > RULE_BYTES:
        out = judged_by_ranges(keyed, table, default)
    else:
        few = keyed.sparkSession.sparkContext.broadcast(Rules(table.collect()))
        discard(table)

        def work(urls: list[str]) -> list[pa.Array]:
            return [pa.array(c, pa.string()) for c in few.value.judge(urls, default)]

        out = annotate(keyed.withColumn("url", F.concat("host", "path")), "url", [*box, "host", "path"], "rule string, verdict string", work, rows=BATCH)
    return out.select(*box, "host", "path", "rule", "verdict").toDF(*names, *made)


def drop_blocked(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The pages that no rule blocks, with their columns."""
    box = [f"c{k}" for k in range(len(pages.columns))]
    found = judge(pages.toDF(*box), rules, box[pages.columns.index(url)])
    return found.where("__verdict <> 'block'").select(*box).toDF(*pages.columns)
