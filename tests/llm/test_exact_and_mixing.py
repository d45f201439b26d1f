import hashlib
import math

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, queries
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, kept string, size long, target double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "k", -1, -1.0) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_cases(spark):
    prefix = "p" * 100
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é"), (6, prefix + "x"), (7, prefix + "y"), (8, prefix + "x"), (9, "z" * 50_000), (10, "z" * 50_000), (2, "a"), (None, "a"), (11, "b"), (12, "a ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine"))
    got = exact_dedup.exact_duplicates(df).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = sorted((tuple(r) for r in got.select("doc_id", "__keep_id", "__group_size", "__kept", "sha").collect()), key=str)
    assert found == brute_exact(rows)
    kept = exact_dedup.drop_exact(df)
    assert kept.columns == df.columns and {r.kept for r in kept.collect()} == {"mine"}
    assert exact_dedup.exact_duplicates(df.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "n"), (None, "n")], "doc_id long, text string")
    assert {(r["__keep_id"], r["__kept"]) for r in exact_dedup.exact_duplicates(nulls).collect()} == {(None, True)}


def test_exact_hashes_in_full_only_what_recurs(spark):
    df = docs(spark, [(1, "same", "s"), (2, "same", "s"), (3, "lone text", "s")])
    assert {r.doc_id: r.full is not None for r in exact_dedup.refine(df, F.col("text"), F.sha2("text", 256)).collect()} == {1: True, 2: True, 3: False}


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_ROWS, 0])
def test_exact_beyond_the_broadcast_bound_and_with_clashing_names(spark, limit):
    rows = [(k, f"text {k % 7}" if k % 3 else f"alone {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"full": F.lit("mine"), "len": F.lit(1), "__kept": F.lit("gone"), "c0": F.lit("box")})
    got = exact_dedup.exact_duplicates(df, limit=limit)
    assert got.columns == ["doc_id", "text", "full", "len", "c0", "__keep_id", "__group_size", "__kept"]
    found = got.withColumn("sha", F.sha2("text", 256)).select("doc_id", "__keep_id", "__group_size", "__kept", "sha").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_exact(rows)
    assert exact_dedup.drop_exact(df).columns == df.columns


def level(sizes, weights, cap=3):
    """Share and share again until no source is above its cap."""
    total, fixed = sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        rest = total - sum(fixed.values())
        target = {k: rest * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if target[k] > cap * sizes[k]]
        if not over:
            return [fixed.get(k, target.get(k)) for k in range(len(sizes))]
        fixed |= {k: cap * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1, 1000, 5, 2, 700], [0, 5], [7], [1, 100, 3, 40, 0, 9, 2]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = level(sizes, [1 + k % 3 for k in range(len(sizes))])
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes))


def test_targets_of_many_sources_in_several_ranges(spark):
    sizes = [0 if k % 17 == 0 else k * 7919 % 10_007 if k % 5 else 3 for k in range(1500)]
    df = spark.createDataFrame([(f"s{k:05d}", n) for k, n in enumerate(sizes)] + [(None, 12)], "source string, source_size long").repartition(7)
    key, old = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")
    try:
        assert mixing.numbered(df, F.col("source").asc_nulls_last()).select("__range").distinct().count() > 2
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    finally:
        spark.conf.set(key, old)
    want = level([*sizes, 12], [1 + k % 3 for k in range(len(sizes) + 1)])  # the null source is last
    assert [got[f"s{k:05d}"] for k in range(len(sizes))] + [got[None]] == pytest.approx(want)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 7}" if i % 3 else "hot") for i in range(3000)] + [(3000, None, None), (3001, "a\tb c\nd", None), (None, "x", "s1")]
    df = docs(spark, rows)
    plan = mixing.mix_plan(df).cache()
    by_source = plan.groupBy("source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("taken"), F.first("__target").alias("target"), F.first("__source_size").alias("size"))
    for r in by_source.where("source IS NOT NULL").collect():
        assert abs(r.taken - r.target) < 5 * math.sqrt(r.size * 50) and r.taken <= 3 * r.size
    assert plan.where("doc_id = 3001").first()["__size"] == 3
    assert plan.where("doc_id = 3000").first()["__size"] == 0
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == plan.agg(F.sum("__copies")).first()[0]
    assert {(r.size, r.target) for r in out.collect()} == {(-1, -1.0)}
    assert out.exceptAll(mixing.mix(df.repartition(5))).count() == 0
    assert mixing.mix(df.where("false")).count() == 0
