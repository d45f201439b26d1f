"""Decontamination: words are split alike in the operator and in its SQL, and the seed filter follows the benchmark's size."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination
from millrace.llm.queries import OP9_SQL
from tests.duck import connect, rows_of

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_symbols_of_all_planes_split_words(spark, tmp_path):
    """The query on odd characters equals its SQL: emoji, letters of compatibility blocks, format characters, capitals that lower-case by context."""
    words = ITEM.split()
    odd = ["🙂", "𝄞", "\U0001f9ff", "豈", "￥", "‍", "­", "﻿", "─", "€", "¼", "́", "٠", "𐤟", "\U000e0041", "ΟΔΟΣ", "ΣΑΣ", "İx", "ß", " ", "—"]
    texts = [None, "", ITEM]
    for mark in odd:
        texts += [f" {mark} ".join(words), mark.join(words), " ".join([words[0], words[1] + mark, *words[2:]]), f"{mark} {mark}{mark} why"]
    items = [(1, ITEM), (2, "ΟΔΟΣ why İx said 豈 and 🙂 then ΣΑΣ"), (3, "豈 豈"), (4, "🙂"), (None, "οδοσ why")]
    items += [(10 + k, f"first {mark} second{mark} third fourth fifth {mark}sixth") for k, mark in enumerate(odd)]
    texts += [t for _, t in items] + [t.lower() for _, t in items] + [t.upper() for _, t in items if "ß" not in t]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": pd.array([k for k, _ in items], "Int64"), "text": [t for _, t in items]}).to_parquet(tmp_path / "benchmark.parquet")
    from millrace.llm.queries import QUERIES

    got, want = rows_of(QUERIES["op9_decontamination"](spark, str(tmp_path)).toPandas()), rows_of(connect(str(tmp_path)).sql(OP9_SQL).df())
    assert got == want
    assert sum("true" in map(str.lower, r) for r in got[1]) > 60


def test_item_ids_of_any_type(spark):
    bench = spark.createDataFrame([("x-1", ITEM), (None, ITEM), ("a", "not here")], "item_id string, text string")
    docs = spark.createDataFrame([("d1", "so " + ITEM), (None, "clean words"), ("d1", None)], "doc_id string, text string")
    got = [(r.doc_id, r["__items"]) for r in decontamination.contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([("d1", ["x-1", None]), (None, []), ("d1", [])], key=str)
    assert decontamination.drop_contaminated(docs, bench).count() == 2


@pytest.mark.parametrize("table_seeds", [40, 1000])
def test_seeds_in_slices_find_the_same(spark, table_seeds):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randint(0, 500)}" for _ in range(n))
    bench = spark.createDataFrame([(k, say(20)) for k in range(30)], "item_id long, text string")
    items = [r.text for r in bench.collect()]
    docs = spark.createDataFrame([(k, say(30) + " " + items[k % 30] * (k % 3 == 0) + " " + say(5)) for k in range(120)], "doc_id long, text string")
    found = lambda **options: {(r.doc_id, tuple(r["__items"]), r["__overlap"]) for r in decontamination.contaminated(docs, bench, **options).collect()} if not options else {
        (r["k1"], tuple(r["items"]), r["overlap"]) for r in decontamination.contaminated_texts(docs, bench, **options).collect()
    }
    assert found(table_seeds=table_seeds) == found(table_seeds=1 << 20)
    assert sum(bool(x[1]) for x in found()) == 40


def test_the_filter_follows_the_number_of_seeds(spark):
    """At most 0.4 % of strange positions pass, whatever the number of seeds; all known ones do."""
    rng = np.random.default_rng(5)
    for n in (3, 100_000):
        known = rng.integers(0, 1 << 64, n, np.uint64)
        df = spark.createDataFrame(pd.DataFrame({"seed": known.view(np.int64)}))
        table = decontamination.SeedFilter(decontamination.bit_table(df, n), (0, 1))
        assert table.size <= max(decontamination.LEAST_BITS, 2 * decontamination.BITS_A_SEED * n)
        assert len(table.passing(known)) == n
        strange = rng.integers(0, 1 << 64, 400_000, np.uint64)
        assert len(table.passing(strange)) < 0.005 * len(strange)


def test_ten_million_seeds_fill_a_table_as_little():
    """The table of ten million seeds, filled here bit by bit as the tasks do, lets under 2 % of strange positions pass."""
    rng, n = np.random.default_rng(6), 10_000_000
    size = decontamination.LEAST_BITS
    while size < decontamination.BITS_A_SEED * n:
        size *= 2
    bits = np.zeros(size, bool)
    known = rng.integers(0, 1 << 64, n, np.uint64)
    for shift in decontamination.shifts(size):
        bits[(known >> np.uint64(shift)) & np.uint64(size - 1)] = True
    table = decontamination.SeedFilter(np.packbits(bits, bitorder="little").tobytes(), (0, 1))
    strange = rng.integers(0, 1 << 64, 1_000_000, np.uint64)
    assert len(table.passing(strange)) < 0.02 * len(strange)
    assert len(table.passing(known[:1000])) == 1000


def test_very_long_and_empty(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "word " * 400_000 + ITEM + " word" * 10), (2, "x" * 3_000_000)], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()] == [2]
    assert decontamination.contaminated(docs.where("false"), bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).agg(F.sum(F.size("__items"))).first()[0] == 0
