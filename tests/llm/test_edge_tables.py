"""Tables of nothing but nulls, and very long texts, through every operator on documents."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, exact_dedup, language_id, mixing, packing, similarity_join, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, __extra string"


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)


@pytest.fixture(scope="module")
def long_texts(spark):
    body = "many different words follow one another in this text " * 20_000
    rows = [(1, body, "en", "s", "x"), (2, body + "end", "en", "s", "x"), (3, "w" * 300_000, "en", "s", "x"), (4, "der die das und nicht", "de", "s", "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_nulls(spark, nulls):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert exact_dedup.exact_duplicates(nulls).where("__kept").count() == 3
    assert mixing.mix(nulls).count() == 0
    assert language_id.accepted(nulls, language_id.fit(nulls)).count() == 0
    assert {tuple(r) for r in token_counts.count_tokens(nulls, keep=["doc_id"]).collect()} == {(None, 0, 0)}
    assert packing.pack_documents(nulls).count() == 0
    assert {tuple(r) for r in similarity_join.similar_classes(nulls).collect()} == {(None, 0, None, 0)}
    assert {r["__n_bytes"] for r in suffix_dedup.remove_repeats(nulls).collect()} == {0}
    assert decontamination.drop_contaminated(nulls, bench).count() == 3
    assert decontamination.contaminated(nulls, bench.limit(0)).columns[:5] == nulls.columns


def test_names_that_clash(spark):
    """Columns named as an output are replaced, all others pass through, whatever an operator calls its own."""
    text = "many different words follow one another in this text and this one repeats, " * 4
    taken = ["key", "n", "c0", "c1", "made", "k1", "k2", "part", "body", "full", "root", "token", "__k1", "__m1", "__again", "__source", "seed", "fp"]
    rows = [(k, text if k < 3 else f"alone {k}", "en", "s") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"my {c}") for c in taken})
    clash = df.withColumns({c: F.lit(0) for c in ("__items", "__overlap", "__lang", "__score", "__tokens", "__pretokens", "__keep_id", "__kept", "__spans", "__n_bytes")})
    bench = spark.createDataFrame([(1, "no such words here")], "item_id long, text string")
    for out in (
        exact_dedup.exact_duplicates(clash), language_id.identify(clash, language_id.fit(clash)), token_counts.count_tokens(clash), decontamination.contaminated(clash, bench), suffix_dedup.remove_repeats(clash),
    ):
        assert len(set(out.columns)) == len(out.columns) and set(taken) <= set(out.columns)
        found = out.collect()
        assert len(found) == 6 and all(r[c] == f"my {c}" for r in found for c in taken)
    kept = {
        "drop_exact": (exact_dedup.drop_exact(clash), 4), "accepted": (language_id.accepted(clash, language_id.fit(clash)), 6), "clean": (decontamination.drop_contaminated(clash, bench), 6),
        "one": (similarity_join.one_of_each(clash), 4), "mix": (mixing.mix(clash), None),
    }
    for out, n in kept.values():
        assert out.columns == clash.columns and (n is None or out.count() == n)
    assert similarity_join.similar_classes(clash).count() == 6 and packing.pack_documents(clash).count() > 0


def test_long_texts(spark, long_texts):
    bench = spark.createDataFrame([(1, "different words follow one another in this text many different words follow one")], "item_id long, text string")
    assert exact_dedup.drop_exact(long_texts).count() == 4
    assert language_id.accepted(long_texts, language_id.fit(long_texts)).count() == 4
    assert token_counts.count_tokens(long_texts).where("__tokens >= __pretokens").count() == 4
    assert packing.pack_documents(long_texts).agg(F.sum("n_tokens")).first()[0] > 300_000
    got = {r.doc_id: tuple(r)[1:] for r in similarity_join.similar_classes(long_texts).collect()}
    assert (got[1][1], got[2][1], got[3]) == (1, 1, (1, 3, 0))
    removed = {r.doc_id: r["__n_removed"] for r in suffix_dedup.remove_repeats(long_texts).collect()}
    assert removed[3] == 300_000 and removed[4] == 0 and removed[1] > 1_000_000
    assert {r.doc_id for r in decontamination.drop_contaminated(long_texts, bench).collect()} == {3, 4}
