"""Every registered query with SQL agrees with it, and the derived inputs exercise each rule."""

import pytest

from millrace.plans.oracles import ORACLES
from millrace.plans.queries import QUERIES
from millrace.plans.views import BASE_RECORDS, COMPLETIONS, DECISIONS, ODD_LINES, view

from .duck import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], ORACLES[name], SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_plug_in(spark):
    rows = QUERIES["scored_by_plugin"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {r.curation_passed for r in rows} == {True, False}


def test_inputs_are_not_vacuous(spark):
    reasons = {r.reason: r.n for r in QUERIES["reject_reasons"](spark, SF).collect()}
    assert set(reasons) == {"kept", "pre_min_date", "bot", "negative_score", "invalid_body"}
    report = QUERIES["thread_report"](spark, SF).first()
    assert report.standalone_posts and report.threads_with_comments
    assert {r.reward for r in QUERIES["reward_format"](spark, SF).collect()} == {1.0, 0.8, 0.5, 0.0, -0.5, -1.0}
    assert len({r.reward for r in QUERIES["reward_concepts"](spark, SF).collect()}) > 5
    assert len({r.recall for r in QUERIES["concept_coverage"](spark, SF).collect()}) > 2
    assert {r.promo for r in QUERIES["promo_filter"](spark, SF).collect()} == {True, False}
    bad = {r.src: (r.malformed, r.well_formed) for r in QUERIES["ingest_malformed"](spark, SF).collect()}
    assert all(min(x) > 0 for x in bad.values()) and len(bad) == 2
    faults = QUERIES["benchmark_faults"](spark, SF).first()
    assert faults.short_reasoning and faults.blank_rubrics and not faults.missing_categories
    found = {r.split: r.leaks for r in QUERIES["benchmark_leaks"](spark, SF).collect()}
    assert set(found) == {"train", "val", "test"} and sum(found.values()) > 10
    strict = QUERIES["ingest_strict"](spark, SF).collect()
    assert len({r.k % 12 for r in view(spark, SF, ODD_LINES).collect()}) == 12 and {r.malformed for r in strict} == {True, False} and {7, -3, 5, 1, 0} <= {r.score for r in strict}
    assert {r.found_in for r in QUERIES["stage_curate"](spark, SF).collect()} == {"passed", "rejected"}
    assert QUERIES["stage_ingest"](spark, SF).first().duplicate_ids >= 0
    dup = QUERIES["ingest_dedup_first"](spark, SF).count()
    assert dup == view(spark, SF, BASE_RECORDS).count()
    assert view(spark, SF, COMPLETIONS).count() == view(spark, SF, DECISIONS).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "thread_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
