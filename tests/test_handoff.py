"""The trainer's side: shards by row number, rewards without a job, stores by URI."""

import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import kernels, rewards
from millrace.operators import training
from millrace.plans.views import COMPLETIONS, DECISIONS, view
from millrace.sources import handoff

SF = "/root/testdata/sf0.001"


def test_prompts_by_row_number(spark, tmp_path):
    rows = view(spark, SF, DECISIONS).withColumn("taxonomy_topic", F.col("choice"))
    prompts = training.prompts(rows).orderBy("thread_id").repartitionByRange(5, "thread_id").sortWithinPartitions("thread_id")
    manifest = handoff.write_shards(prompts, f"file:{tmp_path}/shards", shard_rows=17, batch_rows=5)
    want = [r.asDict(recursive=True) for r in prompts.collect()]
    assert manifest["rows"] == len(want) > 100 and max(f["rows"] for f in manifest["files"]) == 17
    data = handoff.Shards(str(tmp_path / "shards"))
    assert len(data) == len(want) and list(data) == want and data.column_names == prompts.columns
    assert data[0] == want[0] and data[-1] == want[-1] and data[100]["prompt"][0]["role"] == "system"
    few = data.select(range(min(50, len(data))))
    assert list(few) == want[:50] and list(few.select([3, 1, 1])) == [want[3], want[1], want[1]] and list(few.select(range(10, 50, 20))) == [want[10], want[30]]
    assert [len(b) for b in data.select(range(23)).batches(10)] == [10, 10, 3]
    with pytest.raises(IndexError):
        few[50]
    assert list(pickle.loads(pickle.dumps(few))) == want[:50]
    empty = handoff.write_shards(prompts.where("false"), str(tmp_path / "none"))
    assert empty["rows"] == 0 and list(handoff.Shards(str(tmp_path / "none"))) == []


def test_what_a_lost_task_left_is_read_by_nobody(spark, tmp_path):
    handoff.write_shards(spark.range(10).coalesce(1), str(tmp_path / "s"))
    (tmp_path / "s" / "000000-000000-lost.arrow").write_bytes(b"half")
    assert [r["id"] for r in handoff.Shards(str(tmp_path / "s"))] == list(range(10))


def test_kernels_agree_with_columns(spark):
    """All completions of a table: the same rewards from arrays in this process as from columns on the cluster."""
    df = view(spark, SF, COMPLETIONS).select("id", "text", "topic", "reference")
    columns = rewards.all_rewards(F.col("text"), F.col("topic"), F.col("reference"), digits=None)
    scored = df.select("*", *(c.alias(k) for k, c in columns.items())).collect()
    said, topics, answers = ([r[k] for r in scored] for k in ("text", "topic", "reference"))
    for reward in kernels.callables(digits=None):
        got = reward(pa.array(said), taxonomy_topic=topics, reference_answer=pa.array(answers))
        assert got == pytest.approx([r[reward.__name__] for r in scored], abs=1e-12)
        assert len(set(got)) > 3
    short = rewards.repetition_reward(F.col("text"), max_chars=None, min_chars=30, digits=None)
    assert [kernels.repetition_score(t, None, 30, None) for t in said] == pytest.approx([r.s for r in df.select(short.alias("s")).collect()])
    other = rewards.format_reward(F.col("text"), min_answer=None, other=0.4)
    assert [kernels.format_score(t, min_answer=None, other=0.4) for t in said] == [r.s for r in df.select(other.alias("s")).collect()]


def test_a_batch_is_scored_without_a_job(spark):
    rows = view(spark, SF, COMPLETIONS).limit(64).collect()
    batch = pa.RecordBatch.from_pydict({"completion": [r.text for r in rows], "taxonomy_topic": [r.topic for r in rows], "reference_answer": [r.reference for r in rows]})
    tracker = spark.sparkContext._jsc.sc().statusStore()
    jobs = tracker.jobsList(None).size()
    scored = kernels.score_batch(batch)
    assert tracker.jobsList(None).size() == jobs
    assert scored.num_rows == 64 and scored.column_names[-4:] == ["reward_format", "reward_concepts", "reward_grounding", "reward_repetition"]
    assert kernels.callables()[1](["bm25"] * 3, taxonomy_topic=["retrieval"]) == [0.4, 0.2, 0.2]


@pytest.mark.parametrize(("uri", "want"), [("s3a://b/x", "s3://b/x"), ("s3n://b/x", "s3://b/x"), ("hdfs://n:8020/x", "hdfs://n:8020/x"), ("abfss://c@a/x", "abfss://c@a/x"), ("file:/x/y", "file:///x/y"), ("file:///x/y", "file:///x/y"), ("/x/y:z", "/x/y:z")])
def test_uris_of_spark_as_arrow_knows_them(uri, want):
    assert handoff.arrow_uri(uri) == want


def test_unknown_stores_are_refused():
    with pytest.raises(ValueError, match="dbfs:/x"):
        handoff.opened("dbfs:/x")
