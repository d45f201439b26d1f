"""Continuous ingestion: replayed files give the batch result whatever their order of arrival, and state goes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest
from millrace.plans.views import RAW_LINES, view
from millrace.streaming.ingest import PROVIDER, ROCKSDB, first_wins, stream_records

SF = "/root/testdata/sf0.001"
START = 1_700_000_000


@pytest.fixture
def stateful(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    yield spark
    spark.conf.set(PROVIDER, old)


def put(path, lines, arrived):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (arrived, arrived))


def drain(query_of, checkpoint):
    """Rows given out until all files there are were read, and rows of state after each batch."""
    out = []
    query = query_of.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, [o.numRowsTotal for p in query.recentProgress for o in p.stateOperators]


@pytest.mark.parametrize("seed", [1])
def test_shuffled_files_give_the_batch_result(stateful, tmp_path, seed):
    """Lines of posts and comments in files that arrive in any order, several micro-batches; ids repeat across files and kinds."""
    spark, rng = stateful, random.Random(seed)
    lines = [(r.src, r.line) for r in view(spark, SF, RAW_LINES).orderBy("src", "ord").collect()]
    posts, comments = ([x for s, x in lines if s == src] for src in (0, 1))
    posts += [json.dumps({"id": f"p{k % 5}", "title": f"title {k}"}) for k in range(40)]
    comments += [json.dumps({"id": f"p{k % 9}", "body": f"body {k}"}) for k in range(40)]
    for name, rows in (("posts", posts), ("comments", comments)):
        rng.shuffle(rows)
        for k in range(0, len(rows), 17):
            put(tmp_path / name / f"part-{k:04}.jsonl", rows[k : k + 17], START + rng.randint(0, 3000))
    batch = ingest.distinct_records(ingest.read_records(spark, str(tmp_path / "posts"), str(tmp_path / "comments"))).drop("malformed", "block", "ord")
    want = sorted(tuple(r) for r in batch.collect())
    got, states = [], []
    for hours, name in ((2, "flush"), (5, "forget"), (9, "end")):  # three runs of one query: each goes on where the one before stopped
        put(tmp_path / "posts" / f"zz-{name}.jsonl", [json.dumps({"id": f"zz-{name}", "title": name})], START + hours * 3600)
        more, sizes = drain(stream_records(spark, str(tmp_path / "posts"), str(tmp_path / "comments"), files_at_once=2), tmp_path / "state")
        got, states = got + more, states + sizes
    names = batch.columns
    rows = sorted(tuple(r[c] for c in names) for r in got if not r.id.startswith("zz-"))
    assert rows == want and len(rows) > 20
    # the last files lie beyond delay and memory of all others, so what is left in state is theirs
    assert max(states) > len(want) and states[-1] <= 3


def test_late_copies_are_dropped_while_an_id_is_remembered(stateful, tmp_path):
    spark = stateful
    row = lambda title: [json.dumps({"id": "p1", "title": title})]
    put(tmp_path / "posts" / "b.jsonl", row("second by name"), START)
    put(tmp_path / "posts" / "a.jsonl", [*row("first by name"), "{bad"], START + 1800)
    put(tmp_path / "posts" / "c.jsonl", ['{"id": "p2", "title": "other"}'], START + 3600 + 900)
    put(tmp_path / "posts" / "d.jsonl", row("copy, still remembered"), START + 3600 + 1800)
    put(tmp_path / "posts" / "e.jsonl", ['{"id": "p3", "title": "far"}'], START + 5 * 3600)
    put(tmp_path / "posts" / "f.jsonl", row("forgotten, new again"), START + 5 * 3600 + 60)
    put(tmp_path / "posts" / "g.jsonl", ['{"id": "p4", "title": "end"}'], START + 9 * 3600)
    (tmp_path / "comments").mkdir()
    got, _ = drain(stream_records(spark, str(tmp_path / "posts"), str(tmp_path / "comments"), files_at_once=1), tmp_path / "state")
    assert sorted((r.id, r.title) for r in got) == [("p1", "first by name"), ("p1", "forgotten, new again"), ("p2", "other"), ("p3", "far")]


def test_a_post_wins_over_a_comment_that_came_before(stateful, tmp_path):
    spark = stateful
    put(tmp_path / "comments" / "a.jsonl", ['{"id": "x", "body": "comment"}'], START)
    put(tmp_path / "posts" / "b.jsonl", ['{"id": "x", "title": "post"}'], START + 600)
    put(tmp_path / "posts" / "z.jsonl", ['{"id": "end"}'], START + 8000)
    got, _ = drain(stream_records(spark, str(tmp_path / "posts"), str(tmp_path / "comments"), files_at_once=1), tmp_path / "state")
    assert [(r.src, r.title, r.body) for r in got] == [(0, "post", "")]


def test_another_state_store_is_refused(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="RocksDB"):
        first_wins(spark.range(1).withColumn("arrived", F.current_timestamp()))
    spark.conf.set(PROVIDER, old)
