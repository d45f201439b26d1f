import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest
from millrace.sources import files


@pytest.fixture
def forum(tmp_path):
    posts = [
        {"id": "p1", "title": " Chunk size? ", "selftext": "Which chunk size works best?", "author": "ann", "created_utc": 1704067200, "score": 12, "subreddit": " RAG "},
        {"data": {"id": "p2", "title": "Deleted", "body": "[deleted]", "author": None, "created_utc": "1704067200.25", "score": "3"}},
        {"id": "p1", "title": "again", "score": 99},
        {"id": "", "title": "no id"},
        {"id": "p3", "title": "", "selftext": "", "author": "   ", "created_utc": 0, "created": 1704067201, "score": 3.7},
        {"id": 7, "title": "number id", "score": "3.7", "created_utc": 1},
    ]
    comments = [
        {"id": "c1", "parent_id": "t3_p1", "link_id": "t3_p1", "body": " 512 tokens ", "author": "bob", "created_utc": 1704067300, "score": 5},
        {"id": "p1", "parent_id": "t1_x", "link_id": "", "body": "shares an id with a post"},
        {"id": "c2", "parent_id": "t1_c1", "body": "un-linked", "score": True},
        {"id": "c3", "parent_id": "t3_p2", "link_id": "p9", "body": ""},
    ]
    lines = [json.dumps(p) for p in posts]
    (tmp_path / "posts.jsonl").write_bytes("\n".join([*lines[:2], "{bad", "", "  ", "[1]", '"data"', "null", '{"id": "x"} trailing', *lines[2:]]).encode() + b'\n{"id": "bytes", "title": "\xff!"}\n')
    (tmp_path / "comments.jsonl").write_text("\n".join(map(json.dumps, comments)))
    return tmp_path


def test_read_records(spark, forum):
    lines = ingest.read_records(spark, str(forum / "posts.jsonl"), str(forum / "comments.jsonl")).cache()
    assert lines.where("malformed").count() == 6
    rows = {r.id: r for r in ingest.distinct_records(lines).collect()}
    assert set(rows) == {"p1", "p2", "p3", "7", "bytes", "c1", "c2", "c3"}
    p1 = rows["p1"]
    assert (p1.title, p1.body, p1.community, p1.score, p1.parent_id, p1.post_id) == ("Chunk size?", "Which chunk size works best?", "rag", 12, "", "p1")
    assert p1.created_at == "2024-01-01T00:00:00+00:00"
    assert (rows["p2"].author, rows["p2"].created_at, rows["p2"].score) == ("[deleted]", "2024-01-01T00:00:00.250000+00:00", 3)
    assert (rows["p3"].author, rows["p3"].created_at, rows["p3"].score) == ("", "2024-01-01T00:00:01+00:00", 3)
    assert (rows["7"].score, rows["7"].created_at) == (0, "")
    assert rows["bytes"].title == "�!"
    assert [rows[k].post_id for k in ("c1", "c2", "c3")] == ["p1", "t1_c1", "p2"]
    assert (rows["c1"].body, rows["c2"].score) == ("512 tokens", 1)


def test_health(spark, forum):
    found = ingest.health(ingest.distinct_records(ingest.read_records(spark, str(forum / "posts.jsonl"), str(forum / "comments.jsonl")))).first()
    assert (found.total_records, found.posts, found.comments, found.deleted, found.empty_posts, found.empty_comments) == (8, 5, 3, 5, 1, 1)
    assert (found.min_date, found.max_date) == ("2024-01-01T00:00:00+00:00", "2024-01-01T00:01:40+00:00")


def test_missing_files(spark, tmp_path):
    assert files.read_json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "export").mkdir()
    (tmp_path / "export" / "a.jsonl").write_text("{}")
    assert files.resolve_path(spark, f"{tmp_path}/a.jsonl") == f"{tmp_path}/export/a.jsonl"


def test_time_does_not_depend_on_the_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = spark.range(1).select(ingest.iso_time(F.lit(1710054000.5).cast("double")).alias("t")).first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == "2024-03-10T07:00:00.500000+00:00"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v long")
    files.write_table(df, f"{tmp_path}/t", split_by="k")
    assert files.read_table(spark, f"{tmp_path}/t").count() == 2
    files.write_json_lines(df, f"{tmp_path}/j")
    assert '{"k":"b","v":null}' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert files.size_bytes(spark, f"{tmp_path}/t") > 0 and files.size_bytes(spark, f"{tmp_path}/none") == 0
    assert files.write_report({"n": 1}, f"{tmp_path}/r/report.json")["n"] == 1
    assert files.counts_map(df, "k", f"{tmp_path}/counts") == {"a": 1, "b": 1}


def test_strict_lines_follow_pythons_reader(spark, tmp_path):
    """Each line on which the two readers differ, and that the default keeps to its documented rules."""
    cases = [
        ('{"id": "a1", "score": 1} trailing', None, None), ('{"id": "x", "id": "a2"}', ("a2", 0), None), ('{"id": "a3", "score": NaN}', ("a3", 0), None), ('{"id": 7.0}', ("7.0", 0), ("7", 0)),
        ('{"id": "a4", "score": 12345678901234567890}', ("a4", 0), ("a4", 0)), ('{"id": "a5", "score": " 5 "}', ("a5", 5), ("a5", 5)), ('{"id": "a6", "score": -3.7}', ("a6", -3), ("a6", -3)),
        ('{"id": "a7", "score": [1]}', ("a7", 0), ("a7", 0)), ('{"id": "a8", "score": Infinity}', ("a8", 0), None), ("[1]", None, None), ('"data"', None, None), ("null", None, None), ("{bad", None, None),
        ('{"id": "a9", "title": [1, "b"], "score": "1_0"}', ("a9", 10), ("a9", 0)), ("[" * 100_000, None, None),
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(x for x, *_ in cases))
    for strict in (True, False):
        rows = ingest.read_records(spark, f"{tmp_path}/p.jsonl", f"{tmp_path}/none", strict=strict).collect()
        want = [c[1] if strict else c[2] for c in cases]
        found = [None if r.malformed else (r.id, r.score) for r in sorted(rows, key=lambda r: r.ord)]
        assert found == want
    assert [r.title for r in ingest.read_records(spark, f"{tmp_path}/p.jsonl", f"{tmp_path}/none", strict=True).where("id = 'a9'").collect()] == ["[1, 'b']"]


def test_strict_and_default_agree_on_plain_lines(spark, forum):
    read = lambda strict: sorted(tuple(r) for r in ingest.distinct_records(ingest.read_records(spark, str(forum / "posts.jsonl"), str(forum / "comments.jsonl"), strict=strict)).collect())
    assert read(True) == read(False)
