import gzip
import hashlib
import io
import json
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, queries, warc


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_is_readable_by_others_and_ranges_are_right(zip64):
    members = [("archive/data.warc.gz", b"abc" * 1000), ("indexes/index.cdxj", b""), ("é.txt", b"x")]
    data = warc.zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    found = warc.zip_directory(io.BytesIO(data))
    assert {n: data[a : a + s] for n, (a, s) in found.items()} == dict(members)


def test_zip_with_comment_and_packed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("stored"), b"s" * 10)
        z.writestr(zipfile.ZipInfo("packed"), b"p" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside" + b"c" * 100
    found = warc.zip_directory(io.BytesIO(out.getvalue()))
    assert set(found) == {"stored"}
    with pytest.raises(ValueError):
        warc.zip_directory(io.BytesIO(b"no archive"))


class Ranges(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        self.read_bytes += len(got)
        return got


def test_one_record_is_read_by_its_range():
    records = [(str(k), warc.record(k, f"http://x/{k}", random.Random(k).randbytes(20_000), hashlib.sha1(random.Random(k).randbytes(20_000)).hexdigest(), 20_000, None)) for k in range(30)]
    f = Ranges(warc.archive(records))
    first = next(warc.read_archive(f))
    assert first[0]["WARC-Record-ID"] == "<urn:page:0>" and len(first[1]) == 20_000
    assert f.read_bytes < 120_000 < len(f.getvalue())


def test_write_and_read_back(spark):
    big, other = "é" * 600, "o" * 999
    rows = [(1, "u1", big), (2, None, big), (3, "a\r\nb", big), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (None, "u", big), (9, "u", "z" * 300_000), (3, "again", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    archives = warc.write_archives(warc.plan_records(df.coalesce(1)), limit=5000)
    assert archives.count() > 1 and archives.agg(F.sum("records")).first()[0] == len(rows)
    assert all(zipfile.is_zipfile(r.path.removeprefix("file:")) for r in archives.collect())
    got = warc.read_archives(archives, payloads=True).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = 3 if html == big and i != 3 else None
        want.append((i, "revisit" if refers else "response", len(data), hashlib.sha1(data).hexdigest(), refers, None if refers else data))
    found = [(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(warc.plan_records(df.where("false")))).count() == 0


def events(spark, rows):
    return spark.createDataFrame(rows, "conv long, msg long, seq long, op string, role string, text string")


def test_fold(spark):
    log = [
        (1, 0, 0, "start", "user", None), (1, 0, 1, "delta", None, "Hel"), (1, 0, 2, "delta", None, "lo"),
        (1, 1, 3, "start", "assistant", None), (1, 1, 4, "delta", None, "bad answer"), (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "good"), (1, 1, 8, "delta", None, None),
        (1, 2, 9, "start", "user", None), (1, 2, 10, "delta", None, "typo"), (1, 2, 11, "edit", None, "fixed"), (1, 2, 12, "delta", None, "!"),
        (1, 3, 13, "start", "user", None), (1, 3, 14, "delete", None, None), (None, 0, 0, "delta", None, "no start"),
    ]
    random.Random(1).shuffle(log)
    got = {(r.conv, r.msg): (r.role, r.text) for r in chat.fold(events(spark, log)).collect()}
    assert got == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "fixed!"), (None, 0): ("", "no start")}
    assert chat.fold(events(spark, log).where("false")).count() == 0
    with pytest.raises(Exception, match="unknown event"):
        chat.fold(events(spark, [(1, 0, 0, "what", None, None)])).collect()


def test_format_is_reversible(spark):
    alphabet = ["<s>", "</s>", "[INST]", "[/INST]", "<<ROLE ", ">>", "<</ROLE>>", "\\", "<", "[", " ", "\n", "é", "😀", "x", "\\<", "\\\\"]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool>> x", "", None]), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) if rng.random() > 0.1 else None) for c in range(40) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv long, msg long, role string, text string").withColumn("copy", F.lit(0))
    segments = chat.render(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for c in range(40):
        mine = [(r or "", x or "") for k, _, r, x in rows if k == c]
        whole = "".join(r.segment for r in sorted(segments.where(F.col("conv") == c).collect(), key=lambda r: r.msg))
        assert list(chat.parse(whole)) == mine
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        loss = "".join(x for r, x in mine if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    with pytest.raises(ValueError):
        list(chat.parse("<s>[INST] a < b [/INST]"))


def test_reader_follows_file_names_and_refuses_compressed_members():
    packs = {f: gzip.compress(warc.record(k, f"u{k}", b"page %d" % k, "00" * 20, 6, None)) for k, f in enumerate(["a.warc.gz", "b.warc.gz"])}
    line = lambda f, named=True: json.dumps({"key": f, "offset": 0, "length": len(packs[f])} | ({"filename": f} if named else {})).encode()
    files = [(f"archive/{f}", data) for f, data in packs.items()]
    got = warc.read_archive(io.BytesIO(warc.zip_stored([*files, ("indexes/index.cdxj", line("b.warc.gz") + b"\n" + line("a.warc.gz"))])))
    assert [p for _, p in got] == [b"page 1", b"page 0"]
    alone = warc.zip_stored([files[1], ("indexes/index.cdxj", line("b.warc.gz", False))])
    assert [p for _, p in warc.read_archive(io.BytesIO(alone))] == [b"page 1"]
    with pytest.raises(ValueError, match="names no archive member"):
        list(warc.read_archive(io.BytesIO(warc.zip_stored([*files, ("indexes/index.cdxj", line("a.warc.gz", False))]))))
    for packed in (files[0][0], "indexes/index.cdxj"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in [*files, ("indexes/index.cdxj", line("b.warc.gz"))]:
                z.writestr(name, data, zipfile.ZIP_DEFLATED if name == packed else zipfile.ZIP_STORED)
        with pytest.raises(ValueError, match="not stored"):
            list(warc.read_archive(out))


def test_a_conversation_of_many_shards_and_of_no_rows(spark, monkeypatch):
    rows = [(7, t, ["user", "assistant"][t % 2], f"text {t} <of> [many]") for t in range(1500)] + [(8, 0, "user", None)] * 3 + [(None, 1, None, "x"), (9, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copy", F.expr("1").cast("int"))
    log = queries.event_log(df.where("conv_id <=> 7 OR conv_id IS NULL OR conv_id = 9"))
    assert {r.op for r in log.collect()} == {"start", "delta", "edit", "regenerate", "delete"}
    got = {(r.conv, r.msg): (r.role, r.text) for r in chat.fold(log.orderBy(F.xxhash64("seq", "text"))).collect()}
    assert got == {(c, t): (r or "", x) for c, t, r, x in rows if c != 8}
    assert chat.read_back(chat.render(chat.fold(queries.event_log(df.where("false"))))).count() == 0


def test_messages_that_share_a_number_through_the_query(spark, tmp_path):
    """Rows that repeat and rows of one conversation and turn are messages of their own, in order of role and text."""
    rows = [(8, 0, "user", None)] * 3 + [(8, 1, "assistant", "b"), (8, 1, "assistant", "a"), (8, 1, None, "z"), (None, None, "user", "x"), (None, None, "user", "x"), (9, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op8_chat_format(spark, str(tmp_path)).collect()}
    order = lambda c: [(r or "", x or "") for _, _, r, x in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))]
    for c in (8, 9, None):
        assert got[c].n_turns == len(order(c))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in order(c)).encode()).hexdigest()
    assert got[8].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and got[-1].n_turns == 2


def test_an_unknown_store_is_refused_before_any_work(spark):
    pages = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.assert_true(F.lit(False)).cast("string").alias("html"))
    with pytest.raises(ValueError, match="dbfs:/x"):
        warc.write_archives(pages, folder="dbfs:/x")


def test_a_very_long_message_is_parsed_in_place():
    text = "a\\<b[ " * 700_000
    escaped = text.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[")
    tracemalloc.start()
    assert list(chat.parse(f" {escaped} </s>")) == [("assistant", text)]
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
