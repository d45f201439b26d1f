import hashlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, packing, queries, similarity_join
from millrace.llm.vocabulary import load_ranks
from tests.llm.test_exact_and_mixing import level
from tests.llm.test_similarity_and_suffixes import brute_join

SF = "/root/testdata/sf0.001"


def brute_mix(rows):
    """Copies of each (doc_id, source, text) by the rule of the mix."""
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(sources, level([sizes[s] for s in sources], [1 + k % 3 for k in range(len(sources))]), strict=True))
    out = Counter()
    for doc_id, source, text in rows:
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"{mixing.SEED}|{doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        out[doc_id, text] += min(3, int(rate) + (draw < rate - int(rate)))
    return +out


def segments(rows, size):
    """Every segment of packed rows, with its document and offset."""
    out = Counter()
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == size and r.cu_seqlens[-1] == r.n_tokens
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert list(pos[a:b]) == list(range(b - a))
            out[d, o, tuple(ids[a:b].tolist())] += 1
    return out


def test_stages_equal_brute_force(spark):
    import tiktoken

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        seen[name] = before, docs
        if name != "packed_tokens":
            assert docs.columns == documents.columns
    before, after = seen["language_id"]
    said = queries.op7_language_id(spark, SF).where("lang_pred <> 'und' AND score >= 0.5")
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in said.collect()} and after.count() > 0.95 * before.count()
    before, after = seen["ngram_jaccard"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {k for k, _, c, _ in brute_join(rows) if k == c}
    assert similarity_join.similar_classes(after).where("n_links > 0").count() == 0
    before, after = seen["decontamination"]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    clean = con.sql(f"SELECT doc_id FROM ({queries.OP9_SQL}) WHERE NOT contaminated").fetchall()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r[0] for r in clean) and after.count() < before.count()
    before, after = seen["mixing"]
    assert Counter((r.doc_id, r.text) for r in after.collect()) == brute_mix([(r.doc_id, r.source, r.text) for r in before.collect()])
    before, after = seen["packed_tokens"]
    plain = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=load_ranks(), special_tokens={})
    want = Counter()
    for r in before.collect():
        ids = plain.encode_ordinary(r.text or "")
        want.update((r.doc_id, o, tuple(ids[o : o + packing.ROW])) for o in range(0, len(ids), packing.ROW))
    assert segments(after.collect(), packing.ROW) == want
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_tokens")).first()[0] == after.agg(F.sum("n_tokens")).first()[0]
