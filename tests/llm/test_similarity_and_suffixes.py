import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, similarity_join, suffix_dedup

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(docs):
    """key -> (set size, smallest linked key, links), rows told apart by position."""
    sets = [shingles(t) for _, t in docs]
    up, links = list(range(len(docs))), [0] * len(docs)

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    members = defaultdict(list)
    for i, (k, _) in enumerate(docs):
        members[root(i)].append(k)
    low = {r: min((k for k in ks if k is not None), default=None) for r, ks in members.items()}
    return sorted(((k, len(sets[i]), low[root(i)] if sets[i] else k, links[i]) for i, (k, _) in enumerate(docs)), key=str)


def copies(rng):
    vocabulary = [f"w{k}" for k in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, out = say(60), []
    for _ in range(12):
        base = say(rng.choice([3, 8, 30, 120, 400]))
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 12])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    out += [" ".join(say(rng.randint(5, 40)) + passage + say(rng.randint(0, 20))) for _ in range(25)]
    out += [None, "", "  \n ", "one two", "One  TWO", "É a b c d e", "é a b c d e", " ".join(["same"] * 5000), " ".join(["same"] * 40)]
    return out


@pytest.mark.parametrize(("bucket", "sketch"), [(similarity_join.BUCKET, similarity_join.SKETCH), (3, similarity_join.SKETCH), (3, None)])
def test_join_equals_brute_force(spark, monkeypatch, bucket, sketch):
    monkeypatch.setattr(similarity_join, "BUCKET", bucket)
    monkeypatch.setattr(similarity_join, "GROUP", min(bucket, similarity_join.GROUP))
    rng = random.Random(11)
    texts = copies(rng)
    docs = [(k * 3, t) for k, t in enumerate(texts)] + [(1, texts[0]), (None, texts[1]), (4, texts[2]), (4, texts[2])]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(0))
    got = similarity_join.similar_classes(df, sketch=sketch)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_join(docs)


def test_one_of_each(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (3, "A b c d e f"), (7, "other words stand in this text"), (8, ""), (9, None), (3, "A b c d e f")], "doc_id long, text string")
    df = df.withColumn("count", F.lit(1)).withColumn("key", F.lit("mine"))
    out = similarity_join.one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [3, 7, 8, 9]
    assert similarity_join.similar_classes(df.where("false")).count() == 0


def test_one_of_each_with_null_and_repeated_ids(spark):
    say = lambda k, n=40: " ".join(f"{k}w{i}" for i in range(n))
    near = lambda k: say(k) + " end"
    groups = [
        [(None, say("a"))],
        [(None, say("b"))],
        [(None, say("c")), (None, near("c")), (None, say("c"))],
        [(None, say("d")), (2, near("d"))],
        [(1, say("e")), (1, near("e")), (3, say("e"))],
        [(1, say("f"))],
        [(1, say("g")), (1, say("g"))],
        [(5, say("h")), (4, near("h"))],
        [(4, say("i"))],
        *([(k, t)] for k, t in [(None, None), (None, ""), (None, ""), (6, " "), (6, None)]),
    ]
    rows = [r for g in groups for r in g]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("mine")).repartition(3)
    out = similarity_join.one_of_each(df)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == df.columns and sum(got.values()) == len(groups)
    for g in groups:
        low = min((k for k, _ in g if k is not None), default=None)
        if (g[0][1] or "").strip():
            assert sum(got[r] for r in set(g) if r[0] == low) == 1 and not any(got[r] for r in g if r[0] != low)
        else:
            assert got[g[0]] == rows.count(g[0])


def test_rtree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, (40, similarity_join.GROUPS))
    points = np.concatenate([base, np.clip(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0, None), rng.integers(0, 6, (200, similarity_join.GROUPS))]).astype(np.int32)
    sizes = points.sum(axis=1)
    tree = similarity_join.RTree(points, sizes)
    got = {tuple(sorted((int(tree.leaves[k][x]), int(tree.leaves[m][y])))) for k, m in tree.leaf_pairs() for x, y in np.argwhere(tree.fits(k, m))}
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if 9 * np.minimum(points[i], points[j]).sum() >= 4 * (sizes[i] + sizes[j])}
    assert got == want and want


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)]
    got = {r.u: r.v for r in similarity_join.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    up = {n: n for e in edges for n in e}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {n: root(n) for n in up if root(n) != n}


def test_index_equals_counting():
    rng = random.Random(3)
    for _ in range(200):
        length, alphabet = rng.choice([3, 5, 8]), rng.choice(["ab", "abc", "abcdefgh"])
        strings = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length, 40))).encode() for _ in range(rng.randint(1, 8))]
        counts = [rng.choice([1, 1, 1, 2]) for _ in strings]
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        got = suffix_dedup.repeated_windows(strings, counts, length)
        for s, n, g in zip(strings, counts, got, strict=True):
            assert [n > 1 or seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] == list(g)


def brute_repeats(docs, length=suffix_dedup.MIN_LENGTH):
    data = [(k, (t or "").encode()) for k, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    passages = [say(n) for n in (150, 195, 199, 200, 201, 260, 700)]
    texts = [say(rng.randint(0, 300)) + (rng.choice(passages) if rng.random() < 0.8 else "") + say(rng.randint(0, 200)) + rng.choice(["", rng.choice(passages)]) for _ in range(70)]
    texts += ["ab" * 300, "x" * 450, "y" * 199, "z" * 200, None, "", texts[0], texts[0], passages[6] + passages[6]]
    near = list(say(900))
    for _ in range(5):
        near[rng.randrange(900)] = "#"
        texts.append("".join(near))
    docs = list(enumerate(texts)) + [(None, texts[3]), (0, texts[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("place", F.lit(1))
    out = suffix_dedup.remove_repeats(df).cache()
    shown = out.select("doc_id", "__n_bytes", "__n_removed", F.size("__spans").alias("n"), "__kept_sha256")
    assert sorted((tuple(r) for r in shown.collect()), key=str) == brute_repeats(docs)
    assert all(hashlib.sha256(bytes(r["__kept"])).hexdigest() == r["__kept_sha256"] for r in out.collect())
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


@pytest.mark.parametrize("bound", [suffix_dedup.PLACES, 0])
def test_only_what_repeats_is_moved(spark, monkeypatch, bound):
    """Occurrences of anchors that do not recur stay in their task, and each context is cut once, however often it occurs; with bounds of 0 nothing is broadcast."""
    rows = {}

    def written(df, name="step", **more):
        out = materialize(df, name, **more)
        rows[name] = [tuple(r) for r in out.collect()] if name in ("occurrences", "contexts") else []
        return out

    materialize = suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", written)
    monkeypatch.setattr(suffix_dedup, "PLACES", bound)
    monkeypatch.setattr(suffix_dedup, "KEYS", bound, raising=False)
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    line = say(400)
    docs = list(enumerate([say(300) + line + say(300) for _ in range(12)] + [say(900) for _ in range(40)] + [say(300) + line] * 6))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    out = suffix_dedup.remove_repeats(df, payload=False)
    assert sorted((tuple(r) for r in out.select("doc_id", "__n_bytes", "__n_removed", F.size("__spans"), "__kept_sha256").collect()), key=str) == brute_repeats(docs)
    found = [r[:2] for r in rows["contexts"]]
    assert len(found) == len(set(found))
    every = sum(len(x[0]) for x in suffix_dedup.occurrences([t.encode() for _, t in docs]))
    assert 0 < len(rows["occurrences"]) < every / 2
    assert len(found) < len(rows["occurrences"])


def test_sieve_loses_no_key(spark):
    keys = [k * 7919 - (1 << 62) for k in range(5000)]
    table = common.sieve(spark.createDataFrame([(k,) for k in keys], "k long"), len(keys)).value
    assert common.sieved(pa.array(keys), table).all()
    assert common.sieved(pa.array([k + 1 for k in keys]), table).mean() < 1 / 8 + 0.02


def test_anchors_do_not_depend_on_what_stands_around():
    rng = random.Random(1)
    window = rng.randbytes(200)
    seen = set()
    for _ in range(20):
        left = rng.randrange(50)
        items = [rng.randbytes(left) + window + rng.randbytes(rng.randrange(50))]
        for _, fp, start, more, offset in suffix_dedup.occurrences(items):
            for f, s, m, o in zip(fp, start, more, offset, strict=True):
                if s <= left <= s + m:
                    seen.add((int(f), int(s + o - left)))
    assert len(seen) == 1


def test_words_that_fooled_a_polynomial_hash_are_not_linked(spark):
    # two words of 1,024 letters whose polynomial hashes modulo 2^64 are equal for every odd base
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    got = similarity_join.similar_classes(spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1, 0), (2, 1, 2, 0)}


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for n in range(1, 200):
        whole = np.sort(rng.choice(1 << 40, n, replace=False).astype(np.uint64))
        low, high = whole[: n - n // 5], whole[n // 5 :]  # nothing in common but the middle, at the ends of the order
        for a, b in ((whole, low), (whole, high)):
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                assert len(np.intersect1d(similarity_join.prefix(a, None), similarity_join.prefix(b, None)))
