"""Spelling variants, url rules and prefix tries against brute force, on small tables with ties, repeats, nulls and crowded groups."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import common, prefix_trie, queries, spelling, url_filters
from millrace.llm.queries import URL_RULES
from tests.duck import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_url_filters", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    assert_same(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)


# --- spelling variants ------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(words):
    out = {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(found), words[form] if form else None]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: tuple(r) for w, r in out.items()}


def got_groups(spark, words, **options):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = spelling.variant_groups(df, **options).collect()
    assert len(rows) == len(words)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_words_of_a_document():
    def plain(ident, text):
        out = Counter()
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{ident}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
        return out

    rng = random.Random(1)
    for ident in range(60):
        text = "".join(rng.choice("abcdeXYZÀÉÿ×÷ßıK中🙂 \n'-_9") for _ in range(rng.randint(0, 900)))
        assert {w.decode("latin-1"): n for w, n in spelling.words_of(str(ident), text).items()} == plain(ident, text)


def test_word_counts_of_odd_rows(spark, monkeypatch):
    rows = [(1, "Straße straße STRAße", 0), (1, "Straße straße STRAße", 0), (None, "garden garden garden", 0), (2, None, 0), (3, "", 0), (4, "four gardens", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int").withColumn("n", F.lit("mine"))
    assert {tuple(r) for r in spelling.word_counts(df).collect()} == {("straße", 6), ("garden", 3)}
    assert spelling.word_counts(df.where("false")).count() == 0
    assert spelling.variant_groups(spelling.word_counts(df.where("false"))).count() == 0
    monkeypatch.setattr(spelling, "HELD", 1)
    assert {tuple(r) for r in spelling.word_counts(df).collect()} == {("straße", 6), ("garden", 3)}


@pytest.mark.parametrize("crowd", [2, 48])
def test_groups_equal_brute_force(spark, crowd):
    rng = random.Random(crowd)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.choice([3, 3, 4, 6, 12, 24, 50]) for _ in range(260)}
    words |= {"z" * k: 3 * k for k in (5, 6, 7, 400, 401)} | {"🙂aaaa": 3, "aaaa🙂": 9}
    assert got_groups(spark, words, crowd=crowd) == groups(words)


def test_a_crowd_that_shares_a_segment(spark):
    """A third of the words begin alike and differ behind: the common segment is split, and no bucket is compared pair by pair."""
    tails = ["".join("abcdefgh"[k // 8**i % 8] for i in range(6)) for k in range(0, 4500, 3)]
    words = {"commonstart" + t: 3 + k % 9 for k, t in enumerate(tails)} | {f"{t}other{k}x": 3 for k, t in enumerate(tails[:300])}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {frozenset((r.a, r.b)) for r in spelling.near_pairs(df).collect()}
    by_cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_cut[i, w[:i] + w[i + 1 :], len(w)].add(w)
    want = {frozenset((a, b)) for group in by_cut.values() for a in group for b in group if a < b}
    want |= {frozenset((w, w[:i] + w[i + 1 :])) for w in words for i in range(len(w)) if w[:i] + w[i + 1 :] in words}
    assert pairs == want and len(want) > 50


def test_chains_of_forms(spark):
    words = {"a" * k + "x" * (20 - k): 3 * 2**k for k in range(15)}
    assert {r[1] for r in got_groups(spark, words).values()} == {"a" * 14 + "x" * 6}


# --- url rules --------------------------------------------------------------------------------


def judged(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = "".join(c.lower() if c.isascii() else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [(len(h), len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def urls(rng, n):
    labels = ["com", "net", "example", "www", "a", "b", "Ex", "", "é"]
    out = [None, "", "no scheme/en/", "http://", "https://COM", "x://example.com?en/", "http://example.com#/en/", "ftp://u@www.example.com/en/x", "http://example.com:80/en/", "http://com/", "http://net/es/", "://net/fr/q#://com/"]
    for _ in range(n):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(0, 5)))
        path = "/" * rng.randint(0, 1) + "/".join(rng.choice(["en", "es", "fr", "e", "", "\n"]) for _ in range(rng.randint(0, 4)))
        out.append(f"http://{host}{path}{rng.choice(['', '?q=/en/', '#x'])}")
    return out


@pytest.mark.parametrize("limit", [0, url_filters.BROADCAST_RULES])
def test_rules_equal_brute_force(spark, limit):
    """Both ways: rules shipped to the tasks, and rules and rows dealt out by ranges."""
    rng = random.Random(limit)
    rules = [*URL_RULES, ("block", "a.com", ""), ("allow", "com", "/e"), ("block", "b.a.com", "/en/es"), ("block", "", "/en"), ("allow", "example.com", "/en/"), ("block", "é", "/")]
    rules += [("block", ".".join(rng.choice(["a", "b", "com", "net"]) for _ in range(rng.randint(1, 3))), "/" + "/".join(rng.choice(["en", "es"]) for _ in range(rng.randint(0, 3)))) for _ in range(40)]
    table = [*urls(rng, 400), "http://a.com/" + "long/" * 30_000]
    pages = spark.createDataFrame([(k % 300 or None, u, "kept") for k, u in enumerate(table)], "page_id long, url string, rule string").repartition(5)
    frame = spark.createDataFrame([*rules, ("block", None, "/"), ("block", "com", "no-slash"), ("allow", "EXAMPLE.com", None)], "verdict string, host string, path string")
    plain = [(v, h, p) for v, h, p in [*rules, ("allow", "example.com", "")]]
    plain = [(max(v for v, *hp in plain if hp == [h, p]), h, p) for h, p in {x[1:] for x in plain}]
    got = url_filters.judge(pages, frame, limit=limit)
    assert got.columns == ["page_id", "url", "rule", "__host", "__path", "__rule", "__verdict"]
    rows = got.collect()
    assert len(rows) == len(table) and {r.rule for r in rows} == {"kept"}
    assert [tuple(r)[3:] for r in rows] == [judged(r.url, plain) for r in rows]
    assert Counter(r.page_id for r in rows) == Counter(k % 300 or None for k in range(len(table)))


@pytest.mark.parametrize("limit", [0, url_filters.BROADCAST_RULES])
def test_no_rules_no_pages(spark, limit):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("block", "com", "/")], "verdict string, host string, path string")
    assert {r["__verdict"] for r in url_filters.judge(pages, rules.where("false"), limit=limit, default="block").collect()} == {"block"}
    assert url_filters.judge(pages.where("false"), rules, limit=limit).count() == 0
    assert [r.page_id for r in url_filters.drop_blocked(pages, rules).collect()] == [2]


def test_sweep_keeps_nested_rules():
    rules = [(k, 0, k) for k in ("a", "ab", "abc", "b")]
    rows = [(k, 1, k) for k in ("a", "abb", "abcd", "abd", "ac", "c")]
    assert {row: [k for k, _ in stack] for row, stack in url_filters.sweep(sorted(rules + rows))} == {"a": ["a"], "abb": ["a", "ab"], "abcd": ["a", "ab", "abc"], "abd": ["a", "ab"], "ac": ["a"], "c": []}


# --- prefix tries -----------------------------------------------------------------------------


def trie(rows, family=100, shared=6):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        convs[c] = (own.get(base, [])[:h]) + mine[h:]
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, who in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(who) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not children[k]
    return Counter(
        (who[0], len(k), members[k[:-1]][0] if k else None, len(who), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in who if len(convs[c]) == len(k)).encode()).hexdigest())
        for k, who in members.items()
    )


def got_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("name", "pos", "key", "copy")}).repartition(7)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.numbered_turns(df))).select(*names).collect())


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "é🙂", "", None])) for c in [*range(0, 40), *range(100, 130), 205, 999, -7, -100, -150] for t in range(rng.randint(1, 9))]
    rows += [(7, 3, "user", "again"), (7, 3, "user", "again"), (7, None, None, "first"), (None, 0, "user", "nobody"), (300, 0, "user", "x" * 50_000)]
    assert got_trie(spark, rows) == trie(rows)


def test_one_long_conversation_and_many_alike(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(200, t, "user", f"turn {t % 7}") for t in range(70)] + [(c, t, "user", "alike") for c in range(400, 460) for t in range(3)]
    assert got_trie(spark, rows) == trie(rows)


def test_no_conversations(spark):
    assert got_trie(spark, []) == Counter()
    assert got_trie(spark, [(None, 1, "user", "x")]) == Counter()
    rows = [(c, 0, None, None) for c in (5, 17)]
    assert got_trie(spark, rows) == trie(rows)


def test_positions_across_ranges(spark):
    rows = [(k % 3 if k % 5 else None, (k * 7919) % 1000) for k in range(2000)]
    df = spark.createDataFrame(rows, "g long, x long").repartition(6)
    got = common.positions(df, "g", [F.col("x").asc()], "place").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.place, r.x))
    for g, found in by.items():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert [x for _, x in sorted(found)] == sorted(x for h, x in rows if h == g)


def test_copies_of_rows_that_share_a_key(spark):
    rows = [(1, 1, "b"), (1, 1, "a"), (1, 2, "c"), (None, 1, "y"), (None, 1, "x"), (2, None, "z")]
    df = spark.createDataFrame(rows, "conv long, turn long, text string")
    assert {tuple(r) for r in common.with_copies(df, ["conv", "turn"], ["text"]).collect()} == {(1, 1, "b", 2), (1, 1, "a", 1), (1, 2, "c", 1), (None, 1, "y", 2), (None, 1, "x", 1), (2, None, "z", 1)}
