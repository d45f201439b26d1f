import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, language_id, packing, queries, token_counts
from millrace.llm.vocabulary import WORD_MARK, load_pieces, load_ranks

SF = "/root/testdata/sf0.001"
ODD = ["", "   ", None, " a b", "a  b c ", "日本語 テキスト😀", "x" * 500 + " y", "a\nb \n c\t\td", "\0a b", "é   b", "the cat\0x the cat\0y", "1234 !!!"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ODD


@pytest.fixture(scope="module")
def pieces():
    return load_pieces()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__x", F.lit("kept"))


def test_language_scores_sum_all_segmentations():
    pieces = [WORD_MARK, WORD_MARK + "a", "a", "ab", "b", "abc", "c"]
    table = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.05], [0.1, 0.25], [0.2, 0.1], [0.1, 0.2], [0, 0]])
    model = language_id.Model(pieces, ["x", "y"], table)
    model.predict(["a"])
    index = {p: i for i, p in enumerate(pieces)}

    def total(word, lang):
        if not word:
            return 1.0
        out = language_id.UNKNOWN * total(word[1:], lang)
        for k in range(1, len(word) + 1):
            if word[:k] in index:
                out += table[index[word[:k]], lang] * total(word[k:], lang)
        return out

    for w in ("a", "abc", "abca", "zab", "cabbacab", "abc" * 30, "é" * 200):
        got = model.word_scores([w])[0]
        if len(w) <= 12:
            assert got == pytest.approx([math.log(total(WORD_MARK + w, k)) for k in range(2)])
        assert np.isfinite(got).all()
    assert model.predict([None, "", " ", "123 !", "abc"])[0][:4] == ["und"] * 4
    assert language_id.Model(pieces, [], table[:, :0]).predict(["abc"]) == (["und"], [0.0])


def test_long_runs_of_rare_characters_have_finite_scores(pieces):
    rng = np.random.default_rng(8)
    table = np.append(rng.random((len(pieces), 2)) * 1e-6 + 1e-7, np.zeros((1, 2)), axis=0)
    model = language_id.Model(pieces, ["x", "y"], table)
    model.predict(["a"])
    ids, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))

    def log_total(word, lang):
        word, logs = WORD_MARK + word, [0.0]
        for i in range(1, len(word) + 1):
            ways = [logs[i - 1] + math.log(language_id.UNKNOWN)]
            ways += [logs[j] + math.log(table[ids[word[j:i]], lang]) for j in range(max(0, i - longest), i) if word[j:i] in ids]
            logs.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
        return logs[-1]

    unseen = "".join(p for p in pieces if len(p) == 1 and p != WORD_MARK)[-400:]
    unknown = "\U00013000" * 300
    assert unknown[0] not in ids and len(unseen) == 400
    for word in (unknown, unseen, "the" + unknown + "end", "international" * 12 + unknown, unseen[:39], unseen[:40], unseen[:80]):
        got = model.word_scores([word])[0]
        assert got == pytest.approx([log_total(word, k) for k in range(2)], rel=1e-9)
    names, scores = model.predict(["the house " + unknown, unseen])
    assert np.isfinite(scores).all() and "und" not in names


def test_fitting_raises_the_likelihood(pieces):
    index = language_id.PieceIndex(pieces)
    words, weights = ["the", "then", "thou", "other"], np.array([5.0, 2.0, 1.0, 3.0])
    fit = lambda rounds: language_id.Model(pieces, ["x"], language_id.fit_language(words, weights, index, rounds)[:, None])
    score = []
    for rounds in (1, 2, 4):
        model = fit(rounds)
        model.predict(["a"])
        score.append(float(weights @ model.word_scores(words)[:, 0]))
    assert score[0] < score[1] <= score[2]


def test_fit_reads_words_of_any_length(pieces):
    index, rng = language_id.PieceIndex(pieces), random.Random(6)
    single = [p for p in pieces if len(p) == 1 and p != WORD_MARK]
    unspaced = ["".join(rng.choice(single[-60:]) for _ in range(n)) for n in (45, 300, 1200, 300)]
    words, weights = ["the", "a" * 38, "ab" * 19 + "c", *unspaced, "\U00013000" * 200, "international" * 9], np.arange(1.0, 10)
    size, ids, longest = len(pieces), {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    total = np.zeros(size)
    with np.errstate(divide="ignore"):
        for word, weight in zip(words, weights, strict=True):
            word, n = WORD_MARK + word, len(word) + 1
            steps = [[(i - k, ids.get(word[i - k : i]), 1 / size if word[i - k : i] in ids else 0) for k in range(1, min(longest, i) + 1)] for i in range(1, n + 1)]
            alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            alpha[0] = beta[n] = 0
            for i in range(1, n + 1):
                alpha[i] = np.logaddexp.reduce([alpha[j] + np.log(p + language_id.UNKNOWN * (j == i - 1)) for j, _, p in steps[i - 1]])
            for i in range(n, 0, -1):
                for j, k, p in steps[i - 1]:
                    beta[j] = np.logaddexp(beta[j], beta[i] + np.log(p + language_id.UNKNOWN * (j == i - 1)))
                    if k is not None:
                        total[k] += weight * p * np.exp(alpha[j] + beta[i] - alpha[n])
    want = (total + language_id.SMOOTHING) / (total + language_id.SMOOTHING).sum()
    assert language_id.fit_language(words, weights, index, rounds=1)[:-1] == pytest.approx(want, rel=1e-6, abs=0)


def test_language_of_held_out_documents(spark):
    out = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    joined = out.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = joined.count(), joined.where("lang = lang_pred").count()
    assert out.count() == 1000 and n > 150 and right / n > 0.98
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_cases(spark):
    rows = [(k, t, lang) for k, t, lang in [(1, "der die das und", "de"), (3, "the and of to", "en"), (4, None, "en"), (5, "der und", None), (None, "the of", "en")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__score2", F.lit(1))
    model = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert got[5]["__lang"] == "de" and got[None]["__lang"] == "en" and got[4]["__lang"] == "und"
    assert language_id.accepted(df, model).columns == df.columns and language_id.accepted(df, model).count() == 4
    assert language_id.identify(df.where("false"), language_id.fit(df.where("false"))).count() == 0


def test_token_counts_equal_separate_dynamic_programming(spark, texts, pieces):
    scores = token_counts.zipf_scores(pieces)
    per_byte, longest = token_counts.byte_score(scores), max(map(len, pieces))

    def count(word):
        word, best = WORD_MARK + word, [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            b = (best[i - 1][0] + size * per_byte, best[i - 1][1] + size)
            for j in range(max(0, i - longest), i):
                if word[j:i] in scores:
                    s, m = best[j][0] + scores[word[j:i]], best[j][1] + 1
                    if s > b[0] or s == b[0] and m < b[1]:
                        b = (s, m)
            best.append(b)
        return best[-1][1]

    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        words = (t or "").split()
        assert (got[k]["__pretokens"], got[k]["__tokens"], got[k]["__x"]) == (len(words), sum(map(count, words)), "kept")
    assert token_counts.count_tokens(frame(spark, texts).where("false")).count() == 0


def test_trie_scores_a_prefix_once():
    trie = token_counts.Trie(["ab", "abc", "abd", "b"])
    assert [len(p) for p, _ in trie.levels] == [2, 1, 2]


def unpack(rows, kind="<u2"):
    parts = {}
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, kind), np.frombuffer(r.position_ids, kind)
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= len(ids)
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert list(pos[a:b]) == list(range(b - a))
            parts.setdefault(d, []).append((o, list(map(int, ids[a:b]))))
    out = {}
    for d, segments in parts.items():
        out[d] = []
        for o, ids in sorted(segments):
            assert o == len(out[d])
            out[d] += ids
    return out


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_round_trip(spark, texts, size):
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=load_ranks(), special_tokens={})
    rows = packing.pack_documents(frame(spark, texts), size=size, buffer=5000).collect()
    got = unpack(rows)
    assert len({r.pack_id for r in rows}) == len(rows)
    for k, t in enumerate(texts):
        assert got.get(k, []) == plain.encode_ordinary(t or "")
    assert packing.pack_documents(frame(spark, texts).where("false")).count() == 0


def test_encoding_in_runs_equals_plain_encoding():
    import tiktoken

    ranks, r = load_ranks(), random.Random(11)
    plain = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = [*" ab1.\n\t\r\x1c\x85\u3000\xa0\u2028\0漢é\U0001f600", " ", " ", "'s", "the", "  ", " word", "x\ny"]
    runs = [["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(n)] for n in (0, 1, 1, 7, 8000)]
    for texts in [*runs, [""], [" "], ["\n"], ["a\n", "", "a"], ["w" * 30_000 + " w" * 30_000]]:
        tokenizer = packing.Tokenizer(ranks)
        assert [x.tolist() for x in tokenizer.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_best_fit_decreasing_equals_search():
    rng = random.Random(2)
    for _ in range(50):
        size = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 60))]
        free, want = [], []
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [f for f in free if f >= lengths[k]]
            if fits:
                at = free.index(min(fits))
                free[at] -= lengths[k]
            else:
                free.append(size - lengths[k])
            want.append(len(free))
        bins = packing.best_fit_decreasing(lengths, size)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in b) <= size for b in bins)
        assert sorted(size - sum(lengths[k] for k in b) for b in bins) == sorted(free)


def test_masks_find_every_tolerated_window():
    from itertools import combinations

    for n in range(5, 30):
        window, least = decontamination.window_of(n)
        for bad in combinations(range(window), window - least):
            assert any(all(s + k not in bad for k, c in enumerate(m) if c == "1") for m in decontamination.MASKS for s in range(window - len(m) + 1))
    assert [decontamination.window_of(n) for n in (1, 4, 6, 7, 11, 12, 13, 40)] == [(1, 1), (4, 4), (6, 6), (7, 6), (11, 10), (12, 11), (13, 11), (13, 11)]


@pytest.mark.parametrize("seed_rows", [decontamination.SEED_ROWS, 0])
def test_decontamination_equals_alignment(spark, seed_rows):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate([30, 20, 13, 14, 11, 9, 7, 6, 5, 4, 3])] + [(11, []), (12, ["same"] * 40)]
    docs = [(400, ["same"] * 3000), (401, ["same"] * 12), (402, ["same"] * 11 + ["no", "no"]), (403, ["same"] * 11 + ["no", "no"] + ["same"] * 3)]
    for d in range(300):
        words = say(rng.randint(0, 60))
        if rng.random() < 0.7:
            _, item = rng.choice(items[:-2])
            cut = [w if rng.random() > rng.choice([0, 0.1, 0.3]) else "sub" for w in item[rng.choice([0, 0, 3]) :]]
            at = rng.randint(0, len(words))
            words = words[:at] + cut + words[at:]
        docs.append((d, words))

    def found(words, item):
        size = min(len(item), 13)
        least = 11 if size == 13 else size - 1 if size >= 7 else size
        for p in range(len(words) - size + 1) if size else ():
            for q in range(len(item) - size + 1):
                if sum(a == b for a, b in zip(words[p : p + size], item[q : q + size], strict=True)) >= least:
                    return True
        return False

    marks = [", ", " \u2014 ", "\u300d\u3000", "\u201d "]
    df = spark.createDataFrame([(d, marks[d % 4].join(w).upper() if d % 2 else " ".join(w)) for d, w in docs] + [(1000, None), (1001, "")], "doc_id long, text string")
    df = df.withColumns({"__y": F.lit(1), "__items": F.lit("gone"), "k1": F.lit(2)})
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(None, " ".join(items[0][1])), (9, None)], "item_id long, text string")
    out = decontamination.contaminated(df, bench, seed_rows=seed_rows)
    assert out.columns == ["doc_id", "text", "__y", "k1", "__items", "__overlap"]
    got = {r.doc_id: r["__items"] for r in out.collect()}
    for d, words in docs:
        want = sorted(k for k, item in items if found(words, item))
        want = want + [None] if 0 in want else want
        assert got[d] == want
    assert got[1000] == [] and got[1001] == [] and sum(map(bool, got.values())) > 50
    clean = decontamination.drop_contaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, x in got.items() if not x}
    assert decontamination.drop_contaminated(df, bench.where("false")).count() == 306
    assert decontamination.contaminated(df.where("false"), bench).count() == 0


def test_short_items_with_one_word_in_curly_quotes(spark):
    bench = spark.createDataFrame([(1, "why does the sky look so blue at noon in summer"), (2, "name three rivers"), (3, "name four rivers")], "item_id long, text string")
    texts = ["a: why does the sky look so \u201cred\u201d at noon in summer!", "Name \u2018three\u2019 rivers.", "name five rivers", "why does the sky seem so red at noon in summer"]
    got = decontamination.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)
    assert {r.doc_id: r["__items"] for r in got.collect()} == {0: [1], 1: [2], 2: [], 3: []}


def segmentations(word, pieces):
    """Every way to cut a word into pieces and unknown characters, with the pieces used."""
    if not word:
        yield []
        return
    for size in range(1, len(word) + 1):
        if (p := word[:size]) in pieces:
            yield from ([p, *rest] for rest in segmentations(word[size:], pieces))
    yield from ([None, *rest] for rest in segmentations(word[1:], pieces))


def brute_model(docs, pieces):
    """Piece probabilities by language: expectation maximisation over all segmentations."""
    tables = {}
    for lang in sorted({k for _, _, k in docs}):
        words = [w for _, t, k in docs if k == lang for w in (t or "").split()]
        table = dict.fromkeys(pieces, 1 / len(pieces))
        for _ in range(language_id.ROUNDS):
            total = dict.fromkeys(pieces, language_id.SMOOTHING)
            for w in words:
                ways = [(s, math.prod(language_id.UNKNOWN if p is None else table[p] for p in s)) for s in segmentations("▁" + w, table)]
                whole = sum(x for _, x in ways)
                for s, x in ways:
                    for p in s:
                        if p is not None:
                            total[p] += x / whole
            table = {p: x / sum(total.values()) for p, x in total.items()}
        tables[lang] = table
    return tables


def test_language_id_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    pieces = ["▁", "▁a", "▁b", "a", "b", "c", "ab", "bc", "abc", "é", "▁ab", "ca"]
    monkeypatch.setattr(language_id, "load_pieces", lambda path: pieces)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 9)))
    rows = [(k, say(["aab", "bcc", "aéz"][k % 3]), ["x", "y", "z"][k % 3]) for k in range(60)] + [(60, "a b　c", "x"), (61, None, "x"), (62, "12 - 3", "y"), (63, "abc", None), (None, "abc", "q"), (64, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"__lang": F.lit("gone"), "made": F.lit("kept")})
    learned = [(k, t, lang) for k, t, lang in rows if k is not None and lang and t is not None and zlib.crc32(str(k).encode()) % 4 != 2]
    tables = brute_model(learned, pieces)
    out = language_id.identify(df, language_id.fit(df))
    assert out.columns == ["doc_id", "text", "lang", "made", "__lang", "__score"]
    got = {(r.doc_id, r.text): (r["__lang"], r["__score"]) for r in out.collect()}
    for k, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            assert got[k, t] == ("und", 0.0)
            continue
        logs = {
            lang: sum(math.log(sum(math.prod(language_id.UNKNOWN if p is None else table[p] for p in s) for s in segmentations("▁" + w, table))) for w in t.split())
            for lang, table in tables.items()
        }
        best = max(sorted(logs), key=logs.get)
        assert got[k, t][0] == best and got[k, t][1] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()))


def test_the_fit_reads_a_bounded_sample_of_every_language(spark):
    words = ["alpha", "beta", "gamma"]
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit(words[0]), F.col("id") % 300).alias("text"), F.concat(F.lit("l"), F.col("id") % 300).alias("lang"))
    model = language_id.fit(df, max_rows=600)
    assert len(model.langs) == 300 and not np.isclose(model.table[:-1].max(axis=0), 1 / (len(model.table) - 1)).any()


def test_every_language_with_words_is_learned(spark):
    """Rows of one id and text share a draw; the smallest is taken whatever the rate. Languages without a word are left out, too many are refused."""
    ident = next(k for k in range(1, 5000) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows = [(ident, "dieselben worte immer wieder", "de")] * 3000 + [(k, f"many other words number {k}", "en") for k in range(400)] + [(k, "   ", "xx") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (4, 40, 800):
        model = language_id.fit(df, max_rows=most)
        assert model.langs == ["de", "en"]
        assert model.predict(["immer dieselben worte", "many words"])[0] == ["de", "en"]
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("words").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="more than 1024 languages"):
        language_id.fit(many)
    repeated = spark.createDataFrame([(7, "many words", "en"), (7, "many words", "en"), (7, "dieselben worte", "de"), (9, "worte", "de")], "doc_id long, text string, lang string")
    out = language_id.identify(repeated, language_id.fit(df), keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r["__lang"]) for r in out) == [(7, "de"), (7, "en"), (7, "en"), (9, "de")]


def test_unspaced_scripts_are_learned(spark):
    say = {"ja": "これは長い文章ですから分かち書きはしませんがそれでも学習できなければなりません" * 3, "th": "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำจึงต้องเรียนรู้ได้เช่นกัน" * 3, "en": "the words of this text stand apart from one another " * 3}
    df = spark.createDataFrame([(k, t[k % 20 :], lang) for k in range(40) for lang, t in say.items()], "doc_id long, text string, lang string")
    got = language_id.identify(df.withColumn("text", F.substring("text", 5, 60)), language_id.fit(df))
    assert {r.lang for r in got.collect()} == {r["__lang"] for r in got.collect()} and got.where("lang <> __lang").count() == 0


def test_packing_null_ids_repeats_and_odd_spaces(spark):
    rows = [(None, "a  b\x00c " * 3000), (None, "lone"), (5, "x y"), (5, "x y"), (6, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), size=64).collect()
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=load_ranks(), special_tokens={})
    found = sorted((str(d), o) for r in got for d, o in zip(r.doc_ids, r.doc_offsets, strict=True))
    want = sorted((str(k), o) for k, t in rows for o in range(0, len(plain.encode_ordinary(t or "")), 64))
    assert found == want and sum(r.n_tokens for r in got) == sum(len(plain.encode_ordinary(t or "")) for _, t in rows)
