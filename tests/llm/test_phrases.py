from collections import Counter
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import phrases as P


def by_hand(rows, least=30, kept=2000):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting of (text, lang) rows."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            n[lang] += len(words)
            f.update((lang, words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, words), a in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = (lang, words[i : i + m])
                around[key] = max(around[key], a)
    out = {}
    for (lang, words), a in found.items():
        if 100 * around[lang, words] < 80 * a:
            cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, items in out.items() for i, (s, a, p, left, right) in enumerate(sorted(items)[:kept], 1))


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "ÉTÉ", "x\x1cy", *(f"w{i}" for i in range(40))]
    odds = np.array([8, 4, 6, 2, 2, 2, 2, 1, 1, 1, *[0.6] * 40])
    rows = []
    for i in range(160):
        parts = []
        for _ in range(int(rng.integers(1, 9))):
            parts += list(rng.choice(words, int(rng.integers(0, 12)), p=odds / odds.sum()))
            parts.append(rng.choice(["New York City Hall", "a b a b a b a b", "", "of the new"]))
            parts.append(rng.choice([".", ",", "\n", "", "?!", " \t ", "\r\n"]))
        rows.append((" ".join(parts), ["en", "en", "de", None, "und"][i % 5]))
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_collocations_against_counting(spark, monkeypatch, hot):
    """With hot = 3, frequent prefixes are dealt out in parts."""
    monkeypatch.setattr(P, "HOT_PARTS", hot)
    monkeypatch.setattr(P, "SLICE", 3_000)
    rows = [*corpus(), (None, "en"), ("", "de"), (" .,\n", None)]
    docs = spark.createDataFrame([(1, t, x, 1, "y") for t, x in rows], "doc_id long, text string, lang string, n long, word string").repartition(5)
    got = sorted(tuple(r) for r in P.collocations(docs).collect())
    want = by_hand(rows)
    assert got == want and len(want) > 20
    assert sorted(tuple(r) for r in P.collocations(docs, kept=5).collect()) == by_hand(rows, kept=5)


def test_ties_go_by_count_and_bytes(spark):
    """Forty pairs with equal scores: by count, then by the bytes of the phrase."""
    rows = [(". ".join([f"{a}{i} b{i}"] * (30 + i % 3)), "en") for i in range(40) for a in ("a", "é")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in P.collocations(docs).collect()) == by_hand(rows)


def test_cut_keeps_texts_and_pieces_apart():
    codes, pieces, text, words = P.cut(pa.array(["A b,c", None, "", "d", "e. f\tG  "]))
    assert [words[c] for c in codes] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    assert text.tolist() == [0, 0, 0, 3, 4, 4, 4]
    assert [pieces[i] == pieces[i - 1] for i in range(1, 7)] == [True, False, False, False, False, True]


def test_words_have_sparks_numbers(spark):
    texts, langs = ["a é\tlonger-than-thirty-two-bytes-of-word-here b", "a b", "x"], ["en", "fr", None]
    s = P.Slice(pa.array(texts), pa.array(langs))
    rows = [(s.langs[x], s.vocabulary[w].decode(), h) for x, w, h in zip(s.lang, s.word, s.hashes.view(np.int64).tolist(), strict=True)]
    df = spark.createDataFrame(rows, "lang string, word string, id long")
    assert df.filter("id = xxhash64(lang, word)").count() == len(rows) == 7


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert P.collocations(docs).count() == 0
    assert P.collocations(spark.createDataFrame([(None, None)] * 2, "text string, lang string")).count() == 0


def shuffled(spark):
    """Bytes that the stages so far have shuffled."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_word_whose_pairs_are_all_frequent_shuffles_few_bytes(spark):
    """Every word of a corpus is a pointer with three more words; a row for each would take some twenty bytes."""
    rng = np.random.default_rng(8)
    rows = [(" ".join(f"w{x}" for x in rng.integers(0, 70, 200)), "en") for _ in range(1500)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    before = shuffled(spark)
    _, phrases = P.frequent_phrases(docs)
    assert phrases.filter("size(ids) = 2").count() > 4000
    assert shuffled(spark) - before < 10 * 1500 * 200


def test_packed_columns_come_back():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 2**63, 500, np.uint64), np.arange(500), np.zeros(500, bool)]
    assert all((a == b).all() for a, b in zip(P.unpacked(P.packed(*columns), 500, 3), columns, strict=True))
    assert len(P.packed(*columns)) < 500 * 10


@pytest.mark.parametrize("most", [0, 20])
def test_words_without_numbers_keep_their_hashes(spark, monkeypatch, most):
    """With room for few numbers, or none, the others are told apart by hash; small units of work change nothing either."""
    monkeypatch.setattr(P, "NUMBERED", most)
    monkeypatch.setattr(P, "GATHERED", 50)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in P.collocations(docs).collect()) == by_hand(rows)
