import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import quality as Q


def by_hand(text):
    """The base rules, by plain Python."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def corpus():
    rng = np.random.default_rng(5)
    good = [f"g{i}" for i in range(300)]
    rows = [(2000 + i, " ".join(rng.choice(good, 80)) + "\n" + "same line\n" * (i % 3), "s") for i in range(120)]
    junk = [(1000 + i, " ".join(f"{w}%%" for w in rng.choice([f"j{k}" for k in range(60)], 80)), "s") for i in range(60)]
    return rows, junk


def test_base_rules_and_verdicts(spark, documents, odd_rows):
    good, junk = corpus()
    tricky = [(500, "a b c a b c  x\x1cy é\n\n#\n#\n #", "s"), (501, "one two three " * 30, "s")]
    docs = documents([*good, *junk, *odd_rows, *tricky])
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:60]] * 2 + [(i, 0, 0) for i, _, _ in junk] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = Q.quality_rules(docs, labels)
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] != 4:
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            assert got == by_hand(r["text"]), r["doc_id"]
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {i for i, _, _ in good} <= kept and not {i for i, _, _ in junk} & kept
    assert [r["score"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0.0] * 3


def test_scores_are_those_of_two_counted_multinomials(spark, documents):
    good, junk = corpus()
    docs = documents([*good, *junk])
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:60]], "doc_id long, quality int, toxic int")
    got = Q.log_ratios(docs, labels)
    corpus_counts, trusted = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for i, text, _ in [*good, *junk]:
        for bucket in Q.features(Q.word_hashes(text)):
            corpus_counts[bucket] += 1
            trusted[bucket] += 2000 <= i < 2060
    share = trusted.sum() / corpus_counts.sum()
    assert np.allclose(got, np.log((trusted + Q.PRIOR * share) / ((corpus_counts + Q.PRIOR) * share)))


def test_without_trusted_rows_and_empty(spark, documents):
    good, _ = corpus()
    docs = documents(good[:5])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["kept"] for r in Q.quality_rules(docs, none).collect()} == {True}
    assert Q.quality_rules(docs.filter("doc_id = -1"), none).count() == 0


def test_held_out_labels(spark):
    """Trusted text from one half of the labels judges the other half."""
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    judged = Q.quality_rules(docs, labels.filter(half == 0)).filter("not base_failed").select("doc_id", "kept")
    rows = judged.join(labels.filter(half == 1), "doc_id").collect()
    share = lambda quality, kept: sum(r["quality"] == quality and r["kept"] == kept for r in rows) / max(1, sum(r["quality"] == quality for r in rows))
    assert share(1, True) >= 0.95 and share(0, False) >= 0.8  # on sf0.1: 1.0 and 0.91
