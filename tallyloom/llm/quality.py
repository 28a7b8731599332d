"""Quality rules: a hashed n-gram log-likelihood ratio between trusted text and the corpus.

Every word and pair of words is hashed into one of BUCKETS features. Two multinomials are counted over them: one over the
trusted documents, one over the whole corpus. A document's score is the sum of log(p_trusted / p_corpus) over its
n-grams, divided by their number. Documents at or over the threshold are kept; plain rules fail some before that.

The corpus is counted whole. The trusted text is a bounded sample of the rows labelled good: at most ``trusted_rows``,
those with the least hashes, so the same ones each time. Counts by bucket are a table of fixed size, which alone goes
to the driver and back.

Defined cases: a null or blank text has no n-grams, the score 0 and fails the rules; without any trusted row the score
is 0 and the rules alone decide; labels repeat or are null without harm; a null doc_id is never trusted; an empty table
gives an empty result; other columns pass through, except that the operator's own replace input columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.joins import bounded_join
from tallyloom.llm.textcols import boxed, unboxed
from tallyloom.llm.words import forget, ngram_hashes, slices, word_hashes

BUCKETS = 2**16
TRUSTED_ROWS = 200_000
#: Mean log ratio per n-gram that a document needs.
THRESHOLD = -0.25
#: Count added to every bucket of the corpus, and to every trusted one in proportion: a bucket that was seen a few times
#: says little, whichever text it was in.
PRIOR = 10.0
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
_SHIFT = np.uint64(64 - int(np.log2(BUCKETS)))
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def features(words: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of words."""
    return (np.concatenate([ngram_hashes(words, 1), ngram_hashes(words, 2)]) >> _SHIFT).astype(np.int64)


def _counted(batches):
    corpus, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for pdf in slices(batches):
        found = [features(word_hashes(t)) for t in pdf["text"]]
        corpus += np.bincount(np.concatenate(found), minlength=BUCKETS)
        good = [f for f, g in zip(found, pdf["trusted"], strict=True) if g]
        if good:
            trusted += np.bincount(np.concatenate(good), minlength=BUCKETS)
    used = np.flatnonzero(corpus)
    yield pd.DataFrame({"bucket": used, "corpus": corpus[used], "trusted": trusted[used]})


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id of at most about ``rows`` rows of good and not toxic quality, by the least hashes."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    total = good.count()
    if total <= rows:
        return good
    return good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < int(2**31 * rows / total))


def log_ratios(docs: DataFrame, labels: DataFrame, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """log(p_trusted / p_corpus) by bucket; zeros if nothing is trusted."""
    ids = trusted_ids(labels, rows).withColumn("trusted", F.lit(True))
    marked = bounded_join(docs.select("doc_id", "text"), ids, "doc_id", "left")
    marked = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = marked.mapInPandas(_counted, "bucket long, corpus long, trusted long").groupBy("bucket")
    sums = counts.agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted")).toPandas()
    if not sums["trusted"].sum():
        return np.zeros(BUCKETS)
    corpus, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    corpus[sums["bucket"]] = sums["corpus"]
    trusted[sums["bucket"]] = sums["trusted"]
    share = trusted.sum() / corpus.sum()
    return np.log((trusted + PRIOR * share) / ((corpus + PRIOR) * share))


def base_rules(text: str | None, words: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of a text."""
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    repeats = 0
    windows = ngram_hashes(words, 3)
    if len(windows):
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        if again.any():
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[i : i + len(again)] |= again
            repeats = int(covered.sum())
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, n < 50 or 100 * repeats > 50 * n


def _scored(ratios, threshold: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = ratios.value
        for texts in batches:
            rows = []
            for text in texts:
                words = word_hashes(text)
                base = base_rules(text, words)
                score = float(table[features(words)].mean()) if len(words) else 0.0
                rows.append((*base, score, not base[-1] and score >= threshold))
            yield pd.DataFrame(rows, columns=list(OWN))
        forget()

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return F.pandas_udf(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRUSTED_ROWS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, rows))
    scored = docs.select(boxed(docs), _scored(ratios, threshold)(F.col("text")).alias("q_"))
    return scored.select(*unboxed(docs, OWN), "q_.*")
