"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words and pairs of neighbouring words, and the same of the words' shapes (runs of capitals, small
letters, digits and each other sign, and a mark where a word repeats the one before), hashed into 2^BITS buckets. A bucket's value is its share of
the text's words. Together with a constant they are a sparse vector, and a score is the logistic function of its product
with the weights.

Training takes a sample of at most ``fit_rows`` labelled documents, those with the least hashes of their ids, so the same
ones each time. Executors make their vectors; one task then runs the updates over this bounded sample, ``epochs`` times in
the order of the hashes (FTRL-Proximal: each bucket has its own rate, and small sums stay at a weight of zero). The
weights that are not zero go to the driver, 2^BITS at most, and back to score all rows where they lie.

Defined cases: a null or blank text has no n-grams and is scored by the constant alone; without labelled rows all scores are
0.5; of repeated labels the least counts, null ones don't, nor do those of a null doc_id; of rows that share a labelled
doc_id one is learned from; very long texts are processed whole; an empty table gives an empty result; other columns pass
through, except that the operator's own replace input columns of their name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.coding import coded
from tallyloom.llm.staging import staged
from tallyloom.llm.textcols import boxed, unboxed
from tallyloom.llm.words import forget, mixed, parts_by_bytes

BITS = 20
FIT_ROWS = 8192
EPOCHS = 4
#: Rate, its smoothing, and the penalties of the updates.
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.01, 0.0001
SLICE = 2_000_000
OWN = ("score",)
#: Words whose hashes a slice looks up are remembered up to this number; beyond it the memory starts anew.
REMEMBERED = 150_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_GROUPS = 4

_CLASSES = bytearray(range(256))
for _low, _high, _sign in ((b"a", b"z", b"a"), (b"A", b"Z", b"A"), (b"0", b"9", b"0"), (b"\x80", b"\xff", b"a")):
    _CLASSES[_low[0] : _high[0] + 1] = _sign * (_high[0] - _low[0] + 1)
_CLASSES = bytes(_CLASSES)
_AGAIN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """What kinds of signs a word has, one for each run of a kind."""
    return _AGAIN.sub(rb"\1", word.translate(_CLASSES))


class _Known(dict):
    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        value = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(shape(word), seed=1))
        if len(word) <= 64:
            self[word] = value
        return value


_KNOWN = _Known()


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words of each text) of a slice of texts: rows of _GROUPS buckets for each word; -1 where there is none."""
    words = coded(texts)
    n = len(words.codes)
    if not n:
        return np.empty((0, _GROUPS), np.int64), words.sizes
    known = np.array(list(map(_KNOWN.__getitem__, words.vocabulary.cast(pa.binary()).to_pylist())), np.uint64)
    word, kind = known[words.codes, 0], known[words.codes, 1]
    first = np.zeros(n + 1, bool)
    first[np.cumsum(words.sizes) - words.sizes] = True  # the place after the last word may be an empty text's
    first = first[:n]
    before, kind_before = np.roll(word, 1), np.roll(kind, 1)
    again = (word == before) & ~first
    pair = mixed(before * _MUL + word + np.uint64(2))
    kinds = mixed(np.where(again, np.uint64(0), kind_before) * _MUL + kind + np.uint64(3))
    buckets = (np.stack([mixed(word), pair, mixed(kind), kinds], axis=1) >> np.uint64(64 - BITS)).astype(np.int64)
    buckets[first, 1] = buckets[first, 3] = -1
    return buckets, words.sizes


def vector(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and values of one text's rows of buckets; the constant is the bucket after the last."""
    found, counts = np.unique(buckets[buckets >= 0], return_counts=True)
    return np.append(found, 2**BITS), np.append(counts / max(1, len(buckets)), 1.0)


def _vectors(batches):
    for batch in batches:
        order, label = batch.column("order"), batch.column("label")
        for lo, part in parts_by_bytes(batch.column("text"), SLICE):
            buckets, sizes = hashed(part)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            made = [vector(buckets[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [pa.array([x.astype("<i4").tobytes() for x, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([order[lo : lo + len(part)], label[lo : lo + len(part)], *columns], ["order", "label", "buckets", "shares"])
    forget()


class Ftrl:
    """FTRL-Proximal over single examples: sums of gradients (z) and of their squares (n) by bucket."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / rate, 0.0)

    def learn(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (_logistic(float(w @ values)) - label) * values
        n = self.n[at]
        more = n + gradient**2
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0)))


def _fitted(epochs: int):
    def run(batches):
        rows = [(np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4").astype(float), y) for pdf in batches for b, v, y in zip(pdf["buckets"], pdf["shares"], pdf["label"], strict=True)]
        model = Ftrl(2**BITS + 1)
        for _ in range(epochs):
            for at, values, label in rows:
                model.learn(at, values, label)
        weights = model.weights()
        used = np.flatnonzero(weights)
        yield pd.DataFrame({"bucket": used, "weight": weights[used]})
        del rows
        forget()

    return run


def fit_sample(docs: DataFrame, labels: DataFrame, learned: Column, rows: int = FIT_ROWS) -> DataFrame:
    """order, label and text of at most so many labelled documents whose doc_id is one that may be learned from."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learned)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)  # ordered in parts, then joined: rows of ids
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most so many rows of three numbers
    text = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text"), "text")).alias("least")
    return texts.groupBy("doc_id", "order", "label").agg(text).select("order", F.col("label").cast("double").alias("label"), "least.text")


def fit(docs: DataFrame, labels: DataFrame, learned: Column, rows: int = FIT_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights by bucket, the constant's last."""
    made = fit_sample(docs, labels, learned, rows).mapInArrow(_vectors, "order long, label double, buckets binary, shares binary")
    made = staged(made, "fit-sample").repartition(1).sortWithinPartitions("order")  # a bounded sample
    weights = made.mapInPandas(_fitted(epochs), "bucket int, weight double").toPandas()
    out = np.zeros(2**BITS + 1)
    out[weights["bucket"]] = weights["weight"]
    return out


def _scores(weights, texts: pa.Array) -> pa.Array:
    table = weights.value
    out = []
    for _, part in parts_by_bytes(texts, SLICE):
        buckets, sizes = hashed(part)
        sums = np.concatenate([[0.0], np.cumsum(np.where(buckets >= 0, table[buckets], 0.0).sum(1))])
        ends = np.cumsum(sizes)
        out.append(_logistic(table[-1] + (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)))
    forget()
    return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())


def score_quality(docs: DataFrame, labels: DataFrame, learned: Column | None = None, rows: int = FIT_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """docs with score, the probability that quality is 1. learned: which doc_id may be learned from (all)."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, F.lit(True) if learned is None else learned, rows, epochs))

    def run(texts: pa.Array) -> pa.Array:
        return _scores(weights, texts)

    scored = docs.select(boxed(docs), F.arrow_udf(run, "double")(F.col("text")).alias("score"))
    return scored.select(*unboxed(docs, OWN), "score")
