import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm import classifier as C
from tallyloom.llm.queries import op11_quality_classifier
from tallyloom.llm.words import mixed


def features_by_hand(text):
    """Shares of hashed words, pairs and shapes, one by one."""
    mul, u = C._MUL, np.uint64
    bucket = lambda h: int(h >> u(64 - C.BITS))
    out, before, words = Counter(), None, (text or "").encode().split()
    for w in words:
        word, kind = u(C.xxhash.xxh3_64_intdigest(w)), u(C.xxhash.xxh3_64_intdigest(C.shape(w), seed=1))
        out[bucket(mixed(word))] += 1
        out[bucket(mixed(kind))] += 1
        if before is not None:
            out[bucket(mixed(before[0] * mul + word + u(2)))] += 1
            out[bucket(mixed((u(0) if before[0] == word else before[1]) * mul + kind + u(3)))] += 1
        before = word, kind
    return {b: n / len(words) for b, n in out.items()} | {2**C.BITS: 1.0}


TEXTS = ["a b a b", None, "", " x\ty\n\nx x ", "THE!! THEA!! é9 É", "one", ""]


def test_vectors_and_scores_of_a_slice():
    with np.errstate(over="ignore"):
        want = [features_by_hand(t) for t in TEXTS]
    buckets, sizes = C.hashed(pa.array(TEXTS))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for lo, hi, one in zip(cuts[:-1], cuts[1:], want, strict=True):
        at, values = C.vector(buckets[lo:hi])
        assert dict(zip(at.tolist(), values.tolist(), strict=True)) == one
    weights = np.random.default_rng(1).normal(size=2**C.BITS + 1)
    got = C._scores(type("B", (), {"value": weights}), pa.array(TEXTS)).to_numpy()
    assert np.allclose(got, [1 / (1 + np.exp(-sum(weights[b] * v for b, v in one.items()))) for one in want])


def test_shapes():
    assert [C.shape(w) for w in (b"the", b"The,", b"THE!!", "Été".encode(), b"a1-22")] == [b"a", b"Aa,", b"A!", b"a", b"a0-0"]


def test_updates_are_those_of_ftrl_proximal():
    """Against the updates written out for single numbers."""
    rng = np.random.default_rng(2)
    model, z, n = C.Ftrl(6, 0.7, 1.0, 0.05, 0.01), [0.0] * 6, [0.0] * 6

    def weight(i):
        if abs(z[i]) <= 0.05:
            return 0.0
        return ((0.05 if z[i] > 0 else -0.05) - z[i]) / ((1.0 + n[i] ** 0.5) / 0.7 + 0.01)

    for _ in range(200):
        at = np.sort(rng.choice(6, 3, replace=False))
        x, y = rng.random(3), float(rng.random() < 0.5)
        ws = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-sum(w * v for w, v in zip(ws, x, strict=True))))
        for i, w, v in zip(at, ws, x, strict=True):
            g = (p - y) * v
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.7
            z[i] += g - sigma * w
            n[i] += g * g
        model.learn(at, x, y)
    assert np.allclose(model.weights(), [weight(i) for i in range(6)]) and (model.weights() != 0).any()


def test_held_out_documents(spark):
    """Labels of held-out ids are not seen, and their documents are judged right."""
    where = "/root/testdata/sf0.01"
    rows = op11_quality_classifier(spark, where).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{where}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == q] for q in (1, 0))
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) >= 0.95  # area under the curve
    assert np.mean([s >= 0.3 for s in good]) >= 0.97 and np.mean([s < 0.3 for s in bad]) >= 0.8


def test_only_ids_that_may_be_learned_from_count(spark, documents):
    docs = documents([(i, f"good words {i}" if i % 2 else f"JUNK!! ### {i}", "s") for i in range(60)])
    labels = lambda wrong: spark.createDataFrame([(i, (i % 2) ^ int(wrong and i >= 40), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    scores = [sorted((r["doc_id"], r["score"]) for r in C.score_quality(docs, labels(wrong), F.col("doc_id") < 40).collect()) for wrong in (False, True)]
    assert scores[0] == scores[1] and all((s > 0.5) == (i % 2 == 1) for i, s in scores[0])


def test_sample_is_bounded_and_the_same_each_time(spark, documents):
    docs = documents([(i % 50, f"text {i}", "s") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] * 2 + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    one, two = (sorted(tuple(r) for r in C.fit_sample(docs, labels, F.lit(True), 20).collect()) for _ in range(2))
    assert one == two and len(one) == 20


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows).selectExpr("*", "0 as Score", "1 as label", "2 as `order`")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in C.score_quality(docs, none).select("score").collect()} == {0.5}
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (4, 1, 0), (5, 1, 0), (5, 0, 1), (None, 1, 0), (99, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    out = C.score_quality(docs, labels)
    rows = out.select("doc_id", "score").collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1  # the constant alone
    assert [c for c in docs.columns if c != "Score"] == [c for c in out.columns if c != "score"]
    assert C.score_quality(docs.filter("doc_id = -1"), labels).count() == 0
