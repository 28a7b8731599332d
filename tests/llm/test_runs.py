import hashlib
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm import runs as R
from tallyloom.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def by_hand(words, least=12):
    """(start, length, period) of all runs, period by period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k - i + q
            if k > i and length >= max(least, 2 * q):
                inside = words[i : i + length]
                if not any(inside[p:] == inside[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row_by_hand(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * top[1] // top[2] if runs else None
    return (doc_id, len(runs), *top, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        monkeypatch.setattr(R, "JUMPS", int(rng.integers(0, 5)))  # both ways to the next smaller value
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.integers(0, 70))
            words = rng.integers(0, rng.choice([1, 2, 3, 9]), n).tolist()
            if n and rng.random() < 0.5:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, 20))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        for least in (2, 12):
            found = R.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), least)
            got = [tuple(map(int, r)) for r in zip(*found, strict=True)]
            assert sorted((t, s, q, n) for t, s, n, q in got) == sorted((t, s, q, n) for t, words in enumerate(texts) for s, n, q in by_hand(words, least))


def test_next_smaller_over_hard_orders():
    rng = np.random.default_rng(1)
    for values in (np.arange(3000), np.arange(3000)[::-1], np.concatenate([[0], np.arange(2999, 0, -1)]), rng.permutation(3000)):
        want = [next((j for j in range(i + 1, 3000) if values[j] < values[i]), 3000) for i in range(0, 3000, 97)]
        assert R.next_smaller(values)[::97].tolist() == want


def test_long_texts_of_few_words():
    for words, want in ((np.zeros(200_000), (0, 200_000, 1)), (np.arange(200_000) % 7919, (0, 200_000, 7919))):
        found = R.find_runs(words.astype(np.int64), np.array([len(words)]))
        assert [tuple(map(int, r[1:])) for r in zip(*found, strict=True)] == [want]


def test_the_query_over_a_small_table(spark):
    """Every document of the table, against brute force."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for doc_id, text in docs.items():
        if len(text or "") < 9_000:
            assert rows[doc_id] == row_by_hand(doc_id, text), doc_id
    assert sum(r[1] > 0 for r in rows.values()) > 0.05 * len(rows)


def test_odd_rows_and_clashing_columns(spark, documents, odd_rows):
    again = "a b c " * 5 + "a b"
    docs = documents([*odd_rows, (30, again, "s"), (30, again, "s"), (31, f"\t{again}\n ", "s"), (32, "é " * 20, "s")]).selectExpr("*", "1 as runs", "'x' as COLLAPSED", "2 as found_")
    out = R.periodic_runs(docs)
    assert set(docs.columns) - {"runs", "COLLAPSED"} < set(out.columns)
    rows = out.select("doc_id", "runs", "collapsed").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (30, 31):
            assert [tuple(x) for x in r["runs"]] == [(0, 17, 3)] and r["collapsed"] == "a b c"
        elif r["doc_id"] == 32:
            assert [tuple(x) for x in r["runs"]] == [(0, 20, 1)] and r["collapsed"] == "é"
        elif r["doc_id"] == 4:
            assert [tuple(x) for x in r["runs"]] == [(0, 60_000, 9973)] and r["collapsed"] == " ".join(f"w{i}" for i in range(9973))
        else:
            assert r["runs"] == [] and len(r["collapsed"]) <= 20
    assert R.periodic_runs(docs.filter("doc_id = -1")).count() == 0
