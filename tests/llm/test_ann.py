import numpy as np

from tallyloom.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def exact(rows, q, k):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    score = {i: v @ x[q] / (np.linalg.norm(v) * np.linalg.norm(x[q])) for i, v in x.items() if i != q}
    return sorted(score, key=lambda i: (-score[i], i))[:k], score


def test_recall_and_scores_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=64)]) for i in range(3000)]
    df = frame(spark, rows)
    got = A.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 3000, 100):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        best, score = exact(rows, q, 5)
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best))
    assert hits / 150 >= 0.9


def test_groups_salts_and_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=64)]) for i in range(600)]
    df = frame(spark, rows)
    asked = df.filter("vec_id % 20 = 0")
    every = {tuple(r)[:3] for r in A.nearest(df, asked, radii=()).collect()}
    assert {r[2] for r in every if r[0] == 40} == set(exact(rows, 40, 5)[0])
    assert every == {tuple(r)[:3] for r in A.nearest(df, asked, radii=(A.WIDTH,)).collect()}
    monkeypatch.setattr(A, "BLOCK_ROWS", 100)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(A, "GROUP_ROWS", 150)
    assert every == {tuple(r)[:3] for r in A.nearest(df, asked, radii=()).collect()}
    assert every == {tuple(r)[:3] for r in A.nearest(df, asked, radii=(A.WIDTH,)).collect()}


def test_pigeonhole_retrieves_all_within_the_radius():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 2**A.WIDTH, size=(5000, A.SUBSTRINGS)).astype(np.int32)
    rows[1::2] = rows[::2] ^ (1 << rng.integers(0, A.WIDTH, size=(2500, A.SUBSTRINGS))) * (rng.random((2500, A.SUBSTRINGS)) < 0.9)
    indexes = [A.SubstringIndex(rows[:, s]) for s in range(A.SUBSTRINGS)]
    for radius in (0, 1, 3):
        for q in rows[:20]:
            met = set()
            for s, index in enumerate(indexes):
                found = index.within(int(q[s]), radius)
                assert np.array_equal(np.sort(found), np.flatnonzero(np.bitwise_count(rows[:, s] ^ q[s]) <= radius))
                met |= set(found.tolist())
            within = np.flatnonzero(np.bitwise_count(rows ^ q).sum(1) <= A.SUBSTRINGS * (radius + 1) - 1)
            assert set(within.tolist()) <= met


def test_the_first_radius_probes_a_fifth_of_unrelated_rows():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    subs = A.substrings(x, A.fit_rotation(x))
    met = [(np.bitwise_count(subs ^ subs[i]) <= A.RADII[0]).any(1).mean() for i in range(0, 6000, 100)]
    assert np.mean(met) < 0.22
    assert A.retrieval(A.trusted_cosine(3), 3) >= A.TRUST > A.retrieval(A.trusted_cosine(3) - 0.01, 3)


def test_a_crowd_of_near_vectors_stays_few_pairs(spark):
    """What leaves a group goes by k and not by how many rows lie close together."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    rows = [(i, [float(v) for v in centre + 0.3 * rng.normal(size=64)]) for i in range(2000)]
    df = frame(spark, rows)
    got = A.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    for q in range(0, 2000, 100):
        assert {r["vec_id"] for r in got if r["query_id"] == q} == set(exact(rows, q, 5)[0])


def test_unusable_vectors_ties_and_few_candidates(spark):
    v = [1.0] * 64
    bad = [(10, None), (20, []), (30, [0.0] * 64), (40, [float("nan")] * 64), (50, [None] * 64), (60, [float("inf")] * 64), (70, [1.0] * 3), (None, v)]
    good = [(100, v), (3, v), (2, v), (2, v), (7, [-1.0] * 64)]
    df = frame(spark, bad + good)
    got = [tuple(r) for r in A.nearest(df, df).filter("query_id = 100").orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 2), (2, 2), (3, 3), (4, 7)] and abs(got[0][3] - 1) < 1e-12 and abs(got[3][3] + 1) < 1e-12
    assert not [r for r in A.nearest(df, df).collect() if r["query_id"] in (10, 20, 30, 40, 50, 60, 70)]
    assert A.nearest(df.filter("vec_id = -1"), df).count() == 0 and A.nearest(df, df.filter("vec_id = -1")).count() == 0


def test_equal_vectors_tie_wherever_they_lie(spark):
    rng = np.random.default_rng(8)
    same = [float(v) for v in rng.normal(size=64)]
    near = [v + 0.01 * float(d) for v, d in zip(same, rng.normal(size=64), strict=True)]
    rows = [(i, [float(v) for v in rng.normal(size=64)]) for i in range(1, 400)]
    rows += [(i, same) for i in range(1000, 1700, 7)] + [(0, near)]
    df = frame(spark, rows)
    got = sorted((r["rank"], r["vec_id"]) for r in A.nearest(df, df.filter("vec_id = 0")).collect())
    assert got == [(1, 1000), (2, 1007), (3, 1014), (4, 1021), (5, 1028)]
