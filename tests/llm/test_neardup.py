import numpy as np

from tallyloom.llm import neardup as N
from tallyloom.llm.graph import components
from tallyloom.llm.words import shingle_set


def brute(rows, n, percent):
    """Components by all pairs of plain shingle sets."""
    sets = []
    for _, text, _ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return [(row[0], len(s), row[0] if not s else least.get(find(i))) for i, (row, s) in enumerate(zip(rows, sets, strict=True))]


def family(rng, base, count, first, edits):
    """Copies of a text with a few words changed."""
    rows = []
    for i in range(count):
        words = base.split()
        for at in rng.integers(0, len(words), rng.integers(0, edits + 1)):
            words[at] = f"e{rng.integers(10**6)}"
        rows.append((first + i, " ".join(words), "s"))
    return rows


def made_rows():
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    rows = [(500 + i, text(60), "s") for i in range(60)]
    rows += family(rng, text(120), 90, 1000, 6) + family(rng, text(40), 30, 2000, 2)
    copy = text(50)
    return rows + [(3000 + i, copy.upper() if i % 2 else copy, "s") for i in range(40)]


def test_components_are_those_of_all_pairs(spark, documents, odd_rows):
    rows = made_rows() + odd_rows + [(9001, "A b", "s"), (9000, "a B", "s"), (9002, "a b c", "s")]
    got = N.near_duplicates(documents(rows), shingle=3, percent=85).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows, 3, 85), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_small_blocks_find_the_same(spark, documents, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = made_rows()
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(documents(rows), shingle=3, percent=85).collect()}
    assert got == {i: c for i, _, c in brute(rows, 3, 85)}


def test_deduplicate_keeps_one_of_each(spark, documents, odd_rows):
    rows = made_rows() + odd_rows
    docs = documents(rows)
    out = N.deduplicate(docs)
    want = [i for i, _, c in brute(rows, 5, 80) if i == c]
    assert out.columns == docs.columns
    assert sorted(str(r[0]) for r in out.select("doc_id").collect()) == sorted(map(str, set(want) | {None}))
    assert N.deduplicate(docs.filter("doc_id = -1")).count() == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(8)
    errors = []
    for shared in (1400, 1700, 1900):
        a = rng.integers(1, 2**63, 2000, dtype=np.int64).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(1, 2**63, 2000 - shared, dtype=np.int64).astype(np.uint64)])
        x, y = N.sketches(N.minhashes([np.unique(a), np.unique(b)]))
        errors.append(N.estimated_similarity(np.bitwise_count(x ^ y).sum()) - shared / (4000 - shared))
    assert np.abs(errors).max() < 0.15
    assert abs(N.estimated_similarity(N.max_differing_bits(0.68)) - 0.68) < 0.02


def test_shingles_repeat_once():
    assert len(shingle_set("a b c a b c", 3)) == 3


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 202), (202, 203), (203, 201)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {202: 201, 203: 201}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_texts_that_share_an_id_are_one_document(spark, documents):
    """Each text of a repeated id keeps its links, whichever text is met first."""
    rng = np.random.default_rng(31)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 5000, 80))
    x, y, z = text(), text(), text()
    rows = [(5, x, "s"), (5, y, "s"), (9, y + " end", "s"), (8, x + " end", "s"), (3, z, "s"), (5, "", "s")]
    for _ in range(3):
        rows = rows[2:] + rows[:2]
        got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(documents(rows)).filter("n_shingles > 0").collect()}
        assert got == {5: 5, 9: 5, 8: 5, 3: 3}


def test_chained_groups_dealt_by_band_give_the_same(spark, documents, monkeypatch):
    rng = np.random.default_rng(32)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 12))):
            words[at] = f"v{rng.integers(0, 3)}"
        rows.append((i, " ".join(words), "s"))
    whole = {tuple(r) for r in N.near_duplicates(documents(rows)).collect()}
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "CHAINED", 1)
    assert whole == {tuple(r) for r in N.near_duplicates(documents(rows)).collect()} and len({r[2] for r in whole}) < 60


def test_other_thresholds_lose_nothing(spark, documents):
    """As the pipeline runs it (five words, 0.8), and lower."""
    rows = made_rows()
    for shingle, percent in ((5, 80), (3, 60)):
        got = N.near_duplicates(documents(rows), shingle=shingle, percent=percent).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, shingle, percent))


def test_bands_and_sketches_follow_the_threshold():
    assert [N.banding(p) for p in (60, 80, 85, 95)] == [(48, 3), (28, 5), (24, 6), (13, 11)]
    for percent in (60, 80, 85, 95):
        bands, rows = N.banding(percent)
        assert bands * rows <= N.SAMPLES and (1 - (percent / 100) ** rows) ** bands <= N.MISSED
    # pairs at the threshold: the share whose sketches differ in too many bits
    rng = np.random.default_rng(9)
    for percent in (80, 85):
        most, wrong = N.max_differing_bits(N.sketch_floor(percent)), 0
        for _ in range(300):
            n = 1000
            common = int(2 * n * percent / (100 + percent))
            both = rng.integers(1, 2**63, 2 * n - common, dtype=np.int64).astype(np.uint64)
            a, b = np.sort(both[:n]), np.sort(both[n - common :])
            packed = N.sketches(N.minhashes([a, b])).view(np.uint64)
            wrong += int(np.bitwise_count(packed[0] ^ packed[1]).sum()) > most
        assert wrong == 0
