"""Operators whose work grows with their rows, on tables where few values hold most of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ingest as I
from tallyloom.operators import intervals as V
from tallyloom.operators import joins as J
from tallyloom.operators import lanes as L
from tallyloom.operators import matching as M
from tallyloom.plans.registry import QUERIES

HOT = 60_000  # rows of one key: its pairs would not end


def test_twins_of_a_hot_token_are_counted_not_paired(spark):
    rows = spark.range(HOT).selectExpr("id", "'s' || id % 3 AS src", "1 AS day", "array('hot', 't' || id % 2) AS toks")
    odd = spark.createDataFrame([(HOT, "s0", 1, ["t1", "x"]), (HOT + 1, None, 1, ["hot"]), (HOT + 2, "s9", 2, ["hot"]), (HOT + 3, "s0", None, ["hot"]), (HOT + 4, "s1", 1, [])], "id long, src string, day int, toks array<string>")
    got = {r["id"]: r["twins"] for r in M.twins(rows.union(odd), "id", "day", "src", "toks").collect()}
    assert len(got) == HOT + 1 and got[0] == 2 * HOT // 3 and got[1] == 2 * HOT // 3 + 1 and got[HOT] == HOT // 3


def test_sums_of_meeting_intervals_against_all_pairs(spark):
    rng = random.Random(5)
    day = lambda n: None if n is None else dt.date(2000, 1, 1) + dt.timedelta(n)
    span = lambda: (rng.choice([None, *range(60)]), rng.choice([None, *range(60)]))
    a, b = [(i, *span()) for i in range(80)], [(100 + i, *span()) for i in range(80)]
    fine = lambda r: (r[1] if r[1] is not None else -(10**6)) <= (r[2] if r[2] is not None else 10**6)
    low, high = (lambda r: -(10**6) if r[1] is None else r[1]), (lambda r: 10**6 if r[2] is None else r[2])
    want = {}
    for x in a:
        met = [y[0] for y in b if fine(x) and fine(y) and low(y) <= high(x) and low(x) <= high(y)]
        if met:
            want[x[0]] = (len(met), min(met))
    frame = lambda rows, k, s, e: spark.createDataFrame([(i, day(p), day(q)) for i, p, q in rows], f"{k} int, {s} date, {e} date")
    got = V.meeting_sums(frame(a, "id", "p", "q"), ("p", "q"), frame(b, "other", "r", "s"), ("r", "s"), F.col("other"))
    assert {r["id"]: (r["met"], r["least"]) for r in got.collect()} == want
    many = spark.range(HOT).selectExpr("id", "date'2000-01-01' AS p", "date'2000-03-01' AS q")
    got = V.meeting_sums(many, ("p", "q"), many, ("p", "q"), F.col("id")).select("met", "least").distinct().collect()
    assert [tuple(r) for r in got] == [(HOT, 0)]


def test_rows_with_the_same_words_are_one_class(spark):
    rows = spark.range(HOT).selectExpr("id", "1 AS b", "array('a', 'b', 'c') AS toks")
    products = spark.range(HOT).selectExpr("id AS product", "1 AS b", "array('a', 'b', if(id % 2 = 0, 'x1', 'c')) AS toks")
    got = M.fuzzy_best(rows, products, ["b"], "id", "product", "toks", 2).groupBy("product", "shared").count().collect()
    assert [tuple(r) for r in got] == [(1, 3, HOT)]


def test_clusters_of_hashes_against_all_pairs(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, rng.choice("xy"), rng.choice(centres) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)), rng.choice([["a", "b"], ["a", "c"], ["a"]])) for i in range(150)]
    from tallyloom.functions.text import conflicting_words

    reach = {r[0]: r[0] for r in rows}
    linked = set()
    pairs = [(r[0], q[0]) for r in rows for q in rows if r[0] < q[0] and r[1] == q[1] and (r[2] ^ q[2]).bit_count() <= 3 and not conflicting_words(r[3], q[3])]
    for _ in rows:
        for a, b in pairs:
            linked |= {a, b}
            reach[a] = reach[b] = min(reach[a], reach[b])
    df = spark.createDataFrame(rows, "id long, b string, bits long, toks array<string>")
    for dealt in (1024, 4):
        got = {r["node"]: r["cluster"] for r in M.hashed_clusters(df, ["b"], "id", "bits", "toks", 3, dealt=dealt).collect()}
        assert got == {k: reach[k] for k in linked}
    hot = spark.range(HOT).selectExpr("id", "1 AS b", "7L AS bits", "array('a') AS toks")
    assert [tuple(r) for r in M.hashed_clusters(hot, ["b"], "id", "bits", "toks", 3).groupBy("cluster").count().collect()] == [(0, HOT)]


def test_lists_of_groups_are_made_once(spark):
    plan = QUERIES["substitutes_attached"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "transform" not in plan  # rows take their group's list as it is


@pytest.mark.parametrize("small", [True, False])
def test_lists_of_groups_are_written_once_a_file(spark, tmp_path, monkeypatch, small):
    """Rows of 8,000 groups in no order: their lists, 1.4 MB in all, are 35 MB if each row has its own."""
    if not small:
        monkeypatch.setattr(J, "is_small", lambda *_: False)
    part = spark.range(200_000).selectExpr("id * 7919 % 200000 AS p_partkey", "'b' || id % 8000 AS p_brand", "'t' AS p_type", "double(id % 3) AS p_retailprice")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["substitutes_attached"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 5_000_000
    want = {}
    for i in range(200_000):
        want.setdefault(i % 8000, []).append((-(i % 3), i * 7919 % 200_000))
    want = {k: (ids, ",".join(map(str, ids))) for ids in ([k for _, k in sorted(v)] for v in want.values()) for k in ids}
    got = {r["p_partkey"]: (r["n"], r["substitutes"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: (len(ids), text) for k, (ids, text) in want.items()}


def test_duplicates_of_a_hot_token_make_no_pairs(spark):
    old = spark.range(HOT).selectExpr("id", "1 AS day", "array('hot') AS toks", "cast(array() AS array<string>) AS links")
    new = spark.range(HOT, 2 * HOT).selectExpr("id", "1 AS day", "array('hot', 'x') AS toks", "array('l' || id) AS links")
    filled, fresh = I.attach_duplicates(old, new, ["day"], "id", "toks", "links")
    assert fresh.count() == 0 and [tuple(r) for r in filled.filter("size(links) > 0").select("id", "links").collect()] == [(0, [f"l{HOT}"])]


def test_rows_met_elsewhere_are_neither_exploded_nor_paired(spark):
    rows = spark.range(HOT).selectExpr("id", "'k' AS kind", "if(id = 5, 't', 's') AS src", "date_add(date'2000-01-01', int(id % 400)) AS p", "date_add(date'2000-01-01', int(id % 400 + 50)) AS q")
    got = V.met_elsewhere(rows, "id", "kind", "src", "p", "q")
    want = {i for i in range(HOT) if i == 5 or (i % 400 <= 55)}
    assert {r["id"] for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lanes_without_a_shuffle_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(L, "RANGE_BITS", 3)
    first = dt.date(2024, 1, 7)
    pieces = [(first, i, first, first + dt.timedelta(i % 7), True) for i in range(200)]
    df = spark.createDataFrame(pieces, "week date, id long, piece_start date, piece_end date, several boolean").repartition(3)
    lanes = L.week_lanes(df)
    assert sorted(r["lane"] for r in lanes.filter("piece_end > '2024-01-12'").collect()) == list(range(28))
    plan = lanes._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("Generate") and "Exchange" not in plan[plan.index("Window") : plan.index("Generate")]


def test_plain_tables_are_read_as_the_parser_reads_them():
    from tallyloom.sources import readers

    rng = random.Random(4)
    parts = ["<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", '<td class="x">', "</table>", "<table>", "<b>", "</b>", " a ", "b\nc", "text"]
    for _ in range(3000):
        body = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        slow = readers._Tables()
        slow.feed(body)
        slow.close()
        assert readers._PLAIN.fullmatch(body) and readers._plain_rows(body) == slow.rows, body
    assert not any(readers._PLAIN.fullmatch(b) for b in ("a &amp; b", "<!-- x -->", "<script>", "a < b", "<TD>", "<td a='b'>", "<td", "<textarea>"))
