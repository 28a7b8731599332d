"""Operators that hold whatever a key's size: ranks, lanes, intervals, names in texts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import intervals as I
from tallyloom.operators import lanes as L
from tallyloom.operators import matching as M
from tallyloom.operators import ranks as R
from tallyloom.plans.registry import QUERIES


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(n)


@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks_and_positions_against_windows(spark, keys):
    """Ties that cross ranges, null keys and values, one key with most rows."""
    rng = random.Random(3)
    rows = [(i % 3 if i % 7 else None, rng.choice([1.0, 2.0, None, 5.0, 5.0, 5.0]), i) for i in range(300)]
    spark.createDataFrame(rows, "k long, v double, id long").createOrReplaceTempView("scores")
    t, part = spark.table("scores"), "partition by k" if keys else ""
    want = lambda f: {tuple(r) for r in spark.sql(f"select id, cast({f} as long) from scores").collect()}
    got = R.ranks(t, keys, [("v", True)], ranges=5)
    assert {(r["id"], r["rank"]) for r in got.collect()} == want(f"rank() over ({part} order by v desc nulls last)")
    got = R.positions(t, keys, [("v", True), ("id", False)], ranges=7)
    assert {(r["id"], r["position"]) for r in got.collect()} == want(f"row_number() over ({part} order by v desc nulls last, id)")
    assert R.ranks(t.filter("id < 0"), keys, [("v", False)]).count() == 0


def test_no_window_holds_a_whole_table(spark):
    plan = QUERIES["global_rank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    alone = [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert "Window" in plan and all("HashAggregate" in line for line in alone)  # sums of ranges alone meet in one task


def lanes_by_hand(pieces):
    """The rule as it reads: several days first, then the earlier, then the longer; the first lane without an overlap."""
    out = {}
    for week in {p[0] for p in pieces}:
        lanes = []
        own = [p for p in pieces if p[0] == week]
        for p in sorted(own, key=lambda p: (not p[4], p[2], -(p[3] - p[2]).days, p[1])):
            lane = 0
            while lane < len(lanes) and any(q[2] <= p[3] and p[2] <= q[3] for q in lanes[lane]):
                lane += 1
            if lane == len(lanes):
                lanes.append([])
            lanes[lane].append(p)
            out[week, p[1]] = lane
    return out


def test_lanes_against_the_rule(spark):
    rng = random.Random(8)
    pieces = []
    for week in range(6):
        first = dt.date(2024, 1, 7) + dt.timedelta(7 * week)
        for i in range([0, 1, 25, 60, 60, 200][week]):
            a = rng.randrange(7)
            b = a if rng.random() < 0.4 else rng.randrange(a, 7)
            pieces.append((first, 1000 * week + i, first + dt.timedelta(a), first + dt.timedelta(b), a != b or rng.random() < 0.3))
    df = spark.createDataFrame(pieces, "week date, id long, piece_start date, piece_end date, several boolean").repartition(3)
    assert {(r["week"], r["id"]): r["lane"] for r in L.week_lanes(df).collect()} == lanes_by_hand(pieces)
    assert L.week_lanes(df.filter("id < 0")).count() == 0


def test_lanes_of_a_table_against_the_rule(spark):
    rows = [tuple(r) for r in QUERIES["lane_packing"](spark, "/root/testdata/sf0.001").collect()]
    assert {(r[0], r[1]): r[5] for r in rows} == lanes_by_hand(rows) and len(rows) > 1000


def spans():
    """Intervals of up to fifty years, open ones on either side, and some that end before they start."""
    rng, rows = random.Random(1), []
    for i in range(120):
        a = None if rng.random() < 0.1 else rng.randrange(-20000, 20000)
        b = None if rng.random() < 0.1 else (a or 0) + rng.choice([0, 1, 5, 30, 18250, -3])
        rows.append((i, rng.choice("xyz"), rng.choice(["s", "t", None]), None if a is None else day(a), None if b is None else day(b)))
    return [*rows, (500, "x", "s", dt.date(1, 1, 1), dt.date(9999, 12, 31)), (501, "z", "t", None, None)]


def meet(r, q):
    low, high = (lambda x: x[3] or dt.date.min), (lambda x: x[4] or dt.date.max)
    return low(r) <= high(r) and low(q) <= high(q) and low(r) <= high(q) and low(q) <= high(r)


def test_intervals_against_all_pairs(spark):
    rows = spans()
    df = spark.createDataFrame(rows, "id long, kind string, src string, a date, b date")
    want = sorted(r[0] for r in rows if any(q[1] == r[1] and r[2] and q[2] and q[2] != r[2] and meet(r, q) for q in rows))
    assert sorted(r["id"] for r in I.met_elsewhere(df, "id", "kind", "src", "a", "b").collect()) == want
    other = df.select(F.col("id").alias("other"), "kind", F.col("a").alias("c"), F.col("b").alias("d"))
    for on in (["kind"], []):
        right = other if on else other.drop("kind")
        got = [(r["id"], r["other"]) for r in I.meeting_pairs(df, ("a", "b"), right, ("c", "d"), on).collect()]
        assert sorted(got) == sorted((r[0], q[0]) for r in rows for q in rows if (not on or r[1] == q[1]) and meet(r, q))


def test_an_interval_of_any_length_has_few_keys(spark):
    rows = [(dt.date(1970, 1, 1), dt.date(1970, 1, 1)), (dt.date(1950, 5, 5), dt.date(2049, 7, 7)), (dt.date(1, 1, 1), dt.date(9999, 12, 31)), (None, None)]
    placed = I._placed(spark.createDataFrame(rows, "a date, b date"), "a", "b").select(F.size("cover_"), F.size(I.forebears(F.col("cover_")))).collect()
    assert [r[0] for r in placed][::3] == [1, 1] and max(r[0] for r in placed) <= 2 * I.LEVELS and max(r[1] for r in placed) <= 4 * I.LEVELS


def test_names_of_texts_with_and_without_spaces(spark):
    """Each text is one row with the ids of its distinct names; two names of one id count twice, and names may span words."""
    names = spark.createDataFrame([(1, "ab"), (1, "b\nc"), (2, "B C"), (3, "\u00a0x"), (4, " a"), (5, "zz")], "name_id long, name string")
    texts = [(1, "xab ab\tq"), (2, "AB\nCd b c"), (3, "q\u00a0x"), (4, " a"), (4, "ab"), (5, "y"), (6, None), (None, "bb c")]
    found = M.names_of_texts(spark.createDataFrame(texts, "id long, t string"), "id", "t", names, "name_id", "name")
    want = [(1, [1, 4]), (2, [1, 1, 2]), (3, [3]), (4, [1]), (4, [4]), (None, [2])]
    assert sorted(((r["id"], sorted(r["ids"])) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_names_in_texts_against_contains(spark):
    rng = random.Random(4)
    names = [(i, "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))) for i in range(60)] + [(100, "AB"), (101, ""), (102, None), (103, "ab")]
    texts = [(i, "".join(rng.choice("abcÉ ") for _ in range(rng.randrange(0, 30)))) for i in range(80)] + [(200, None), (201, ""), (202, "x" * 50_000 + "AB")]
    t, n = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(names, "name_id int, name string")
    want = {(i, j) for i, text in texts for j, name in names if text and name and name.lower() in text.lower()}
    for part_bytes in (1_000_000, 200):  # one automaton, and several
        got = [tuple(r) for r in M.names_in_texts(t, "id", "t", n, "name_id", "name", part_bytes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert M.names_in_texts(t, "id", "t", n.filter("name_id < 0"), "name_id", "name").count() == 0
