import datetime as dt
import random

from pyspark.sql import functions as F

from tallyloom.operators import catalog as C
from tallyloom.operators import ingest as I
from tallyloom.operators import lookup as L
from tallyloom.operators import resolve as R
from tallyloom.operators import windows as W
from tallyloom.operators.intervals import met_elsewhere
from tallyloom.sources import readers as S
from tallyloom.streaming.availability import activity_by_window, restocks


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_lowest_flag_keeps_ties_and_leaves_sold_out(spark):
    df = spark.createDataFrame([(1, 5.0, True), (1, 5.0, True), (1, 3.0, False), (2, None, True)], "p int, price double, ok boolean")
    got = C.flag_lowest(df, "p", F.col("price"), F.col("ok")).collect()
    assert sorted((r["p"], r["lowest"]) for r in got) == [(1, False), (1, True), (1, True), (2, False)]


def test_upsert_overwrites_nulls_and_fills(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k int, fill string, over string")
    new = spark.createDataFrame([(2, "n", None), (3, "m", "z"), (4, "q", "no")], "k int, fill string, over string")
    got = I.upsert(old, new, ["k"], overwrite=("over",), fill=("fill",), insert_if=F.col("k") < 4)
    assert rows(got) == {(1, "a", "x", "kept"), (2, "n", None, "updated"), (3, "m", "z", "created")}


def test_guards_and_manual_rows(spark):
    old = spark.createDataFrame([(i, True) for i in range(10)], "k int, active boolean")
    few, enough = (spark.createDataFrame([(i,) for i in range(n)], "k int") for n in (3, 6))
    active = lambda df: sum(r["active"] for r in df.collect())
    assert active(I.deactivate_missing(old, few, "k")) == 10 and active(I.deactivate_missing(old, enough, "k")) == 6
    assert active(I.deactivate_missing(old, few.filter("k < 0"), "k")) == 10
    base = spark.createDataFrame([(1, "manual"), (2, "wiki"), (3, "forum")], "k int, s string")
    fresh = spark.createDataFrame([(1, "wiki"), (5, "wiki")], "k int, s string")
    assert rows(I.replace_own(base, fresh, "s", "wiki", ["k"])) == {(1, "manual"), (3, "forum"), (5, "wiki")}


def test_signals_fold_in_order(spark):
    d = dt.date
    events = spark.createDataFrame([("a", None), ("b", d(2024, 1, 1)), ("c", None)], "k string, date date")
    signals = spark.createDataFrame([("a", 2, d(2024, 2, 3)), ("a", 1, d(2024, 2, 2)), ("a", 3, d(2024, 2, 2)), ("b", 1, d(2024, 1, 1))], "k string, seq int, date date")
    assert rows(I.fold_signals(events, signals, "k")) == {("a", d(2024, 2, 2), 1, 1, 1), ("b", d(2024, 1, 1), 0, 1, 0), ("c", None, 0, 0, 0)}


def test_maps_topics_and_states(spark):
    df = spark.range(1).select(I.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m"))
    assert df.collect()[0]["m"] == {"a": 1, "b": 3}
    t = spark.range(1).select(I.merge_topics(F.array(F.lit("b")), F.array(F.lit("a"))).alias("x"), I.merge_topics(F.lit(None).cast("array<string>"), F.array(F.lit("a"))).alias("y")).collect()[0]
    assert t["x"] == ["a", "b"] and t["y"] is None


def test_lookups(spark):
    left = spark.createDataFrame([(1, "Ako"), (2, "ako (dress)"), (3, "none")], "id int, name string")
    masters = spark.createDataFrame([(10, "Ako"), (11, "dress ako")], "id int, name string")
    base = F.regexp_replace(F.lower("name"), r" ?\(.*\)|dress ", "")
    got = L.tiered_lookup(left, "id", masters, "id", [(F.col("name"), F.col("name"), False), (base, base, True)])
    assert rows(got) == {(1, 10, 1), (2, None, None), (3, None, None)}
    d = dt.date
    spans = spark.createDataFrame([(1, "x", "s1", d(2024, 1, 1), d(2024, 1, 30)), (2, "x", "s2", d(2024, 1, 30), d(2024, 2, 2)), (3, "x", "s1", d(2024, 3, 1), d(2024, 3, 2))], "id int, kind string, src string, a date, b date")
    assert {r["id"] for r in met_elsewhere(spans, "id", "kind", "src", "a", "b").collect()} == {1, 2}
    assert met_elsewhere(spans.union(spans.filter("id = 1")), "id", "kind", "src", "a", "b").count() == 3  # repeated rows stay
    seasons = spark.createDataFrame([(7, 1, d(2024, 1, 1), d(2024, 1, 31), "n"), (8, 2, d(2024, 1, 20), d(2024, 2, 10), "m")], "season int, number int, starts date, ends date, name string")
    asked = spark.createDataFrame([("p", 2, d(2020, 1, 1), d(2020, 1, 2), "z"), ("q", 9, d(2024, 1, 25), d(2024, 1, 26), "m"), ("r", 9, d(2024, 1, 25), d(2024, 1, 26), "z")], "r string, number int, starts date, ends date, name string")
    assert rows(L.season_match(asked, seasons, "r")) == {("p", 8), ("q", 8), ("r", 7)}


def test_windows(spark):
    d = dt.date
    days = spark.createDataFrame([("u", d(2024, 1, 1)), ("u", d(2024, 1, 2)), ("u", d(2024, 1, 2)), ("u", d(2024, 1, 4))], "u string, day date")
    assert rows(W.date_runs(days, ["u"], "day")) == {("u", d(2024, 1, 1), d(2024, 1, 2), 2), ("u", d(2024, 1, 4), d(2024, 1, 4), 1)}


def test_clusters_are_a_partition_whatever_the_order(spark):
    edges = [(1, 2), (2, 3), (3, 9), (10, 11), (12, 10), (20, 21)]
    for pairs in (edges, [(b, a) for a, b in reversed(edges)]):
        assert rows(R.clusters(spark.createDataFrame(pairs, "a long, b long"))) == {(1, 1), (2, 1), (3, 1), (9, 1), (10, 10), (11, 10), (12, 10), (20, 20), (21, 20)}


def test_clusters_of_a_long_path_of_random_ids_are_whole(spark):
    ids = list(range(1000))
    random.Random(5).shuffle(ids)
    path = spark.createDataFrame(list(zip(ids[1:], ids[:-1], strict=True)), "a long, b long")
    assert rows(R.clusters(path)) == {(i, 0) for i in ids}


def test_absorb_needs_an_only_work(spark):
    df = spark.createDataFrame([(1, "k", "w"), (2, "k", None), (3, "m", "a"), (4, "m", "b"), (5, "m", None)], "id int, base string, work string")
    assert {(r["id"], r["bundle"]) for r in R.absorb(df, "base", "work").collect()} == {(1, "k#w"), (2, "k#w"), (3, "m#a"), (4, "m#b"), (5, "m#-")}


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "t", "day": "2024-01-01"}, {"title": ""}, {"day": "x"}]')
    good, bad = S.read_json_list(spark, str(tmp_path), "title string, day string", ["title", "day"])
    assert good.count() == 1 and bad.count() == 2
    feed = spark.createDataFrame([("u", "<rss><item><title><![CDATA[a & b]]></title><link>l</link><pubDate>p</pubDate></item><item><title>c</title></item></rss>")], "url string, body string")
    assert rows(S.feed_items(feed, "body")) == {("u", "a & b", "l", "p"), ("u", "c", "", "")}
    page = spark.createDataFrame([("u", "<table><tr><th>Code</th><th>Reward</th></tr><tr><td>ABC1</td><td>gold <b>x2</b></td></tr></table>")], "url string, html string")
    got = S.table_rows(page, "html", {"code": ["code"], "reward": ["reward", "item"]}).collect()
    assert [r["row"] for r in got] == [{"code": "ABC1", "reward": "gold x2"}]
    n = spark.createDataFrame([('[{"a": 1}, {"a": 2}]',), ('{"data": [{"a": 1}]}',), ('{"a": 1}',), ("broken",)], "j string").select(F.size(S.json_objects(F.col("j"))))
    assert [r[0] for r in n.collect()] == [2, 1, 1, 0]
    html = '<script type="application/ld+json">{"@type": "Event", "name": "n"}</script><script type="application/ld+json">{"@type": "Other"}</script>'
    assert spark.range(1).select(F.size(S.json_ld(F.lit(html), "Event"))).collect()[0][0] == 1
    assert spark.range(1).select(S.tab_blocks(F.lit("a\t1\nbad\nb\t2"), ["n", "v"]).alias("t")).collect()[0]["t"] == [("a", "1"), ("b", "2")]


def test_streams(spark, tmp_path):
    snaps = [[(1, 1, False), (2, 1, True)], [(1, 2, True), (2, 2, False)], [(2, 3, True), (1, 3, True)]]
    for i, batch in enumerate(snaps):
        spark.createDataFrame(batch, "offer long, seq long, available boolean").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    source = spark.readStream.schema("offer long, seq long, available boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    q = restocks(source).writeStream.format("memory").queryName("restocks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("restocks")) == {(1, 2), (2, 3)}
    events = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 05:00:00")], "event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    q = activity_by_window(stream).writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["event_type"], r["n"]) for r in spark.table("activity").collect()} == {("a", 2), ("b", 1)}


def test_duplicates_notices_and_owners(spark):
    d = dt.date
    old = spark.createDataFrame([(1, d(2024, 1, 1), ["aimer", "tour"], []), (2, d(2024, 1, 2), ["x"], ["l2"])], "id int, day date, toks array<string>, links array<string>")
    new = spark.createDataFrame([(8, d(2024, 1, 1), ["aimer"], ["l8"]), (9, d(2024, 1, 3), ["aimer"], ["l9"])], "id int, day date, toks array<string>, links array<string>")
    filled, fresh = I.attach_duplicates(old, new, ["day"], "id", "toks", "links")
    assert {(r["id"], tuple(r["links"])) for r in filled.collect()} == {(1, ("l8",)), (2, ("l2",))} and {r["id"] for r in fresh.collect()} == {9}
    assert rows(I.not_yet_told(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int"), ["k"])) == {(1,)}
    f = spark.createDataFrame([("a", None, "s1", "s1"), ("a", "b", "s1", "s2"), (None, "b", None, "s2")], "o string, n string, own string, src string")
    got = f.select(I.owned_overwrite(F.col("o"), F.col("n"), F.col("own"), F.col("src"), F.lit(True)).alias("x")).collect()
    assert [r["x"] for r in got] == [None, "a", "b"]
    kept = I.delete_missing_of_seen(spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "g string, k int"), spark.createDataFrame([("g", 1)], "g string, k int"), "g", ["k"])
    assert rows(kept) == {("g", 1), ("h", 3)}


def test_sinks(spark, tmp_path):
    import pytest
    from tallyloom.sources.sinks import current_table, json_rows, replace_table, versioned_export

    df = spark.createDataFrame([("u", 2, None), ("u", 1, "x")], "user string, id int, note string")
    assert {r[0] for r in json_rows(df).collect()} == {'{"user":"u","id":2,"note":null}', '{"user":"u","id":1,"note":"x"}'}
    assert versioned_export(df, ["user"], 3).collect()[0]["document"] == '{"version":3,"entries":[{"id":1,"note":"x"},{"id":2}]}'
    path = f"{tmp_path}/t"
    assert replace_table(df, path) == 1 and replace_table(df.filter("id = 1"), path) == 2
    assert current_table(spark, path).count() == 1
    with pytest.raises(ValueError, match="empty"):
        replace_table(df.filter("id = 9"), path)
    assert current_table(spark, path).count() == 1


def test_matching(spark):
    from tallyloom.operators import matching as M

    texts = spark.createDataFrame([(1, "Meet HOSHINO today"), (2, "raid of the week"), (3, "nothing"), (4, None), (5, "ho")], "id int, t string")
    names = spark.createDataFrame([(10, "Shiroko", False), (11, "Hoshino", False), (12, "Kuro", True)], "boss int, name string, active boolean")
    assert rows(M.names_in_texts(texts, "id", "t", names, "boss", "name")) == {(1, 11)}
    got = M.named_or_current(texts, "id", "t", names, "boss", "name", [F.asc("boss")], F.col("active"), ["raid"])
    assert rows(got) == {(1, 11, 1), (2, 12, 2), (3, None, None), (4, None, None), (5, None, None)}
    bits = spark.createDataFrame([(1, "a", 0), (2, "a", 0b111), (3, "a", -1), (4, "b", 0), (5, "a", 1 << 63 - 1), (6, "a", 0b1111)], "id int, b string, bits long")
    assert rows(M.hashed_pairs(bits, ["b"], "id", "bits", 3)) == {(1, 2, 3), (1, 5, 1), (2, 6, 1)}


def test_hashed_pairs_against_all_pairs(spark):
    import random

    from tallyloom.operators import matching as M

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(6)]
    bits = []
    for i in range(150):
        x = base[i % 6]
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(63)
        bits.append((i, i % 2, x))
    got = {tuple(r)[:2] for r in M.hashed_pairs(spark.createDataFrame(bits, "id int, b int, bits long"), ["b"], "id", "bits", 7).collect()}
    assert got == {(i, j) for i, b, x in bits for j, c, y in bits if i < j and b == c and (x ^ y).bit_count() <= 7} and got


def test_block_pairs_are_all_pairs(spark):
    from tallyloom.operators import resolve as R

    df = spark.createDataFrame([(i, i % 3) for i in range(40)], "id int, b int")
    got = [tuple(r) for r in R.block_pairs(df, "b", "id", F.lit(True), parts=4).select(F.col("l.id"), F.col("r.id")).collect()]
    assert sorted(got) == sorted((i, j) for i in range(40) for j in range(i + 1, 40) if i % 3 == j % 3)


def test_streamed_restocks_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(11)
    turns = [(rng.randrange(9), seq, rng.random() < 0.5) for seq in range(300)]
    schema = "offer long, seq long, available boolean"
    for part in range(5):  # five batches, in order
        spark.createDataFrame(turns[60 * part : 60 * part + 60], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = restocks(stream).writeStream.format("memory").queryName("restocked").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    batch = W.transitions(spark.createDataFrame(turns, schema), ["offer"], ["seq"], F.col("available")).select("offer", "seq")
    assert rows(spark.table("restocked")) == rows(batch) and batch.count() > 20


def test_sources_fail_by_themselves(spark):
    bad = lambda: spark.range(3).select(F.raise_error(F.lit("down")).cast("long").alias("id"))

    def refuses(**_):
        raise OSError("no route")

    registry = {"range": lambda n: spark.range(n), "bad": bad, "refuses": refuses}
    specs = [{"driver": "range", "source": "b", "n": 2}, {"driver": "bad"}, {"driver": "range", "source": "a", "main": True, "n": 1}, {"driver": "range", "source": "none", "n": 0}, {"driver": "?"}, {"driver": "refuses", "x": 1}]
    got, report = S.run_sources(registry, specs)
    assert rows(got) == {(0, "a", 1), (0, "b", 2), (1, "b", 2)}
    assert [(r["source"], r["outcome"].split(":")[0]) for r in report] == [("a", "read"), ("b", "read"), ("bad", "failed"), ("none", "empty"), ("?", "no driver '?'"), ("refuses", "failed")]
    assert S.run_sources(registry, specs[4:])[0] is None
