import datetime as dt

from pyspark.sql import functions as F

from tallyloom.functions import dates as D
from tallyloom.functions import predicates as P
from tallyloom.functions import text as T
from tallyloom.functions import vectors as V


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).collect()[0]["x"]


def test_search_terms_and_blanks(spark):
    assert P.expand_search(["blue", "archive", "figure"], {"blue archive": ["BA"]}) == [["blue archive", "BA"], ["figure"]]
    assert len(P.expand_search([str(i) for i in range(20)], {})) == 8
    test = P.matches_all([["neko para"]], [F.col("title")])
    assert one(spark, test, title="Nekopara Figure") and not one(spark, test, title="Neko")


def test_predicates(spark):
    assert one(spark, P.is_chatter(F.col("t"), ["news"]), t="when is it?? ~") and not one(spark, P.is_chatter(F.col("t"), ["news"]), t="guide")
    assert one(spark, P.access_decision(F.lit("10.0.0.5"), ["10.0.0.0/24"], ["10.0.0.0/8"])) == "allow"
    assert one(spark, P.access_decision(F.lit("10.9.0.5"), ["10.0.0.0/24"], ["10.0.0.0/8"])) == "block"
    assert one(spark, P.access_decision(F.lit("nonsense"), ["10.0.0.0/24"], ["10.0.0.0/8"])) == "pass"
    assert one(spark, P.looks_like_attack(F.lit("/x?q=%252e%252e%252fetc"), ["../"]))
    assert one(spark, P.contains_all(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))))
    assert one(spark, P.keep_filled(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("")))) == {"a": "1"}


def test_titles(spark):
    norm = T.normalise_title(F.col("t"), r"\[[^\]]*\]", [("nendo", "nendoroid")])
    assert one(spark, norm, t="[Pre] Nendo  Miku-Ver. 2") == "nendoroid miku ver 2"
    assert one(spark, norm, t="[X] ab") == "[x] ab"
    assert one(spark, T.scale_of(F.lit("figure 1/7 scale"))) == 7 and one(spark, T.scale_of(F.lit("11/70"))) is None
    known = ["Challenge 01", "Challenge 12", "Challenge EX"]
    assert one(spark, T.stage_labels(F.lit("CHALLENGE 1, chal.ex challenge - 12 challenge 007"), known)) == ["Challenge 01", "Challenge EX", "Challenge 12"]
    assert one(spark, T.recovered_field(F.lit('{"reply": "hi \\"you\\"", bad'), "reply")) == 'hi \\"you\\"'
    assert one(spark, T.absolute_url(F.lit("/a/b"), "https://x.org/c/d")) == "https://x.org/a/b"
    assert one(spark, T.video_id(F.lit("https://youtu.be/abcdefghijk?t=1"))) == "abcdefghijk"
    assert one(spark, T.device_class(F.lit(None).cast("string"))) == "pc"
    assert one(spark, T.html_text(F.lit("<p>a&amp;b<script>x</script></p> c"))) == "a&b c"


def test_token_rules():
    assert T.token_difference(["archive", "x", "blue"], ["bluearchive", "y"]) == (1, ["x"], ["y"])
    assert T.similar_words(["a", "b", "awaken"], ["a", "b", "awakes"], 2) and not T.similar_words(["a", "b", "awaken", "z"], ["a", "b", "awakes"], 2)
    assert not T.similar_words(["a", "b"], ["a", "b", "swimsuitver"], 2, frozenset(["swimsuit"])) and T.similar_words(["a", "b"], ["a", "b", "c"], 2)
    assert T.conflicting_words(["asuna"], ["shiroko"]) and not T.conflicting_words(["asuna"], []) and not T.conflicting_words(["asuna"], ["asuma"])
    assert T.word_variant("aris", "arisu") and T.word_variant("ver", "verb", frozenset(["ver"])) and not T.word_variant("vera", "vex", frozenset(["ver"]))


def test_mentions_claim_the_longest(spark):
    df = spark.createDataFrame([("Hina and Aruna, not xAru, Aru",), (None,)], "t string")
    assert [r[0] for r in df.select(T.mentions(F.col("t"), ["Aru", "Aruna", "Hina"])).collect()] == [["Hina", "Aruna", "Aru"], []]


def test_years(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, D.year_of_event(day("2024-11-20"), F.lit(1), F.lit(5))) == dt.date(2025, 1, 5)
    assert one(spark, D.year_by_half(day("2024-11-20"), F.lit(5), F.lit(5))) == dt.date(2024, 5, 5)
    assert one(spark, D.year_by_half(day("2024-11-20"), F.lit(4), F.lit(5))) == dt.date(2025, 4, 5)
    assert one(spark, D.ticket_date(day("2024-02-01"), F.lit(12), F.lit(1))) == dt.date(2023, 12, 1)
    assert one(spark, D.safe_date(F.lit(2023), F.lit(2), F.lit(30))) is None
    assert one(spark, D.range_end(day("2024-12-20"), day("2024-01-05"))) == dt.date(2025, 1, 5)
    assert one(spark, D.release_month(F.lit("25년 8월 - 10월"))) == dt.date(2025, 8, 1) and one(spark, D.release_month(F.lit("2025.13"))) is None
    assert one(spark, D.release_month(F.lit("2026 / 11"), ["due"])) is None and one(spark, D.release_month(F.lit("due 2026 / 11"), ["due"])) == dt.date(2026, 11, 1)


def test_vectors(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert abs(one(spark, V.cosine(arr(1, 0, 9), arr(1, 0))) - 1) < 1e-12 and one(spark, V.cosine(arr(0, 0), arr(1, 1))) == 0
    assert one(spark, V.hamming_hex(F.lit("f" * 16), F.lit("0" * 16))) == 64 and one(spark, V.hamming_hex(F.lit("00000000000000ff"), F.lit("0" * 16))) == 8
    assert one(spark, V.hamming_hex(F.lit("zz"), F.lit("0" * 16))) == 64
    assert one(spark, V.converted(F.lit(10.0), F.lit(None).cast("double"))) is None and one(spark, V.converted(F.lit(10.0), F.lit(None).cast("double"), "one")) == 10.0


def test_codes_and_names(spark):
    assert one(spark, T.code_after(F.lit("Coupon code: ABC123 now"), ["coupon code", "Coupon code"])) == "ABC123"
    assert one(spark, T.text_between(F.lit("Reward: gold x2 Period: May"), "Reward", "Period")) == "gold x2"
    assert one(spark, T.code_candidates(F.lit("use UNBREAKABLE MEMORIES or GIFT77, not COUPON EVENTS; gift77"), ["COUPON"])) == ["UNBREAKABLEMEMORIES", "GIFT77", "EVENTS"]
    assert one(spark, T.artist_name(F.lit("Some Big Band LIVE 2024"), ["live"])) == "Some Big Band" and one(spark, T.artist_name(F.lit("a b c d e"), ["live"])) == "a b c d"
    rewards = F.array(F.struct(F.lit("gold").alias("name"), F.lit(2).alias("count")), F.struct(F.lit("key").alias("name"), F.lit(None).cast("int").alias("count")))
    assert one(spark, T.reward_text(rewards)) == "gold x2, key"
    assert one(spark, T.summary_line({"hp": F.lit(5), "none": F.lit(None).cast("string"), "role": F.lit("tank")})) == "hp 5 · role tank"
    assert one(spark, T.translated(F.lit("fire"), {"fire": "red"})) == "red" and one(spark, T.translated(F.lit("x"), {"fire": "red"})) == "x"
    assert one(spark, T.filled("/i/{id}.png?v={v}", {"id": F.lit(7), "v": F.lit(None).cast("string")})) == "/i/7.png?v="
    assert one(spark, T.truncated(F.lit("abcdef"), 4, True)) == "abc…" and one(spark, T.truncated(F.lit("abcdef"), 4)) == "abcd"
    assert one(spark, T.alias_code(F.lit("Blue Archive news"), {"ba": ["blue archive"], "gi": ["genshin"]})) == "ba"


def test_more_dates(spark):
    ts = lambda s: F.to_timestamp_ntz(F.lit(s))
    assert one(spark, D.release_date(F.lit("Release: 14 August 2025"))) == dt.date(2025, 8, 14)
    assert one(spark, D.release_date(F.lit("Sep 2025"))) == dt.date(2025, 9, 1) and one(spark, D.release_date(F.lit("soon"))) is None
    assert one(spark, D.expiry_by_post(F.lit("2024-12-20").cast("date"), F.lit(1), F.lit(3))) == dt.datetime(2025, 1, 3, 23, 59, 59)
    assert one(spark, D.mentioned_dates(F.lit("2024-02-30, 2024.3.1 and 2024/03/01"))) == [dt.date(2024, 3, 1)]
    days = F.array(F.lit("2024-05-01").cast("date"))
    assert one(spark, D.trusted_announcement(ts("2024-05-01 10:00:00"), days)) is None and one(spark, D.trusted_announcement(ts("9999-01-01 00:00:00"), days)) is None
    assert not one(spark, D.time_known(ts("2024-05-02 12:00:00"))) and one(spark, D.time_known(ts("2024-05-02 12:30:00")))
    assert one(spark, D.human_date(ts("2025-08-14 20:00:00"))) == "Aug 14 (Thu) 8:00 PM"


def test_characters_of_html_are_decoded_once(spark):
    import html

    from tallyloom.functions import text as T

    texts = ["a&amp;lt;b &lt;&gt;", "&#44032;&#xAC00;&#X1F600;&eacute;&nbsp;|&apos;&copy", "&bogus; &#0; &#xD800; &#99999999; &", "", "&amp;", "&hearts;x&hearts;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.decoded(F.col("t"))).collect()]
    assert got[:2] == ["a&lt;b <>", "가가😀é\xa0|'&copy"] and got[2] == texts[2] and got[3:] == [html.unescape(t) for t in texts[3:]]
    page = spark.createDataFrame([("<p>x&#33;<script>1&lt;2</script>&hellip;<b>y</b></p>",), (None,)], "t string").select(T.html_text(F.col("t"))).collect()
    assert [r[0] for r in page] == ["x! … y", None]


def test_subscriptions_keep_all_and_add(spark):
    from tallyloom.operators import ingest as I

    schema = "u int, t array<string>"
    old = spark.createDataFrame([(1, ["a"]), (2, None), (3, ["b"]), (4, ["c"])], schema)
    new = spark.createDataFrame([(1, ["b", "a"]), (2, ["a"]), (3, None), (5, ["z"]), (6, None)], schema)
    got = {r["u"]: (r["t"], r["asked_"]) for r in I.merge_subscriptions(old, new, ["u"], "t").collect()}
    assert got == {1: (["a", "b"], True), 2: (None, True), 3: (None, True), 4: (["c"], False), 5: (["z"], True), 6: (None, True)}
