"""Further lookups, groups, filters and texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import dates as D
from tallyloom.functions import predicates as P
from tallyloom.functions import text as T
from tallyloom.operators import ingest as I
from tallyloom.operators import matching as M
from tallyloom.operators import windows as O
from tallyloom.operators.catalog import best_per
from tallyloom.plans.base import query, rule
from tallyloom.sources.tables import table

_ASKED = "CASE event_id % 8 WHEN 0 THEN 'NATION_' || (event_id % 25) WHEN 1 THEN ' nation :_' || (event_id % 25) || ' ' WHEN 2 THEN 'Nation_' || (event_id % 25) || ' (summer)' WHEN 3 THEN 'al' || (event_id % 6) WHEN 4 THEN 'nation_2' || (event_id % 7) || 'x' WHEN 5 THEN 'the NATION_' || (event_id % 25) || ' guide' WHEN 6 THEN 'NATIO' ELSE '' END"


@query(
    "named_by_tiers",
    rf"""
WITH e AS (SELECT event_id, {_ASKED} AS asked FROM events),
k AS (SELECT *, lower(regexp_replace(trim(asked), '[\s:：]+', '', 'g')) AS k, lower(regexp_replace(trim(regexp_replace(asked, '\(.*\)', '', 'g')), '[\s:：]+', '', 'g')) AS bare FROM e),
n AS (SELECT n_nationkey AS id, n_name, lower(n_name) AS nk FROM nation),
a AS (SELECT 'al' || i AS alias, i AS id FROM range(4) t(i)),
p AS (SELECT event_id, min(id) AS id FROM k JOIN n ON length(k.k) >= 3 AND starts_with(nk, k.k) GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT event_id, min(id) AS id FROM k JOIN n ON contains(lower(asked), nk) GROUP BY 1 HAVING count(*) = 1)
SELECT k.event_id, coalesce(x.id, y.id, z.id, a.id, p.id, c.id) AS id,
       CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN y.id IS NOT NULL THEN 'key' WHEN z.id IS NOT NULL THEN 'bare' WHEN a.id IS NOT NULL THEN 'alias' WHEN p.id IS NOT NULL THEN 'prefix' WHEN c.id IS NOT NULL THEN 'within' END AS by
FROM k LEFT JOIN n x ON x.n_name = k.asked LEFT JOIN n y ON y.nk = k.k LEFT JOIN n z ON z.nk = k.bare LEFT JOIN a ON a.alias = k.k LEFT JOIN p ON p.event_id = k.event_id LEFT JOIN c ON c.event_id = k.event_id
""",
)
def named_by_tiers(spark, d):
    """Names by exact match, key, key without brackets, alias, unique prefix, or the only name within."""
    asked = table(spark, d, "events").select("event_id", F.expr(_ASKED).alias("asked"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    aliases = spark.range(4).select(F.concat(F.lit("al"), F.col("id").cast("string")).alias("alias"), "id")
    return M.tiers_of_names(asked, "event_id", "asked", names, "id", "name", aliases)


@query(
    "verification_targets",
    """
WITH c AS (SELECT user_id % 5 AS game, user_id, event_id % 10 AS code, count(DISTINCT event_type) AS sources, bool_or(event_type = 'purchase') AS confirmed, max(ts) AS newest, max(ts) + INTERVAL 3 DAY > TIMESTAMP '2024-01-20' AS usable FROM events GROUP BY ALL)
SELECT game, user_id, code FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY newest DESC, user_id, code) AS nth FROM c WHERE usable AND NOT confirmed AND sources < 2) WHERE nth <= 20
""",
)
def verification_targets(spark, d):
    """Usable, unconfirmed codes of fewer than two sources, the newest twenty of each game (the cut is the feature)."""
    e = table(spark, d, "events").withColumns({"game": F.col("user_id") % 5, "code": F.col("event_id") % 10})
    codes = e.groupBy("game", "user_id", "code").agg(F.countDistinct("event_type").alias("sources"), F.bool_or(F.col("event_type") == "purchase").alias("confirmed"), F.max("ts").alias("newest"))
    open_ = codes.filter(P.is_usable(F.col("newest") + F.expr("interval 3 days"), F.lit("2024-01-20").cast("timestamp_ntz")) & ~F.col("confirmed") & (F.col("sources") < 2))
    return O.top_per(open_, ["game"], [F.desc("newest"), F.asc("user_id"), F.asc("code")], 20, "nth").select("game", "user_id", "code")


@query(
    "known_votes",
    "SELECT user_id, event_type AS mode, n AS votes FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1",
)
def known_votes(spark, d):
    """The commonest value of a closed vocabulary; values outside it have no vote."""
    words = spark.createDataFrame([("view",), ("click",), ("signup",)], "event_type string")
    known = table(spark, d, "events").join(F.broadcast(words), "event_type", "left_semi")  # three words
    votes = known.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    best = votes.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "event_type", "n")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("mode"), F.col("b.n").alias("votes"))


@query(
    "nested_regions",
    """SELECT r_regionkey, '{"region":"' || r_name || '","stages":[' || coalesce(string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey), '') || ']}' AS shaped FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
)
def nested_regions(spark, d):
    """Rows shaped as nested documents: a parent with its sorted children."""
    nations = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("stages"))
    rows = table(spark, d, "region").join(nations, "r_regionkey", "left")
    stages = F.coalesce("stages", F.array().cast(nations.schema["stages"].dataType)).alias("stages")
    return rows.select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("region"), stages)).alias("shaped"))


@query(
    "block_progress",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS block, count(*) FILTER (p_size % 2 = 0) OVER (PARTITION BY p_brand) AS done FROM part",
)
def block_progress(spark, d):
    """Sizes of blocks and how many of each are done."""
    block = W.partitionBy("p_brand")
    return table(spark, d, "part").select("p_partkey", F.count("*").over(block).alias("block"), F.count_if(F.col("p_size") % 2 == 0).over(block).alias("done"))


@rule(
    "title_tokens",
    "part",
    "p_partkey",
    {"title": "CASE p_partkey % 3 WHEN 0 THEN p_name ELSE 'new ' || p_size || ' ' || split_part(p_name, ' ', 1) END", "fallback": "CASE WHEN p_partkey % 2 = 0 THEN 'toys' END"},
    {
        "primary_": "array_to_string(list_sort(list_distinct(list_filter(string_split(title, ' '), lambda t: t NOT IN ('new', 'old') AND NOT regexp_full_match(t, '[0-9]+')))), ' ')",
        "signature": "CASE WHEN len(list_distinct(list_filter(string_split(title, ' '), lambda t: t NOT IN ('new', 'old') AND NOT regexp_full_match(t, '[0-9]+')))) >= 2 THEN array_to_string(list_sort(list_distinct(list_filter(string_split(title, ' '), lambda t: t NOT IN ('new', 'old') AND NOT regexp_full_match(t, '[0-9]+')))), ' ') ELSE '' END",
        "category": "CASE WHEN contains(title, 'ring') THEN 'jewel' WHEN contains(title, 'gear') OR contains(title, 'bolt') THEN 'part' ELSE coalesce(fallback, 'other') END",
    },
)
def title_tokens(title, fallback):
    """Primary tokens keep a single one, signature tokens don't; categories by first keyword, fallback, or other."""
    tokens = F.array_sort(T.distinctive_tokens(title, ["new", "old"]))
    return {
        "primary_": F.array_join(tokens, " "),
        "signature": F.when(F.size(tokens) >= 2, F.array_join(tokens, " ")).otherwise(""),
        "category": F.coalesce(T.first_hit(title, [("ring", "jewel"), ("gear", "part"), ("bolt", "part")]), fallback, F.lit("other")),
    }


@rule(
    "ticket_openings",
    "orders",
    "o_orderkey",
    {"post": "CASE o_orderkey % 4 WHEN 0 THEN 'presale 3/' || (1 + o_orderkey % 28) || ', general 11/' || (1 + o_orderkey % 28) WHEN 1 THEN 'presale 12/24 20:00' WHEN 2 THEN 'general: 2/30' ELSE 'soon' END", "held": "CAST(o_orderdate AS DATE)"},
    {
        "opens": """CASE o_orderkey % 4
 WHEN 0 THEN CASE WHEN make_date(year(held), 11, (1 + o_orderkey % 28)::INT) > held THEN make_date(year(held) - 1, 11, (1 + o_orderkey % 28)::INT) ELSE make_date(year(held), 11, (1 + o_orderkey % 28)::INT) END
 WHEN 1 THEN CASE WHEN make_date(year(held), 12, 24) > held THEN make_date(year(held) - 1, 12, 24) ELSE make_date(year(held), 12, 24) END END"""
    },
)
def ticket_openings(post, held):
    """Ticket dates, the general sale's first; of the event's year, or the one before if that lies after the event."""
    return {"opens": D.ticket_opening(post, held, "general")}


@rule(
    "expiry_formats",
    "events",
    "event_id",
    {"said": "CASE event_id % 5 WHEN 0 THEN '2025-03-1' || (event_id % 10) || ' 10:00' WHEN 1 THEN '2025/04/0' || (1 + event_id % 9) WHEN 2 THEN '05.06.2025' WHEN 3 THEN '20250607' ELSE 'never' END"},
    {"expires": "CASE event_id % 5 WHEN 0 THEN '2025-03-1' || (event_id % 10) || ' 10:00' WHEN 1 THEN '2025-04-0' || (1 + event_id % 9) || ' 00:00' WHEN 2 THEN '2025-06-05 00:00' WHEN 3 THEN '2025-06-07 00:00' END"},
)
def expiry_formats(said):
    """Expiries by the first of several formats that reads."""
    return {"expires": F.date_format(D.first_format(said, ["yyyy-MM-dd HH:mm", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd"]), "yyyy-MM-dd HH:mm")}


_PRODUCT = {
    "code": "CASE WHEN p_partkey % 3 = 0 THEN 'line_' || p_size END",
    "listing": "p_brand || ':' || p_partkey",
    "work": "CASE WHEN p_partkey % 4 <> 0 THEN p_type END",
    "sig": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END",
}


@rule(
    "bundle_key_kinds",
    "part",
    "p_partkey",
    _PRODUCT,
    {"bundle": "coalesce(code, CASE WHEN sig = '' THEN 'li_' || md5(listing) END, 'pr_' || md5(sig)) || CASE WHEN work IS NULL THEN '' ELSE '@' || work END"},
)
def bundle_key_kinds(code, listing, work, sig):
    """Keys by line number, else by listing for a bare title, else by title; with the work where it is known."""
    key = F.coalesce(code, F.when(sig == "", F.concat(F.lit("li_"), F.md5(listing))), F.concat(F.lit("pr_"), F.md5(sig)))
    return {"bundle": F.concat(key, F.coalesce(F.concat(F.lit("@"), work), F.lit("")))}


_VARIANT = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' set ' || (p_size % 3) WHEN 1 THEN ' 0' || (p_size % 2) ELSE '' END"


@query(
    "signature_variants",
    rf"""
WITH t AS (SELECT p_partkey, p_brand, p_name AS sig, {_VARIANT} AS title, p_partkey % 9 = 0 AS bare FROM part)
SELECT sig, p_brand, lower(regexp_replace(regexp_extract(title, '(?i)set\s*([a-z0-9][a-z0-9.&\s]{{0,12}})', 1), '\s+', '', 'g')) AS set_key, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(title, '\b\d{{1,4}}\b'))), '.'), '') AS number_key, count(*) AS n, min(p_partkey) AS first
FROM t WHERE NOT bare GROUP BY ALL HAVING count(*) > 1
""",
)
def signature_variants(spark, d):
    """Groups of more than one by signature, maker and both variant keys; bare titles are left out."""
    title = F.expr(_VARIANT)
    rows = table(spark, d, "part").filter("p_partkey % 9 <> 0").select("p_partkey", "p_brand", F.col("p_name").alias("sig"), T.set_variant(title).alias("set_key"), T.number_variant(title).alias("number_key"))
    return rows.groupBy("sig", "p_brand", "set_key", "number_key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).filter("n > 1")


@query(
    "merged_products",
    """
WITH o AS (SELECT l_partkey, l_suppkey % 7 AS shop, l_extendedprice AS price, l_orderkey, l_linenumber FROM lineitem),
p AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'jan' || p_partkey END AS jan, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS offers FROM part),
c AS (SELECT *, first_value(p_partkey) OVER w AS canonical, row_number() OVER w AS nth FROM p WINDOW w AS (PARTITION BY p_name, p_brand ORDER BY offers DESC, p_partkey)),
j AS (SELECT canonical, arg_min(jan, nth) FILTER (jan IS NOT NULL) AS jan FROM c GROUP BY 1),
m AS (SELECT c.canonical, shop, min(price) AS price FROM o JOIN c ON c.p_partkey = o.l_partkey GROUP BY 1, 2)
SELECT j.canonical, j.jan, count(m.shop) AS shops, round(min(m.price), 2) AS cheapest FROM j LEFT JOIN m ON m.canonical = j.canonical GROUP BY 1, 2
""",
)
def merged_products(spark, d):
    """Products merged into the one with most offers: empty fields filled in order, offers moved, the cheapest kept per shop."""
    lines = table(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") % 7).alias("shop"), "l_extendedprice")
    counts = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("offers"))
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'jan' || p_partkey END").alias("jan")).join(counts, "p_partkey", "left").na.fill(0, ["offers"])
    group = W.partitionBy("p_name", "p_brand").orderBy(F.desc("offers"), "p_partkey")
    c = p.withColumn("canonical", F.first("p_partkey").over(group)).withColumn("nth", F.row_number().over(group))
    filled = c.groupBy("canonical").agg(F.min_by("jan", F.when(F.col("jan").isNotNull(), F.col("nth"))).alias("jan"))
    moved = lines.join(c.select(F.col("p_partkey").alias("l_partkey"), "canonical"), "l_partkey").groupBy("canonical", "shop").agg(F.min("l_extendedprice").alias("price"))
    shops = moved.groupBy("canonical").agg(F.count("*").alias("shops"), F.round(F.min("price"), 2).alias("cheapest"))
    return filled.join(shops, "canonical", "left").na.fill(0, ["shops"]).select("canonical", "jan", "shops", "cheapest")


@query(
    "restocked_anywhere",
    """
WITH s AS (SELECT user_id AS product, event_id % 3 AS shop, event_id, (value > 20)::INT AS there FROM events),
d AS (SELECT *, there - coalesce(lag(there) OVER (PARTITION BY product, shop ORDER BY event_id), 0) AS delta FROM s),
r AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY product ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT product, shop, event_id FROM r WHERE delta = 1 AND before = 0
""",
)
def restocked_anywhere(spark, d):
    """Offers that come into stock while no shop had the product."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("product"), (F.col("event_id") % 3).alias("shop"), "event_id", (F.col("value") > 20).cast("int").alias("there"))
    return O.restocked_first(rows, "product", "shop", "event_id", "there").select("product", "shop", "event_id")


@query(
    "optional_filters",
    "SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_retailprice > 0 AND trim(CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_name END) <> ''",
)
def optional_filters(spark, d):
    """Filters that apply only where a value is given, over rows with an id, a title and a price above 0."""
    rows = table(spark, d, "part").withColumn("title", F.expr("CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_name END"))
    wanted = {"p_brand": "Brand#2", "p_type": None}
    return rows.filter(P.all_given(wanted) & P.is_valid_row(F.col("p_partkey").cast("string"), F.col("title"), F.col("p_retailprice"))).select("p_partkey")


@query(
    "trait_filter",
    "SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size % 5 = 2 AND contains(p_name, 'r') AND p_partkey % 2 = 0",
)
def trait_filter(spark, d):
    """Entries by equal traits of a map, a keyword, and whether they are owned."""
    traits = F.create_map(F.lit("kind"), F.col("p_type"), F.lit("rank"), (F.col("p_size") % 5).cast("string"))
    rows = table(spark, d, "part").withColumn("traits", traits)
    return rows.filter(P.has_traits(F.col("traits"), {"kind": "PROMO", "rank": "2"}) & P.contains_text(F.col("p_name"), "R") & (F.col("p_partkey") % 2 == 0)).select("p_partkey")


_CARD = "'2025.06.0' || (1 + event_id % 9) || ' ~ 2025.06.1' || (event_id % 10) || chr(10) || '#tag' || chr(10) || CASE WHEN event_id % 3 = 0 THEN '12:00' || chr(10) ELSE '' END || 'Hall ' || (event_id % 7) || chr(10) || 'more'"


@rule(
    "cards",
    "events",
    "event_id",
    {"card": _CARD, "title": "CASE event_id % 3 WHEN 0 THEN 'new code GIFT' || event_id WHEN 1 THEN 'FANART99 of the day' ELSE 'coupons: GIFT1A and GIFT2B' END"},
    {
        "starts": "make_date(2025, 6, (1 + event_id % 9)::INT)",
        "ends": "make_date(2025, 6, (10 + event_id % 10)::INT)",
        "venue": "'Hall ' || (event_id % 7)",
        "codes": "CASE event_id % 3 WHEN 0 THEN 'GIFT' || event_id WHEN 1 THEN '' ELSE 'GIFT1A,GIFT2B' END",
    },
)
def cards(card, title):
    """Free-text cards as events (first and last date, first plausible line as venue); codes of titles with a keyword only."""
    days = D.mentioned_dates(card)
    codes = F.when(P.any_keyword(title, ["code", "coupon"]), F.array_join(F.array_sort(T.code_candidates(title, ["COUPON"])), ",")).otherwise("")
    return {"starts": F.array_min(days), "ends": F.array_max(days), "venue": T.first_plausible_line(card), "codes": codes}


@query(
    "fetched_details",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'old' || p_size WHEN p_partkey % 3 = 0 THEN 'new' || p_name END AS detail, p_size % 2 <> 0 AS fetched FROM part",
)
def fetched_details(spark, d):
    """Details are fetched only where they are absent; what is there stays."""
    part = table(spark, d, "part")
    old = part.select("p_partkey", F.expr("CASE WHEN p_size % 2 = 0 THEN 'old' || p_size END").alias("detail"))
    fresh = part.filter("p_partkey % 3 = 0").select("p_partkey", F.expr("'new' || p_name").alias("detail"))
    return I.fill_absent(old, fresh, "p_partkey", "detail")


@query(
    "cheapest_override",
    "SELECT user_id, arg_max(event_type, event_id) AS chosen, count(*) AS changes FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def cheapest_override(spark, d):
    """One personal choice for each key: the last one made."""
    rows = table(spark, d, "events").filter("event_type <> 'error'")
    last = best_per(rows, ["user_id"], [F.desc("event_id")]).select("user_id", F.col("event_type").alias("chosen"))
    return last.join(rows.groupBy("user_id").agg(F.count("*").alias("changes")), "user_id")
