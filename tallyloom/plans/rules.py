"""Rules over texts, dates, maps and documents, one row for each row of a table.

Titles, posts, agents and the like are made of the tables' numbers, so that every branch of a rule is met.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import dates as D
from tallyloom.functions import predicates as P
from tallyloom.functions import text as T
from tallyloom.functions import vectors as V
from tallyloom.operators import ingest as I
from tallyloom.plans.base import query, rule
from tallyloom.sources import readers as R
from tallyloom.sources.tables import table

_ACCESSORIES = ["case", "stand", "poster"]
_DENIED = ["COUPON", "HTTPSABCD1"]


def _is_code(x: str) -> str:
    letters, upper = (f"length(regexp_replace({x}, '[^{c}]', '', 'g'))" for c in ("A-Za-z", "A-Z"))
    return f"(regexp_full_match({x}, '[A-Za-z0-9]{{4,30}}') AND {letters} > 0 AND {upper} * 10 >= {letters} * 6 AND (length({x}) >= 6 OR regexp_matches({x}, '[0-9]')) AND upper({x}) NOT IN ('COUPON', 'HTTPSABCD1'))"


_TOKEN = "CASE event_id % 10 WHEN 0 THEN 'GIFT' || (event_id % 100) WHEN 1 THEN 'summerpass' WHEN 2 THEN 'ABCDEFGHIJ' WHEN 3 THEN 'CODE' WHEN 4 THEN 'ABCDE' WHEN 5 THEN 'ABCDEF' WHEN 6 THEN '12345678' WHEN 7 THEN 'httpsABCD1' WHEN 8 THEN 'AB-CD12' ELSE 'AbCd' || event_id END"


@rule("code_tokens", "events", "event_id", {"tok": _TOKEN}, {"tok": "tok", "is_code": _is_code("tok")})
def code_tokens(tok):
    """Which tokens look like redeem codes."""
    return {"tok": tok, "is_code": T.is_code_token(tok, _DENIED)}


_POST = "'use ' || CASE event_id % 6 WHEN 0 THEN 'UNBREAKABLE MEMORIES' WHEN 1 THEN 'GIFT' || (event_id % 50) || ' and GIFT' || (event_id % 7) WHEN 2 THEN 'COUPON EVENTS' WHEN 3 THEN 'SUMMER  BREEZE PARTY now' WHEN 4 THEN 'GOLDEN TICKET or TICKET or golden1A' ELSE 'nothing here' END || ' today'"


@rule(
    "code_candidates",
    "events",
    "event_id",
    {"post": _POST},
    {
        "codes": rf"""(WITH p AS (SELECT unnest(regexp_extract_all(post, '\b(?:[A-Z]{{5,}}\s+){{1,2}}[A-Z]{{5,}}\b')) AS phrase),
 w AS (SELECT string_split_regex(phrase, '\s+') AS ws FROM p),
 g AS (SELECT ws, array_to_string(ws, '') AS c FROM w WHERE NOT list_has_any(ws, ['COUPON', 'HTTPSABCD1']) AND {_is_code("array_to_string(ws, '')")}),
 s AS (SELECT unnest(regexp_extract_all(post, '[A-Za-z0-9]{{4,30}}')) AS c),
 f AS (SELECT c FROM g UNION SELECT c FROM s WHERE {_is_code("c")} AND upper(c) NOT IN (SELECT unnest(ws) FROM g))
 SELECT coalesce(string_agg(DISTINCT upper(c), ',' ORDER BY upper(c)), '') FROM f)"""
    },
)
def code_candidates(post):
    """Codes of posts; neighbouring upper-case words are glued."""
    codes = F.transform(T.code_candidates(post, _DENIED), lambda c: F.upper(c))
    return {"codes": F.array_join(F.array_sort(codes), ",")}


_STAGE = "CASE event_id % 5 WHEN 0 THEN 'Challenge ' || (event_id % 15) || ' clear' WHEN 1 THEN 'CHAL.EX and challenge-' || (event_id % 4) WHEN 2 THEN 'challenge 007 auto' WHEN 3 THEN 'challenge 03, chal 3, Challenge EX' ELSE 'no stage 4' END"
_STAGES = [f"Challenge {i:02d}" for i in range(1, 13)] + ["Challenge EX"]


@rule(
    "stage_labels",
    "events",
    "event_id",
    {"title": _STAGE},
    {
        "labels": r"""(WITH m AS (SELECT unnest(regexp_extract_all(lower(title), '(?:challenge|chal)\s*[.\-]?\s*(ex|\d+)', 1)) AS x),
 l AS (SELECT DISTINCT 'Challenge ' || CASE WHEN x = 'ex' THEN 'EX' ELSE printf('%02d', x::INT) END AS l FROM m)
 SELECT coalesce(string_agg(l, ',' ORDER BY l), '') FROM l WHERE l IN (SELECT printf('Challenge %02d', i) FROM range(1, 13) r(i) UNION ALL SELECT 'Challenge EX'))"""
    },
)
def stage_labels(title):
    """Stages that titles name, among the known ones."""
    return {"labels": F.array_join(F.array_sort(T.stage_labels(title, _STAGES)), ",")}


_TITLE = "CASE p_partkey % 7 WHEN 0 THEN 'Rin 1/7 scale ' || p_name WHEN 1 THEN p_name || ' acrylic Case for no.' || p_size WHEN 2 THEN p_name || ' Set ' || (p_partkey % 4) || '.0 & 2.1 box' WHEN 3 THEN p_name || ' set D (2nd 15)' WHEN 4 THEN p_name || ' 0' || (p_partkey % 9) || ' and 12 [99] 1/4' WHEN 5 THEN p_name || ' 5/03 STAND poster' ELSE p_name || ' 1 / 12 ver' END"


@rule(
    "variant_keys",
    "part",
    "p_partkey",
    {"title": _TITLE},
    {
        "set_key": r"lower(regexp_replace(regexp_extract(title, '(?i)set\s*([a-z0-9][a-z0-9.&\s]{0,12})', 1), '\s+', '', 'g'))",
        "number_key": r"coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(lower(title), '\[.*?\]|\(.*?\)', ' ', 'g'), '\d+\s*/\s*\d+', ' ', 'g'), '\b\d{1,4}\b'))), '.'), '')",
        "loose": r"nullif(regexp_replace(regexp_extract(title, '(\d\s*/\s*\d{1,2})', 1), '\s', '', 'g'), '')",
        "words": "array_to_string(list_sort(list_filter(['case', 'poster', 'stand'], lambda k: contains(lower(title), k))), '+')",
    },
)
def variant_keys(title):
    """Set and number variants, loose scales and accessory words of titles."""
    return {"set_key": T.set_variant(title), "number_key": T.number_variant(title), "loose": T.loose_scale(title), "words": F.array_join(T.keywords_in(title, _ACCESSORIES), "+")}


@rule(
    "kept_maker_codes",
    "part",
    "p_partkey",
    {"title": _TITLE, "code": "CASE p_partkey % 3 WHEN 0 THEN 'jan_' || p_partkey WHEN 1 THEN 'line_' || p_size END"},
    {
        "code": "CASE WHEN code LIKE 'jan%' OR NOT regexp_matches(title, '(?i)case|stand|poster') THEN code END",
        "category": r"CASE WHEN regexp_matches(title, '(^|\D)1\s*/\s*(1[0-2]|[2-9])($|\D)') AND NOT regexp_matches(title, '(?i)case|stand|poster') THEN 'figure' ELSE 'goods' END",
    },
)
def kept_maker_codes(title, code):
    """Line numbers dropped from accessories; listings with a strict scale promoted."""
    return {"code": T.kept_maker_code(code, title, _ACCESSORIES), "category": T.promoted_category(F.lit("goods"), title, _ACCESSORIES, "figure")}


@rule(
    "valid_listings",
    "part",
    "p_partkey",
    {"code": "CASE p_partkey % 5 WHEN 0 THEN 'FIG-' || p_partkey || '-r' ELSE 'FIG-' || p_partkey END", "jan": "CASE p_partkey % 4 WHEN 0 THEN '49-' || (10000000000 + p_partkey) WHEN 1 THEN '1234567' WHEN 2 THEN '12 345 678' END"},
    {"fine": "NOT regexp_matches(code, '(?i)-r$') AND length(regexp_replace(coalesce(jan, ''), '[^0-9]', '', 'g')) BETWEEN 8 AND 13"},
)
def valid_listings(code, jan):
    """New goods with a barcode."""
    return {"fine": T.valid_listing(code, jan)}


_RELEASE = "CASE event_id % 6 WHEN 0 THEN 'due 2' || (event_id % 10) || '년 ' || (event_id % 15) || '월 ~ 12월' WHEN 1 THEN 'release 202' || (event_id % 9) || ' / ' || (event_id % 14) WHEN 2 THEN '2026-05 only' WHEN 3 THEN 'due 25.08' WHEN 4 THEN 'release 2026년 13월 or 2025-03' ELSE 'due soon' END"


@rule(
    "release_months",
    "events",
    "event_id",
    {"title": _RELEASE},
    {
        "released": r"""CASE WHEN event_id % 6 = 0 AND event_id % 15 BETWEEN 1 AND 12 THEN make_date((2020 + event_id % 10)::INT, (event_id % 15)::INT, 1)
 WHEN event_id % 6 = 1 AND event_id % 14 BETWEEN 1 AND 12 THEN make_date((2020 + event_id % 9)::INT, (event_id % 14)::INT, 1) END"""
    },
)
def release_months(title):
    """Release months in words or numbers, where a keyword says so."""
    return {"released": D.release_month(title, ["release", "due"])}


_EXPIRY = "CASE event_id % 6 WHEN 0 THEN '유효 기간은 2026년 ' || (1 + event_id % 12) || '월 9일 10:30' WHEN 1 THEN '2025년 3월 ' || (1 + event_id % 30) || '일 까지' WHEN 2 THEN (1 + event_id % 12) || '월 2일 0:59까지' WHEN 3 THEN (1 + event_id % 12) || '월 5일까지' WHEN 4 THEN '13월 40일까지' ELSE '3월 4일 open' END"


@rule(
    "post_expiry",
    "events",
    "event_id",
    {"post": _EXPIRY, "posted": "ts"},
    {
        "expires": """CASE event_id % 6 WHEN 0 THEN make_timestamp(2026, 1 + event_id % 12, 9, 10, 30, 0) WHEN 1 THEN make_timestamp(2025, 3, 1 + event_id % 30, 23, 59, 0)
 WHEN 2 THEN make_timestamp(year(posted), 1 + event_id % 12, 2, 0, 59, 0) WHEN 3 THEN make_timestamp(year(posted), 1 + event_id % 12, 5, 23, 59, 0) END::VARCHAR"""
    },
)
def post_expiry(post, posted):
    """Expiries that posts name, with or without a year and a time."""
    return {"expires": F.date_format(D.post_expiry(post, posted), "yyyy-MM-dd HH:mm:ss")}


_DATES = "CASE event_id % 5 WHEN 0 THEN 'from 2025-06-1' || (event_id % 10) || ' to 2025/07/02, 2025.07.02' WHEN 1 THEN 'on 2025-02-30 or 2025-3-4' WHEN 2 THEN 'Aug 202' || (event_id % 10) WHEN 3 THEN '1' || (event_id % 9) || ' August 2025' ELSE '120256-01-01x' END"


@rule(
    "mentioned_dates",
    "events",
    "event_id",
    {"body": _DATES},
    {
        "days": """CASE event_id % 5 WHEN 0 THEN '2025-06-1' || (event_id % 10) || ',2025-07-02' WHEN 1 THEN '2025-03-04' ELSE '' END""",
        "first": "CASE event_id % 5 WHEN 0 THEN make_date(2025, 6, (10 + event_id % 10)::INT) WHEN 1 THEN DATE '2025-03-04' END",
        "last": "CASE event_id % 5 WHEN 0 THEN DATE '2025-07-02' WHEN 1 THEN DATE '2025-03-04' END",
        "released": "CASE event_id % 5 WHEN 0 THEN make_date(2025, 6, (10 + event_id % 10)::INT) WHEN 2 THEN make_date((2020 + event_id % 10)::INT, 8, 1) WHEN 3 THEN make_date(2025, 8, (10 + event_id % 9)::INT) WHEN 4 THEN DATE '0256-01-01' END",
    },
)
def mentioned_dates(body):
    """Real dates of texts with their first and last, and release dates in ISO or English form."""
    days = D.mentioned_dates(body)
    return {"days": F.array_join(F.transform(days, lambda d: d.cast("string")), ","), "first": F.array_min(days), "last": F.array_max(days), "released": D.release_date(body)}


@rule(
    "event_moments",
    "events",
    "event_id",
    {"announced": "CASE event_id % 4 WHEN 0 THEN TIMESTAMP '9999-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-03-05 12:00:00' ELSE ts END", "posted": "CAST(ts AS DATE)", "m": "CAST(1 + event_id % 12 AS INT)", "dd": "CAST(1 + event_id % 28 AS INT)"},
    {
        "trusted": "CASE WHEN event_id % 4 IN (0, 1) THEN NULL ELSE strftime(announced, '%Y-%m-%d %H:%M:%S') END",
        "known": "NOT (hour(announced) = 12 AND minute(announced) = 0)",
        "local": "strftime(announced + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S')",
        "expires": "(make_date(year(posted) + CASE WHEN m < month(posted) - 1 THEN 1 ELSE 0 END, m, dd)::VARCHAR || ' 23:59:59')",
        "ends": "CASE WHEN make_date(2024, m, dd) < posted THEN (make_date(2024, m, dd) + INTERVAL 1 YEAR)::DATE ELSE make_date(2024, m, dd) END",
        "scope": "CASE WHEN posted <= DATE '2024-01-10' THEN 'current' ELSE 'forecast' END",
        "said": "strftime(announced, '%b %-d (%a) %-I:%M %p')",
    },
)
def event_moments(announced, posted, m, dd):
    """Announcements trusted or not, local times, expiries and ends of ranges whose years aren't written."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return {
        "trusted": text(D.trusted_announcement(announced, F.array(F.lit("2024-03-05").cast("date")))),
        "known": D.time_known(announced),
        "local": text(D.local_time(announced.cast("timestamp_ntz"))),
        "expires": text(D.expiry_by_post(posted, m, dd)),
        "ends": D.range_end(posted, F.make_date(F.lit(2024), m, dd)),
        "scope": D.scope_at(posted, F.lit("2024-01-10").cast("date")),
        "said": D.human_date(announced),
    }


_MARKED = "CASE event_id % 4 WHEN 0 THEN 'Hot! code: GIFT' || event_id || ' reward: 100 gems end' WHEN 1 THEN 'coupon ABcd99 reward 5 tickets, gold end more' WHEN 2 THEN 'reward: nothing closed' ELSE 'plain' END"


@rule(
    "marked_codes",
    "events",
    "event_id",
    {"body": _MARKED},
    {
        "code": "CASE event_id % 4 WHEN 0 THEN 'GIFT' || event_id WHEN 1 THEN 'ABcd99' END",
        "reward": "CASE event_id % 4 WHEN 0 THEN '100 gems' WHEN 1 THEN '5 tickets, gold' WHEN 2 THEN 'nothing closed' END",
        "short": "left(body, 12)",
        "dotted": "CASE WHEN length(body) > 12 THEN left(body, 11) || '…' ELSE body END",
    },
)
def marked_codes(body):
    """Codes after a marker, rewards between markers, and cut texts."""
    return {"code": T.code_after(body, ["code", "coupon"]), "reward": T.text_between(body, "reward", "end"), "short": T.truncated(body, 12), "dotted": T.truncated(body, 12, True)}


_SHOW = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' LIVE tour' WHEN 1 THEN 'one two three four five' WHEN 2 THEN p_name || ' 2025' ELSE '  ' || p_name END"


@rule(
    "artist_names",
    "part",
    "p_partkey",
    {"title": _SHOW, "name": "CASE p_partkey % 3 WHEN 0 THEN ' Rin-Chan (Ver.2): ' || p_name ELSE p_brand || '·' || p_name END", "own": "p_name"},
    {
        "artist": "CASE p_partkey % 4 WHEN 1 THEN 'one two three four' ELSE array_to_string(string_split(own, ' ')[:4], ' ') END",
        "wide": r"lower(regexp_replace(trim(name), '[\s:：.·\-_()\[\]]+', '', 'g'))",
    },
)
def artist_names(title, name, own):
    """Names of artists before a keyword or a year, and wide name keys."""
    return {"artist": T.artist_name(title, ["live"]), "wide": T.wide_name_key(name)}


@rule(
    "url_forms",
    "events",
    "event_id",
    {"url": "CASE event_id % 6 WHEN 0 THEN 'https://www.youtube.com/watch?v=abcdefgh' || (event_id % 900) WHEN 1 THEN '//cdn.example/a.png' WHEN 2 THEN '/img/' || event_id WHEN 3 THEN 'p/q?r=1' WHEN 4 THEN 'https://youtu.be/ABCDEFGHIJK' ELSE 'HTTP://WWW.Host' || (event_id % 5) || '.Example:80/x' END"},
    {
        "video": "CASE event_id % 6 WHEN 0 THEN 'abcdefgh' || (event_id % 900) WHEN 4 THEN 'ABCDEFGHIJK' END",
        "absolute": "CASE event_id % 6 WHEN 1 THEN 'https:' || url WHEN 2 THEN 'https://shop.example' || url WHEN 3 THEN 'https://shop.example/list/' || url ELSE url END",
        "host": "CASE event_id % 6 WHEN 0 THEN 'youtube.com' WHEN 4 THEN 'youtu.be' WHEN 5 THEN 'host' || (event_id % 5) || '.example' ELSE '' END",
    },
)
def url_forms(url):
    """Video ids, absolute URLs and hosts."""
    return {"video": T.video_id(url), "absolute": T.absolute_url(url, "https://shop.example/list"), "host": T.url_host(url)}


@rule(
    "alias_codes",
    "events",
    "event_id",
    {"q": "CASE event_id % 6 WHEN 0 THEN ' BA ' WHEN 1 THEN 'the blue archive wiki' WHEN 2 THEN 'archi' WHEN 3 THEN 'nikke' WHEN 4 THEN '' ELSE 'unknown' END"},
    {
        "code": "CASE event_id % 6 WHEN 0 THEN 'ba' WHEN 1 THEN 'ba' WHEN 2 THEN 'ba' WHEN 3 THEN 'nk' END",
        "label": "CASE event_id % 6 WHEN 3 THEN 'Nikke' ELSE q END",
        "line": "'#' || event_id || ' <' || q || '> see /c/' || event_id",
        "summary": "CASE WHEN q <> '' THEN 'query ' || q || ' · ' ELSE '' END || 'id ' || event_id",
    },
)
def alias_codes(q):
    """Codes by alias, translated words, filled templates and summary lines."""
    number = F.col("event_id")
    return {
        "code": T.alias_code(q, {"ba": ["blue archive", "archive"], "nk": ["nikke"]}),
        "label": T.translated(q, {"nikke": "Nikke"}),
        "line": T.filled("#{id} <{q}> see /c/{id}", {"id": number, "q": q}),
        "summary": T.summary_line({"query": q, "id": number}),
    }


@rule(
    "reward_texts",
    "events",
    "event_id",
    {"n": "CAST(event_id % 9 AS INT)"},
    {"rewards": "coalesce(array_to_string(list_transform(range(1, least(n, 6) + 1), lambda i: 'r' || i || CASE WHEN i % 2 = 0 THEN ' x' || (i * n) ELSE '' END), ', '), '')"},
)
def reward_texts(n):
    """Lists of rewards as a line, the first six."""
    entry = lambda i: F.struct(F.concat(F.lit("r"), i.cast("string")).alias("name"), F.when(i % 2 == 0, i * n).alias("count"))
    rewards = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), entry)).otherwise(F.array().cast("array<struct<name:string,count:int>>"))
    return {"rewards": T.reward_text(rewards)}


@rule(
    "reward_shapes",
    "events",
    "event_id",
    {"rewards": """CASE event_id % 8 WHEN 0 THEN '" 100 gems "' WHEN 1 THEN '["a' || event_id || '","", " b "]' WHEN 2 THEN '[{"name":"gem","count":' || (event_id % 3) || '},{"name":"gold","amount":"7"},{"count":2},5]' WHEN 3 THEN '[]' WHEN 4 THEN '{"name":"x"}' WHEN 5 THEN '["1","2","3","4","5","6","7"]' WHEN 6 THEN 'broken' END"""},
    {"line": "CASE event_id % 8 WHEN 0 THEN '100 gems' WHEN 1 THEN 'a' || event_id || ', b' WHEN 2 THEN 'gem' || CASE WHEN event_id % 3 > 0 THEN ' x' || (event_id % 3) ELSE '' END || ', gold x7' WHEN 5 THEN '1, 2, 3, 4, 5, 6' END"},
)
def reward_shapes(rewards):
    """Rewards given as a text, a list, or a list of names and counts, as one line."""
    return {"line": T.reward_line(rewards)}


@rule(
    "announced_expiries",
    "events",
    "event_id",
    {
        "title": "CASE event_id % 3 WHEN 0 THEN '쿠폰 ~ ' || (1 + event_id % 13) || '월 ' || (1 + event_id % 31) || '일까지' ELSE '쿠폰 ' || (1 + event_id % 12) || '월' END",
        "body": "CASE event_id % 3 WHEN 1 THEN '1월 1일 시작, ' || (1 + event_id % 12) || ' 월 ' || (event_id % 33) || '일 종료' ELSE '없음' END",
        "posted": "CAST(ts AS DATE) + 60",
    },
    {
        "expires": """strftime(CASE WHEN event_id % 3 = 0 AND event_id % 13 < 12 THEN make_date(year(posted) + CASE WHEN 1 + event_id % 13 < month(posted) - 1 THEN 1 ELSE 0 END, (1 + event_id % 13)::INT, 1) + (event_id % 31)::INT
WHEN event_id % 3 = 1 AND event_id % 33 BETWEEN 1 AND 31 THEN make_date(year(posted) + CASE WHEN 1 + event_id % 12 < month(posted) - 1 THEN 1 ELSE 0 END, (1 + event_id % 12)::INT, 1) + (event_id % 33 - 1)::INT END, '%Y-%m-%d 23:59:59')"""
    },
)
def announced_expiries(title, body, posted):
    """Ends of coupons that a title names, or else the last day in the body, in years that aren't written."""
    return {"expires": F.date_format(D.announced_expiry(title, body, posted), "yyyy-MM-dd HH:mm:ss")}


@rule(
    "requests",
    "events",
    "event_id",
    {
        "agent": "CASE event_id % 8 WHEN 0 THEN 'curl/8' WHEN 1 THEN 'iPad; CPU' WHEN 2 THEN 'Linux Android 14' WHEN 3 THEN 'Android Mobile Safari' WHEN 4 THEN 'HeadlessChrome' WHEN 5 THEN NULL WHEN 6 THEN 'Opera Mini' ELSE 'Windows NT' END",
        "method": "CASE event_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END",
        "accepts": "CASE event_id % 4 WHEN 0 THEN 'application/json' ELSE 'text/html,*/*' END",
        "path": "CASE event_id % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'build/app.js' WHEN 2 THEN '.well-known/x' ELSE 'list/' || event_id END",
        "url": "CASE event_id % 7 WHEN 0 THEN '/a?q=%253Cscript%253E' WHEN 1 THEN '/a?q=%3CSCRIPT%3E' WHEN 2 THEN '/x/../../etc' WHEN 3 THEN '/ok%zz' ELSE '/list/' || event_id END",
    },
    {
        "device": "CASE event_id % 8 WHEN 0 THEN 'bot' WHEN 1 THEN 'tablet' WHEN 2 THEN 'tablet' WHEN 3 THEN 'mobile' WHEN 4 THEN 'bot' WHEN 6 THEN 'mobile' ELSE 'pc' END",
        "logged": "event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 5 > 2",
        "attack": "event_id % 7 < 3",
    },
)
def requests(agent, method, accepts, path, url):
    """Classes of device, which requests are logged, and which look like attacks."""
    return {"device": T.device_class(agent), "logged": P.is_loggable(method, accepts, path), "attack": P.looks_like_attack(url, ["<script", "../"])}


@rule(
    "subscriber_maps",
    "events",
    "event_id",
    {"a": "event_type", "n": "CAST(event_id % 4 AS INT)"},
    {
        "filled": "CASE n WHEN 0 THEN 'kind' WHEN 1 THEN 'kind,size' ELSE 'kind,size' END",
        "allowed": "'kind'",
        "merged": "'kind=new,other=x,size=' || CASE n WHEN 0 THEN '' ELSE n::VARCHAR END",
        "has_all": "a IN ('view', 'click')",
        "chatter": "n IN (0, 1)",
    },
)
def subscriber_maps(a, n):
    """Maps without empty entries, with allowed keys only, and merged; containment of sets; chatter."""
    entries = F.create_map(F.lit("kind"), a, F.lit("size"), F.when(n > 0, n.cast("string")).otherwise(""), F.lit("none"), F.lit(None).cast("string"))
    other = F.create_map(F.lit("kind"), F.lit("new"), F.lit("other"), F.lit("x"))
    shown = F.map_filter(entries, lambda k, _: k != "none")
    title = F.when(n == 0, "is it out? ~.").when(n == 1, "rumour of it").otherwise("out now? yes")
    return {
        "filled": F.array_join(F.array_sort(F.map_keys(P.keep_filled(entries))), ","),
        "allowed": F.array_join(F.map_keys(P.keep_keys(entries, ["kind", "colour"])), ","),
        "merged": F.array_join(F.array_sort(F.transform(F.map_entries(I.merge_maps(shown, other)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","),
        "has_all": P.contains_all(F.array(F.lit("view"), F.lit("click")), F.array(a)),
        "chatter": P.is_chatter(title, ["rumour"]),
    }


@rule(
    "json_texts",
    "events",
    "event_id",
    {"props": "props", "k": "CAST(event_id % 5 AS INT)"},
    {
        "fenced": "CASE WHEN k = 4 THEN NULL ELSE json_extract_string(props, '$.k')::INT END",
        "recovered": "CASE WHEN k < 3 THEN 'v' || k END",
        "tail": "CASE WHEN k IN (0, 1) THEN json_extract_string(props, '$.k')::INT END",
        "head": "'said ' || k",
        "nested": "CASE WHEN k < 4 THEN k ELSE -1 END",
        "objects": "CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END::BIGINT",
    },
)
def json_texts(props, k):
    """JSON in fences, broken JSON, JSON after a marker, paths with a default, and lists in several shapes."""
    fenced = F.when(k == 4, F.lit("no json")).otherwise(F.concat(F.lit("```json\n "), props, F.lit("\n```")))
    broken = F.concat(F.lit('{"a": 1, "name": '), F.when(k < 3, F.concat(F.lit('"v'), k.cast("string"), F.lit('", "b": ['))).otherwise("null, "))
    said = F.concat(F.lit("said "), k.cast("string"), F.when(k < 2, F.concat(F.lit(" ---DATA--- "), props)).otherwise(""))
    nested = F.concat(F.lit('{"a": {"b": '), k.cast("string"), F.lit("}}"))
    shape = F.element_at(F.array(*[F.lit(x) for x in ('{"x": 1}', "[1, 2]", '{"items": [1, 2, 3]}', '{"data": [4]}', "oops")]), k + 1)
    return {
        "fenced": F.try_variant_get(T.tolerant_json(fenced), "$.k", "int"),
        "recovered": T.recovered_field(broken, "name"),
        "tail": F.try_variant_get(T.tail_after(said, "---DATA---"), "$.k", "int"),
        "head": T.head_before(said, "---DATA---"),
        "nested": R.path_or(F.parse_json(F.when(k < 4, nested).otherwise("{}")), "$.a.b", "int", F.lit(-1)),
        "objects": F.size(R.json_objects(shape)).cast("long"),
    }


@rule(
    "slots",
    "events",
    "event_id",
    {"n": "CAST(event_id % 7 AS INT)"},
    {
        "label": "CASE WHEN n < 3 THEN ['fire', 'water', 'wind'][n + 1] END",
        "typed": "coalesce(array_to_string(list_transform(range(0, n), lambda i: i || CASE WHEN i < 4 THEN ':main' ELSE ':support' END), ','), '')",
        "hamming": "CASE WHEN n = 6 THEN 64 ELSE n END",
        "clamped": "greatest(0, least(100, n * 30 - 40))::DOUBLE",
        "cost": "(n * (n + 1) // 2)::BIGINT",
    },
)
def slots(n):
    """The first number that isn't zero as a label, slots typed by place, bits of hashes, clamped numbers, nested sums."""
    values = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == n, 7).otherwise(0))
    members = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i - 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    other = F.when(n == 6, F.lit("xyz")).otherwise(F.lpad(F.hex(F.expr("shiftleft(1L, n) - 1")), 16, "0"))
    lists = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i > 0, F.sequence(F.lit(1), F.greatest(i, F.lit(1)))).otherwise(F.array().cast("array<int>")))
    return {
        "label": T.first_nonzero_label(values, ["fire", "water", "wind"]),
        "typed": F.array_join(F.transform(T.typed_slots(members), lambda s: F.concat_ws(":", s["member"], s["slot"])), ","),
        "hamming": V.hamming_hex(F.lit("0" * 16), other),
        "clamped": V.clamp((n * 30 - 40).cast("double")),
        "cost": F.aggregate(lists, F.lit(0), lambda a, x: a + F.size(x)).cast("long"),
    }


@rule(
    "page_parts",
    "pages",
    "page_id",
    {"html": "html"},
    {
        "codes": f"""(WITH m AS (SELECT unnest(list_concat(regexp_extract_all(h, '(?is)<strong(?:\\s[^>]*)?>(.*?)</strong>', 1), regexp_extract_all(h, '(?is)<b(?:\\s[^>]*)?>(.*?)</b>', 1), regexp_extract_all(h, '(?is)<td(?:\\s[^>]*)?>(.*?)</td>', 1))) AS c FROM (SELECT '<b> GIFT' || (page_id % 9) || '</b><td class=x>OPEN <i>SALE</i></td><strong>HELLO1</strong><b>word</b>' AS h))
 SELECT string_agg(DISTINCT trim(regexp_replace(c, '<[^>]*>', '', 'g')), ',' ORDER BY trim(regexp_replace(c, '<[^>]*>', '', 'g'))) FROM m WHERE {_is_code("trim(regexp_replace(c, '<[^>]*>', '', 'g'))")})""",
        "links": r"""(SELECT count(DISTINCT x)::BIGINT FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS x))""",
        "first_link": r"""nullif(regexp_extract(html, 'href="/([^"]*)"', 1), '')""",
        "title": "trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))",
    },
)
def page_parts(html):
    """Codes of emphasised elements, links in first-seen order, and titles."""
    made = F.concat(F.lit("<b> GIFT"), (F.col("page_id") % 9).cast("string"), F.lit("</b><td class=x>OPEN <i>SALE</i></td><strong>HELLO1</strong><b>word</b>"))
    links = T.links_in_order(html, r"/([^\"]*)")
    return {
        "codes": F.array_join(F.array_sort(T.emphasised_codes(made, _DENIED)), ","),
        "links": F.size(links).cast("long"),
        "first_link": F.get(links, F.lit(0)),
        "title": F.trim(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)),
    }


@query(
    "page_links",
    """
WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS links FROM pages)
SELECT page_id, len(list_distinct(links))::BIGINT AS n, links[1] AS first, array_to_string(list_sort(list_distinct(links)), ' ') AS links FROM l
""",
)
def page_links(spark, d):
    """Links within the site of real pages, each once."""
    links = T.links_in_order(F.col("html"), '(/[^"]*)')
    found = table(spark, d, "pages").select("page_id", links.alias("links"))
    return found.select("page_id", F.size("links").cast("long").alias("n"), F.get("links", F.lit(0)).alias("first"), F.array_join(F.array_sort("links"), " ").alias("links"))


@query(
    "page_headings",
    r"""
WITH e AS (SELECT page_id, regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1) AS h, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p\s*>', 1) AS p FROM pages)
SELECT page_id, len(h)::BIGINT AS headings, len(p)::BIGINT AS paragraphs, trim(regexp_replace(regexp_replace(h[1], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading FROM e
""",
)
def page_headings(spark, d):
    """Headings and paragraphs of real pages."""
    texts = lambda tag: R.element_texts(F.col("html"), tag)
    found = table(spark, d, "pages").select("page_id", texts("h1").alias("h"), texts("p").alias("p"))
    return found.select("page_id", F.size("h").cast("long").alias("headings"), F.size("p").cast("long").alias("paragraphs"), F.get("h", F.lit(0)).alias("heading"))


@query(
    "document_codes",
    rf"""
WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS tok FROM documents)
SELECT doc_id, count(*) AS n, min(tok) AS first, max(tok) AS last FROM t WHERE {_is_code("tok")} GROUP BY 1
""",
)
def document_codes(spark, d):
    """Tokens of real documents that look like redeem codes."""
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0))
    found = table(spark, d, "documents").select("doc_id", F.explode(tokens).alias("tok")).filter(T.is_code_token(F.col("tok"), _DENIED))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("tok").alias("first"), F.max("tok").alias("last"))
