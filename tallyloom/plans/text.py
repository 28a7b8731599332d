"""Titles, names, codes, HTML and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import matching as M
from tallyloom.operators.ranks import running_totals
from tallyloom.plans.base import query
from tallyloom.sources.tables import table

_DROP = r"\[[^\]]*\]|\([^)]*\)"
_ALIASES = [("red", "crimson"), ("bolt", "screw")]
_STOP = ["small", "large"]
_SQL_NORM = r"trim(replace(replace(' ' || trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '\[[^\]]*\]|\([^)]*\)', ' ', 'g')) || ' ', ' red ', ' crimson '), ' bolt ', ' screw '))"


def _titles(spark, d):
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    norm = T.normalise_title(title, _DROP, _ALIASES)
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_retailprice", norm.alias("norm"))


@query("normalise_title", f"SELECT p_partkey, {_SQL_NORM} AS norm FROM part")
def normalise_title(spark, d):
    """Titles without bracketed parts, with aliases replaced."""
    return _titles(spark, d).select("p_partkey", "norm")


@query(
    "signature",
    f"""
WITH n AS (SELECT p_partkey, {_SQL_NORM} AS norm FROM part),
t AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda x: x NOT IN ('small', 'large', '') AND NOT regexp_full_match(x, '[0-9]+'))) AS toks FROM n)
SELECT p_partkey, CASE WHEN len(toks) >= 2 THEN array_to_string(list_sort(toks), ' ') ELSE replace(norm, ' ', '') END AS sig, md5(CASE WHEN len(toks) >= 2 THEN array_to_string(list_sort(toks), ' ') ELSE replace(norm, ' ', '') END) AS match_key FROM t
""",
)
def signature(spark, d):
    """Sorted distinctive tokens, or the compact title, and its digest."""
    rows = _titles(spark, d).withColumn("toks", T.distinctive_tokens(F.col("norm"), _STOP))
    sig = T.signature(F.col("toks"), F.replace("norm", F.lit(" "), F.lit("")))
    return rows.select("p_partkey", sig.alias("sig"), F.md5(sig).alias("match_key"))


@query(
    "dictionary_code",
    "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'JEWEL' WHEN contains(lower(p_name), 'red') THEN 'RED' WHEN contains(lower(p_name), 'bolt') THEN 'BOLT' END AS code FROM part",
)
def dictionary_code(spark, d):
    """The first dictionary entry that occurs, in the dictionary's order."""
    return table(spark, d, "part").select("p_partkey", T.first_hit(F.col("p_name"), [("ring", "JEWEL"), ("red", "RED"), ("bolt", "BOLT")]).alias("code"))


@query("maker_codes", r"SELECT s_suppkey, 'sup_' || regexp_extract(lower(s_name), 'supplier#0*(\d+)', 1) AS code FROM supplier")
def maker_codes(spark, d):
    """prefix_number codes out of names."""
    return table(spark, d, "supplier").select("s_suppkey", T.maker_code(F.col("s_name"), [("no", r"no\.(\d+)"), ("sup", r"supplier#0*(\d+)")]).alias("code"))


@query(
    "artist_overlap",
    r"""
WITH b AS (SELECT p_partkey, p_brand, p_size, list_filter(list_distinct(string_split_regex(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+')), lambda x: length(x) >= 2 AND x NOT IN ('old', 'new')) AS toks FROM part)
SELECT a.p_partkey AS id, count(*) AS twins FROM b a JOIN b c ON a.p_size = c.p_size AND a.p_brand <> c.p_brand AND len(list_intersect(a.toks, c.toks)) > 0 GROUP BY 1
""",
)
def artist_overlap(spark, d):
    """How many rows have the same day (here: size), another source (here: brand) and a token in common."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", T.artist_tokens(F.col("p_name"), ["old", "new"]).alias("toks"))
    return M.twins(rows, "id", "p_size", "p_brand", "toks")


@query(
    "html_text",
    r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g')) AS t FROM a)
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM b
""",
)
def html_text(spark, d):
    """Visible text of pages."""
    text = table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("t"))
    return text.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("url_host", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages")
def url_host(spark, d):
    """Hosts of pages."""
    return table(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query(
    "text_concat_cap",
    "SELECT c_mktsegment, left(string_agg(c_name, ' / ' ORDER BY c_custkey), 20000) AS body FROM customer GROUP BY 1",
)
def text_concat_cap(spark, d):
    """Texts of a group in order, joined and cut to a length (the cut is the feature).

    Where each text would begin is known from running lengths, so only what lies before the cut is gathered.
    """
    names = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name")
    begin = running_totals(names, ["c_mktsegment"], [("c_custkey", False)], F.length("c_name") + 3, "begin_").filter("begin_ < 20000")
    listed = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))
    body = F.left(F.array_join(F.transform(listed, lambda s: s["c_name"]), " / "), F.lit(20000))
    return begin.groupBy("c_mktsegment").agg(body.alias("body"))


@query("keyword_filter", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(text), 'token')) AND NOT contains(lower(text), 'apache')")
def keyword_filter(spark, d):
    """Any of some keywords and none of others."""
    from tallyloom.functions import predicates as P

    text = F.col("text")
    return table(spark, d, "documents").filter(P.any_keyword(text, ["license", "token"]) & ~P.any_keyword(text, ["apache"])).select("doc_id")


@query("star_counts", "SELECT doc_id, length(text) - length(replace(text, '*', '')) AS stars FROM documents")
def star_counts(spark, d):
    """Occurrences of a substring."""
    return table(spark, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("*"), F.lit("")))).cast("long").alias("stars"))


_NAMES = ["license", "License, Version", "Apache License", "token", "password", "The", "the", "and"]


@query(
    "mention_scan",
    r"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}])(License, Version|Apache License|password|license|token|The|and|the)', 1))), ','), '') AS mentions FROM documents",
)
def mention_scan(spark, d):
    """Names from a dictionary that texts mention, the longest first."""
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.mentions(F.col("text"), _NAMES)), ",").alias("mentions"))
