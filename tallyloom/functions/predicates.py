"""Reusable predicates: each returns a boolean Column."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_text(column: Column, needle: str) -> Column:
    """Case-blind substring test; no pattern characters, so nothing needs escaping."""
    return F.contains(F.lower(column), F.lit(needle.lower()))


def contains_compact(column: Column, needle: str) -> Column:
    """Substring test that ignores blanks on both sides."""
    return F.contains(F.replace(F.lower(column), F.lit(" "), F.lit("")), F.lit(needle.lower().replace(" ", "")))


def expand_search(words: list[str], aliases: dict[str, list[str]], most: int = 8, phrase: int = 3) -> list[list[str]]:
    """Alternatives for each search term: up to ``phrase`` neighbouring words that name an alias become its variants.

    Longest phrases first; single words stand for themselves. Only the query's text is handled here, never rows.
    """
    words, out, at = words[:most], [], 0
    while at < len(words):
        for size in range(min(phrase, len(words) - at), 0, -1):
            variants = aliases.get(" ".join(words[at : at + size]).lower())
            if variants:
                out.append([" ".join(words[at : at + size]), *variants])
                at += size
                break
        else:
            out.append([words[at]])
            at += 1
    return out


def matches_all(terms: list[list[str]], columns: list[Column]) -> Column:
    """Every term must occur, in any of its variants and any of the columns, blanks in the first column ignored too."""
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    one = lambda term: any_of([contains_text(c, v) for v in term for c in columns] + [contains_compact(columns[0], v) for v in term])
    return reduce(lambda a, b: a & b, [F.coalesce(one(t), F.lit(False)) for t in terms], F.lit(True))


def any_keyword(column: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_text(column, k) for k in keywords])


def is_chatter(title: Column, excluded: list[str]) -> Column:
    """A question, or a title with an excluded word."""
    return F.endswith(F.regexp_replace(title, "[.,~ ]+$", ""), F.lit("?")) | any_keyword(title, excluded)


def is_subscribed(topics: Column, topic: str) -> Column:
    """Null topics stand for all."""
    return topics.isNull() | F.array_contains(topics, topic)


def passes_genre(kind: Column, genre: Column, restricted: str, wanted: str) -> Column:
    """Restricts one kind only; a null genre passes."""
    return F.coalesce(kind != restricted, F.lit(True)) | F.coalesce(genre == wanted, F.lit(True))


def contains_all(have: Column, required: Column) -> Column:
    return F.size(F.array_except(required, have)) == 0


def is_usable(expires: Column, as_of: Column) -> Column:
    """Strictly before its expiry; no expiry never ends."""
    return expires.isNull() | (expires > as_of)


def keep_filled(values: Column) -> Column:
    """Map entries with a value."""
    return F.map_filter(values, lambda _, v: v.isNotNull() & (v != ""))


def keep_keys(values: Column, allowed: list[str]) -> Column:
    return F.map_filter(values, lambda k, _: k.isin(allowed))


def looks_like_attack(url: Column, patterns: list[str]) -> Column:
    """Any pattern in the URL as it is, decoded once or decoded twice."""
    once = F.coalesce(F.try_url_decode(url), url)
    forms = F.array(url, once, F.coalesce(F.try_url_decode(once), once), F.lower(url), F.lower(once))
    return F.exists(forms, lambda u: any_keyword(u, patterns))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("bigint"))
    fine = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    return F.when(fine, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p))


def in_networks(ip: Column, networks: list[str]) -> Column:
    number = ip_number(ip)
    spans = [ipaddress.ip_network(n) for n in networks]
    tests = [number.between(int(n.network_address), int(n.broadcast_address)) for n in spans]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def access_decision(ip: Column, allowed: list[str], blocked: list[str]) -> Column:
    """Allow lists go before block lists; what is in neither passes."""
    return F.when(in_networks(ip, allowed), "allow").when(in_networks(ip, blocked), "block").otherwise("pass")


def is_loggable(method: Column, accepts: Column, path: Column) -> Column:
    """A page that a person reads: GET, HTML, and none of the paths that only machines ask for."""
    return (method == "GET") & F.contains(accepts, F.lit("text/html")) & ~path.rlike(r"^(up|build/|favicon\.ico|robots\.txt|sw\.js|manifest\.|\.well-known/)")


def all_given(values: dict[str, object]) -> Column:
    """Equality on every column for which a value is given; None asks for nothing."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items() if v is not None], F.lit(True))


def is_valid_row(key: Column, title: Column, price: Column) -> Column:
    """An id and a title that aren't blank, and a price above 0."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled(key) & filled(title) & F.coalesce(price > 0, F.lit(False))


def has_traits(traits: Column, wanted: dict[str, str]) -> Column:
    """Every wanted trait of a map has the wanted value."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.try_element_at(traits, F.lit(k)) == v, F.lit(False)) for k, v in wanted.items()], F.lit(True))
