"""Text functions over Columns."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_title(title: Column, drop: str, aliases: list[tuple[str, str]], least: int = 5) -> Column:
    """Lower-cased words without ``drop`` patterns and punctuation, aliases replaced on whole words.

    A result under ``least`` characters falls back to the lower-cased title as it was, without aliases.
    """
    lowered = F.lower(F.trim(title))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(lowered, drop, " "), r"[^\p{L}\p{N}]+", " "), " +", " "))
    padded = reduce(lambda c, a: F.replace(c, F.lit(f" {a[0]} "), F.lit(f" {a[1]} ")), aliases, F.concat(F.lit(" "), words, F.lit(" ")))
    return F.when(F.length(words) < least, lowered).otherwise(F.trim(padded))


def distinctive_tokens(normalised: Column, stopwords: list[str]) -> Column:
    """Distinct words that are neither stopwords nor digits only, in first-seen order."""
    return F.array_distinct(F.filter(F.split(normalised, " +"), lambda t: (t != "") & ~t.isin(stopwords) & ~t.rlike(r"^\d+$")))


def signature(tokens: Column, compact: Column) -> Column:
    """Sorted tokens; with fewer than two, the compact title."""
    return F.when(F.size(tokens) >= 2, F.array_join(F.array_sort(tokens), " ")).otherwise(compact)


def first_hit(text: Column, dictionary: list[tuple[str, str]]) -> Column:
    """Code of the first entry, in dictionary order, whose keyword occurs."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(k.lower())), F.lit(code)) for k, code in dictionary])


def maker_code(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """prefix_number of the first pattern (with one group for the number) that matches."""
    tests = [(p, F.regexp_extract(F.lower(text), pattern, 1)) for p, pattern in patterns]
    return F.coalesce(*[F.when(number != "", F.concat(F.lit(f"{p}_"), number)) for p, number in tests])


def name_key(name: Column) -> Column:
    """A name without blanks and colons, lower-cased."""
    return F.lower(F.regexp_replace(F.trim(name), r"[\s:：]+", ""))


def wide_name_key(name: Column) -> Column:
    """A name without blanks, dots, dashes and brackets, lower-cased."""
    return F.lower(F.regexp_replace(F.trim(name), r"[\s:：.·\-_()\[\]]+", ""))


def scale_of(text: Column) -> Column:
    """The n of a scale 1/n from 2 to 12."""
    n = F.regexp_extract(text, r"(?<!\d)1/(\d{1,2})(?!\d)", 1).try_cast("int")
    return F.when(n.between(2, 12), n)


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """Keywords that occur, sorted."""
    return F.array_sort(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(text), k)))


def artist_tokens(title: Column, stopwords: list[str]) -> Column:
    """Words of two characters or more that are neither stopwords nor numbers."""
    words = F.split(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(stopwords) & ~t.rlike(r"^\d+$")))


def is_code_token(token: Column, denied: list[str]) -> Column:
    """4 to 30 letters and digits, mostly upper case, with a letter; tokens under 6 characters need a digit."""
    letters = F.length(F.regexp_replace(token, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(token, "[^A-Z]", ""))
    return token.rlike("^[A-Za-z0-9]{4,30}$") & (letters > 0) & (upper >= 0.6 * letters) & ((F.length(token) >= 6) | token.rlike("[0-9]")) & ~F.upper(token).isin(denied)


#: Names of characters in HTML, as the standard library has them.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def decoded(text: Column) -> Column:
    """Text with numbered and named characters of HTML in place of their codes, each code read once; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def character(code: Column) -> Column:
        hexadecimal = F.regexp_extract(code, r"^&#[xX]([0-9A-Fa-f]+);$", 1)
        number = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(F.regexp_extract(code, r"^&#([0-9]+);$", 1)).try_cast("int")
        real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        named = F.element_at(names, F.regexp_extract(code, r"^&(.*);$", 1))
        return F.coalesce(F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")), named, code)

    codes, parts = F.regexp_extract_all(text, F.lit(_ENTITY), 0), F.split(text, _ENTITY, -1)
    joined = F.concat(parts[0], F.array_join(F.zip_with(F.transform(codes, character), F.slice(parts, F.lit(2), F.size(codes)), lambda a, b: F.concat(a, b)), ""))
    return F.when(F.size(codes) > 0, joined).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text: scripts and styles dropped, tags blanked, characters decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    bare = decoded(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(bare, r"[\s\x{a0}]+", " "))


def url_host(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def absolute_url(url: Column, base: str) -> Column:
    root = base.split("//")[0] + "//" + base.split("//")[1].split("/")[0]
    return F.when(url.rlike("^[a-zA-Z]+://"), url).when(F.startswith(url, F.lit("//")), F.concat(F.lit(base.split("//")[0]), url)).when(F.startswith(url, F.lit("/")), F.concat(F.lit(root), url)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), url))


# Fixed value: how the video site's addresses begin.
VIDEO = r"(?:youtube(?:-nocookie)?\.com/(?:watch\?v=|embed/)|youtu\.be/)([A-Za-z0-9_-]{6,})"


def video_id(url: Column) -> Column:
    """The id in an address of the video site, of six characters or more."""
    return F.nullif(F.regexp_extract(url, VIDEO, 1), F.lit(""))


# What agents of each class hold, tested in this order.
BOTS = "bot|crawl|spider|slurp|bingpreview|facebookexternalhit|embedly|curl|wget|python-requests|axios|headless|lighthouse|pingdom|uptime"
TABLETS = "ipad|tablet|playbook|silk|android(?!.*mobile)"
MOBILES = "mobile|iphone|ipod|android|blackberry|iemobile|opera mini|windows phone"


def device_class(agent: Column) -> Column:
    """bot, tablet, mobile or pc, tested in this order; an unknown agent is a pc."""
    a = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(a.rlike(BOTS), "bot").when(a.rlike(TABLETS), "tablet").when(a.rlike(MOBILES), "mobile").otherwise("pc")


def stage_labels(title: Column, known: list[str], word: str = "Challenge", spellings: str = "challenge|chal", extra: str = "ex") -> Column:
    """Labels such as "Challenge 03" or "Challenge EX" that a title names, in first-seen order; only known ones."""
    found = F.regexp_extract_all(F.lower(title), F.lit(rf"(?:{spellings})\s*[.\-]?\s*({extra}|\d+)"), 1)
    number = lambda t: F.regexp_replace(t, "^0+(?=.)", "")
    padded = lambda t: F.when(F.length(number(t)) < 2, F.lpad(number(t), 2, "0")).otherwise(number(t))
    labels = F.transform(found, lambda t: F.concat(F.lit(f"{word} "), F.when(t.rlike(r"^\d+$"), padded(t)).otherwise("EX")))
    return F.array_distinct(F.filter(labels, lambda x: x.isin(known)))


def tolerant_json(text: Column) -> Column:
    """JSON out of a fenced block, white space collapsed; null if it isn't JSON."""
    return F.try_parse_json(F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)^\s*```(?:json)?|```\s*$", ""), r"\s+", " ")))


def recovered_field(text: Column, field: str) -> Column:
    """A string field of broken JSON."""
    return F.nullif(F.regexp_extract(text, rf'"{field}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))


def mentions(text: Column, names: list[str], most: int = 10) -> Column:
    """Names that a text mentions, by first position; longer names claim a stretch first, a name starts no word's middle."""
    longest_first = "|".join(_quoted(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    found = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{longest_first})"), 0)
    return F.slice(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))), 1, most)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def token_difference(a: list[str], b: list[str]) -> tuple[int, list[str], list[str]]:
    """How many words are shared, and the words of a alone and of b alone.

    A word of one side that any two different words of the other make up in either order is shared too, and uses up both.
    """
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    left, right = [t for t in a if t not in b], [t for t in b if t not in a]
    shared = len(a) - len(left)
    for whole, parts in ((left, right), (right, left)):
        for word in list(whole):
            pair = next(((x, y) for x in parts for y in parts if x is not y and x + y == word), None)
            if pair:
                whole.remove(word)
                parts.remove(pair[0])
                parts.remove(pair[1])
                shared += 1
    return shared, left, right


def is_rigid(word: str, rigid: frozenset[str]) -> bool:
    """Whether a word holds one that tells variants of a product apart."""
    return any(r in word for r in rigid)


def word_variant(a: str, b: str, rigid: frozenset[str] = frozenset()) -> bool:
    """Equal, one within the other, or two characters of common start; the last doesn't hold for rigid words."""
    if a == b or (a and b and (a in b or b in a)):
        return True
    if is_rigid(a, rigid) or is_rigid(b, rigid):
        return False
    return len(a) > 1 and len(b) > 1 and a[:2] == b[:2]


def reconcilable(a: list[str], b: list[str], rigid: frozenset[str] = frozenset()) -> bool:
    """Every word of either side has a variant on the other."""
    return all(any(word_variant(x, y, rigid) for y in b) for x in a) and all(any(word_variant(y, x, rigid) for x in a) for y in b)


def similar_words(a: list[str], b: list[str], least: int, rigid: frozenset[str] = frozenset()) -> bool:
    """Enough words shared, no rigid word left over, and what is left over on both sides is reconcilable."""
    shared, left, right = token_difference(a, b)
    if shared < least or any(is_rigid(t, rigid) for t in left + right):
        return False
    return not left or not right or reconcilable(left, right, rigid)


def conflicting_words(a: list[str], b: list[str], rigid: frozenset[str] = frozenset()) -> bool:
    """Both sides have words of their own, and these are not reconcilable."""
    _, left, right = token_difference(a, b)
    return bool(left) and bool(right) and not reconcilable(left, right, rigid)


def _over_pairs(rule, kind: str):
    @F.pandas_udf(kind)
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rule(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    return pairs


def tokens_similar(least: int, rigid: frozenset[str] = frozenset()):
    """A pandas UDF over two token arrays: similar_words."""
    return _over_pairs(lambda x, y: similar_words(x, y, least, rigid), "boolean")


def tokens_conflict(rigid: frozenset[str] = frozenset()):
    """A pandas UDF over two token arrays: conflicting_words."""
    return _over_pairs(lambda x, y: conflicting_words(x, y, rigid), "boolean")


def shared_words():
    """A pandas UDF over two token arrays: how many words are shared."""
    return _over_pairs(lambda x, y: token_difference(x, y)[0], "int")


def code_after(text: Column, markers: list[str]) -> Column:
    """The first code of letters and digits after one of the markers."""
    return F.nullif(F.regexp_extract(text, rf"(?:{'|'.join(markers)})\s*[:：]?\s*([A-Za-z0-9]{{4,30}})", 1), F.lit(""))


def text_between(text: Column, start: str, end: str) -> Column:
    """What stands between two markers, trimmed."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s){start}\s*[:：]?(.*?)(?:{end}|$)", 1)), F.lit(""))


def code_candidates(text: Column, denied: list[str]) -> Column:
    """Code tokens of a text, one for each upper-case form, in first-seen order.

    Two or three neighbouring words of five upper-case letters or more are one code, glued, if that looks like a code and
    none of the words is denied; the words are no codes of their own then.
    """
    phrases = F.regexp_extract_all(text, F.lit(r"\b(?:[A-Z]{5,}\s+){1,2}[A-Z]{5,}\b"), 0)
    words = F.transform(phrases, lambda p: F.split(p, r"\s+"))
    glued = F.filter(words, lambda ws: ~F.exists(ws, lambda w: w.isin(denied)) & is_code_token(F.array_join(ws, ""), denied))
    used = F.flatten(glued)
    single = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{4,30}"), 0), lambda t: is_code_token(t, denied) & ~F.array_contains(used, F.upper(t)))
    found = F.concat(F.transform(glued, lambda ws: F.array_join(ws, "")), single)
    keys = F.array_distinct(F.transform(found, lambda t: F.upper(t)))
    return F.transform(keys, lambda k: F.element_at(F.filter(found, lambda t: F.upper(t) == k), -1))


def artist_name(title: Column, keywords: list[str], most: int = 4) -> Column:
    """The title's words before a keyword or a year, at most four."""
    words = F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != "")
    stop = F.transform(words, lambda w, i: F.when(F.lower(w).isin([k.lower() for k in keywords]) | w.rlike(r"^(19|20)\d\d\D*$"), i))
    cut = F.coalesce(F.array_min(stop), F.size(words))
    return F.array_join(F.slice(words, F.lit(1), F.least(cut, F.lit(most))), " ")


def reward_text(rewards: Column, most: int = 6) -> Column:
    """An array of (name, count) as one line: "name xcount", the first six."""
    one = lambda r: F.concat(r["name"], F.when(r["count"].isNotNull(), F.concat(F.lit(" x"), r["count"].cast("string"))).otherwise(""))
    return F.array_join(F.transform(F.slice(rewards, 1, most), one), ", ")


def reward_line(rewards: Column, most: int = 6) -> Column:
    """Rewards in JSON (a string, or a list of strings and of objects with name and count or amount) as one line.

    The first six that aren't empty are joined; counts of 0 are left out; null where nothing is left.
    """
    value = F.try_parse_json(rewards)
    got = lambda v, path: F.trim(F.try_variant_get(v, path, "string"))
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)
    given = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "0", "false"), c)

    def line(one: Column) -> Column:
        name, count = given(got(one, "$.name")), given(F.coalesce(got(one, "$.count"), got(one, "$.amount")))
        named = F.when(count.isNotNull(), F.concat(name, F.lit(" x"), count)).otherwise(name)
        return F.when(kind(one) == "STRING", given(got(one, "$"))).when(kind(one) == "OBJECT", named)

    lines = F.slice(F.array_compact(F.transform(F.try_variant_get(value, "$", "array<variant>"), line)), 1, most)
    text = F.nullif(got(value, "$"), F.lit(""))
    return F.when(kind(value) == "STRING", text).when(F.size(lines) > 0, F.array_join(lines, ", "))


def summary_line(parts: dict[str, Column]) -> Column:
    """Labels with the values that are there, parted by dots."""
    return F.concat_ws(" · ", *[F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k} "), v.cast("string"))) for k, v in parts.items()])


def translated(value: Column, table: dict[str, str]) -> Column:
    """By a closed vocabulary; what isn't in it passes."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, value), value)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def truncated(text: Column, n: int, ellipsis: bool = False) -> Column:
    """The first n characters; with an ellipsis, which counts as one of them, where something is cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text) if ellipsis else F.left(text, F.lit(n))


def alias_code(text: Column, aliases: dict[str, list[str]]) -> Column:
    """The code itself, or the first code one of whose aliases occurs in the text or holds it."""
    t = F.lower(F.trim(text))
    tests = [F.when(t == c.lower(), F.lit(c)) for c in aliases]
    tests += [F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(x.lower())) | (F.contains(F.lit(x.lower()), t) & (t != "")) for x in names]), F.lit(c)) for c, names in aliases.items()]
    return F.coalesce(*tests)


def kept_maker_code(code: Column, title: Column, accessories: list[str], barcode: str = "jan_") -> Column:
    """An accessory's title bears its main product's line number, so only a barcode is kept for it."""
    bears = F.size(keywords_in(title, accessories)) > 0
    return F.when(F.startswith(code, F.lit(barcode)) | ~bears, code)


def set_variant(title: Column, word: str = "set") -> Column:
    """What follows the word "set", without blanks, lower-cased; empty if nothing does."""
    return F.lower(F.regexp_replace(F.regexp_extract(title, rf"(?i){word}\s*([a-z0-9][a-z0-9.&\s]{{0,12}})", 1), r"\s+", ""))


def number_variant(title: Column) -> Column:
    """Distinct numbers of up to four digits outside brackets and scales, sorted as texts and joined by dots."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(title), r"\[.*?\]|\(.*?\)|【.*?】", " "), r"\d+\s*/\s*\d+", " ")
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b\d{1,4}\b"), 0))), ".")


def loose_scale(text: Column) -> Column:
    """The first d/dd of a text, blanks dropped; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(\d\s*/\s*\d{1,2})", 1), r"\s", ""), F.lit(""))


def promoted_category(category: Column, title: Column, accessories: list[str], to: str) -> Column:
    """Listings with a strict scale that are no accessories go to the category of scale models."""
    strict = scale_of(F.regexp_replace(title, r"\s*/\s*", "/")).isNotNull() & (F.size(keywords_in(title, accessories)) == 0)
    return F.when(strict, F.lit(to)).otherwise(category)


def valid_listing(code: Column, barcode: Column) -> Column:
    """New goods (no code ends in -R) with a barcode of 8 to 13 digits."""
    return ~F.endswith(F.upper(code), F.lit("-R")) & F.length(F.regexp_replace(F.coalesce(barcode, F.lit("")), r"\D", "")).between(8, 13)


def emphasised_codes(html: Column, denied: list[str], most: int = 25) -> Column:
    """Code tokens that stand alone in an emphasised element, in the page's order, at most so many."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<(strong|b|code|td|mark|h3|h4)(?:\s[^>]*)?>(.*?)</\1>"), 2)
    texts = F.transform(inner, lambda t: F.trim(F.regexp_replace(t, "<[^>]*>", "")))
    return F.slice(F.array_distinct(F.filter(texts, lambda t: is_code_token(t, denied))), 1, most)


def links_in_order(html: Column, pattern: str) -> Column:
    """What the pattern's group holds in links, distinct, ranked by first appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf'href="{pattern}"'), 1))


def tail_after(text: Column, marker: str) -> Column:
    """The JSON after the last marker, as a variant; null if there is no marker or no JSON."""
    return F.when(F.contains(text, F.lit(marker)), F.try_parse_json(F.trim(F.substring_index(text, marker, -1))))


def head_before(text: Column, marker: str) -> Column:
    return F.trim(F.when(F.contains(text, F.lit(marker)), F.regexp_replace(text, rf"(?s){_quoted(marker)}(?!.*{_quoted(marker)}).*$", "")).otherwise(text))


def first_nonzero_label(values: Column, labels: list[str]) -> Column:
    """The label at the place of the first number that isn't zero."""
    places = F.filter(F.transform(values, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    return F.get(F.array(*[F.lit(x) for x in labels]), F.get(places, F.lit(0)).cast("int"))


def typed_slots(members: Column, first: int = 4, lead: str = "main", rest: str = "support") -> Column:
    """Members with the kind of their slot: the first few and the rest."""
    return F.transform(members, lambda m, i: F.struct(m.alias("member"), F.when(i < first, lead).otherwise(rest).alias("slot")))


def first_plausible_line(text: Column) -> Column:
    """The first line that begins with a letter: no date, time or tag."""
    return F.get(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\p{L}")), F.lit(0))
