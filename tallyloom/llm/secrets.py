"""Secret scans with multipart credential linking, on DataFrame functions only.

Three base kinds are certain enough to report alone: assigned secrets, access identifiers and long hex runs. Three weak
kinds (identifiers, short or loosely named secrets, endpoints) are reported only where complementary parts co-occur:
an identifier or an endpoint with a secret, a secret with an identifier or an endpoint. Parts are interval-joined
within their scope: the same document, starts at most ``scope`` code points apart. Parts of one kind don't overlap, so
the parts in scope of a part are among a fixed number of neighbours in the order of starts, and the join looks at
those alone.

Defined cases: a null text is empty and has no spans; spans count code points, ends are exclusive; equal rows are
scanned alike; an empty table gives an empty result; other columns pass through, except that ``secret_spans``,
``secret_links`` and ``redacted_text`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textcols import boxed, let, running_max, running_sums, unboxed

# The kinds, with the group and the least length that a match must have. Where a run of characters is the
# whole match, its least length is in the pattern: the runs found are the same, and the short ones are never listed.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("identifier", r"""(?i:(user|username|login|account|client_id|access_key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    ("weak_secret", r"""(?i:(pwd|pass|auth|credential|private_key|secret_key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#%^&*-]+)""", 2, 4),
    ("endpoint", r"""(?i:(https?|ftp|jdbc:[a-z]+|postgresql|mysql|redis|amqp|s3))://([A-Za-z0-9._:/@?=&%-]+)""", 2, 4),
)
KINDS = BASE + WEAK
SCOPE = 256
#: No match of any kind is shorter, so no more starts of one kind fit into a scope than SCOPE / LEAST + 1.
LEAST = 5


NO_LINKS = "array<struct<secret:struct<start:bigint,end:bigint>,identifier:struct<start:bigint,end:bigint>,endpoint:struct<start:bigint,end:bigint>>>"
NO_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, kind: int) -> Column:
    """Kept matches of a kind as structs of start, kind's position and end: gaps and matches of the text alternate."""
    _, pattern, group, least = KINDS[kind]

    def located(found: Column, gaps: Column) -> Column:
        whole = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.length(m))
        starts = F.zip_with(running_sums(whole), F.slice(gaps, F.lit(1), F.size(found)), lambda before, gap: before + gap)
        spans = F.zip_with(
            found,
            starts,
            lambda m, s: F.struct(
                s.alias("start"),
                F.lit(kind).alias("kind"),
                (s + F.length(m)).alias("end"),
                F.length(F.regexp_extract(m, pattern, group) if group else m).alias("size"),
            ),
        )
        fine = F.filter(spans, lambda s: s["size"] >= least)
        return F.transform(fine, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), gaps.alias("gaps"))
    kept = let(both, lambda x: located(x["found"], x["gaps"]))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(NO_SPANS))


def _linked(parts: Column, scope: int) -> Column:
    """Of the parts in order, the base ones and the weak ones that have a complement in scope."""
    base = len(BASE)
    reach = len(KINDS) * (scope // LEAST + 1)
    is_secret = lambda k: k.isin(0, 2, base + 1)
    near = lambda ps, i: F.slice(ps, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
    met = lambda a, b: (F.abs(a["start"] - b["start"]) <= scope) & (is_secret(a["kind"]) != is_secret(b["kind"]))
    kept = let(parts, lambda ps: F.filter(ps, lambda p, i: (p["kind"] < base) | F.exists(near(ps, i), lambda o: met(p, o))))
    return F.when(F.exists(parts, lambda p: p["kind"] >= base), kept).otherwise(parts)


def _links(parts: Column, scope: int) -> Column:
    """For each secret with an identifier or an endpoint in scope, the nearest of both, then the first."""
    base = len(BASE)
    reach = len(KINDS) * (scope // LEAST + 1)
    near = lambda ps, i: F.slice(ps, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))

    def nearest(s: Column, around: Column, *kinds: int) -> Column:
        met = F.filter(around, lambda o: o["kind"].isin(*kinds) & (F.abs(o["start"] - s["start"]) <= scope))
        return F.array_min(F.transform(met, lambda o: F.struct(F.abs(o["start"] - s["start"]).alias("distance"), o["start"].alias("start"), o["kind"].alias("kind"), o["end"].alias("end"))))

    def link(s: Column, around: Column) -> Column:
        who, where = nearest(s, around, 1, base), nearest(s, around, base + 2)
        span = lambda x: F.when(x.isNotNull(), F.struct(x["start"].alias("start"), x["end"].alias("end")))
        return F.struct(F.struct(s["start"].alias("start"), s["end"].alias("end")).alias("secret"), span(who).alias("identifier"), span(where).alias("endpoint"))

    made = let(parts, lambda ps: F.transform(ps, lambda p, i: F.when(p["kind"].isin(0, 2, base + 1), link(p, near(ps, i)))))
    whole = F.filter(made, lambda m: m["identifier"].isNotNull() | m["endpoint"].isNotNull())
    other = lambda p: p["kind"].isin(1, base, base + 2)
    return F.when(F.exists(parts, other), whole).otherwise(F.array().cast(NO_LINKS))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every stretch that spans cover replaced by a mark."""
    ends = F.transform(spans, lambda s: s["end"])
    piece = lambda s, covered: F.when(
        (s["start"] >= covered) & ((s["start"] > 0) | (covered == 0)),
        F.concat(F.substring(text, (covered + 1).cast("int"), (s["start"] - covered).cast("int")), F.lit(mark)),
    ).otherwise("")
    tail = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.zip_with(spans, running_max(ends), piece), ""), tail))


def scan_secrets(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with secret_spans (start, kind, end; by start, then kind), secret_links and redacted_text.

    A link joins a secret with the nearest identifier and the nearest endpoint in its scope; either may be missing.
    """
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    kept = docs.select(boxed(docs), F.coalesce(F.col("text"), F.lit("")).alias("text_"))
    kept = kept.withColumns({f"k{i}_": _spans(F.col("text_"), i) for i in range(len(KINDS))})
    kept = kept.withColumn("parts_", F.array_sort(F.concat(*[F.col(f"k{i}_") for i in range(len(KINDS))])))
    kept = kept.withColumn("parts_", _linked(F.col("parts_"), scope))
    named = F.transform(F.col("parts_"), lambda p: F.struct(p["start"].alias("start"), names[p["kind"]].alias("kind"), p["end"].alias("end")))
    redacted = F.when(F.col("row_.text").isNotNull(), _redacted(F.col("text_"), F.col("parts_"), mark))
    own = ("secret_spans", "secret_links", "redacted_text")
    return kept.select(*unboxed(docs, own), named.alias("secret_spans"), _links(F.col("parts_"), scope).alias("secret_links"), redacted.alias("redacted_text"))


def redact_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with the secrets in their texts replaced; n_chars follows where the text changed."""
    row = docs.select(boxed(docs), F.col("text"))
    seen = scan_secrets(row, scope)
    changed = F.size("secret_spans") > 0
    out = {"text": F.col("redacted_text"), "n_chars": F.when(changed, F.length("redacted_text").cast("long")).otherwise(F.col("row_.n_chars"))}
    return seen.select(*[out.get(c, F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])
