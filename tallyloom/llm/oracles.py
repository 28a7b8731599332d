"""DuckDB SQL for the training-data queries that SQL can express, written from the definitions."""

#: The kinds of secrets as they are defined: any length, short ones dropped afterwards; and how near linked parts are.
PLAIN = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("identifier", r"""(?i:(user|username|login|account|client_id|access_key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    ("weak_secret", r"""(?i:(pwd|pass|auth|credential|private_key|secret_key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#%^&*-]+)""", 2, 4),
    ("endpoint", r"""(?i:(https?|ftp|jdbc:[a-z]+|postgresql|mysql|redis|amqp|s3))://([A-Za-z0-9._:/@?=&%-]+)""", 2, 4),
]
SCOPE = 256

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || left(md5('mix-1|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, count(*) FILTER (size > 0) AS docs,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos
  FROM d GROUP BY source
), w AS (
  SELECT *, (CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2.0::DOUBLE * words AS cap FROM s
), l AS (
  SELECT *, (sum(words) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
  FROM w WINDOW b AS (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(cap, weight * max(lev) OVER ()) AS target FROM l
), r AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS certain FROM t
), j AS (
  SELECT d.doc_id, d.size, d.u, d.source, r.words, r.target, r.certain, r.target - r.certain * r.words AS rest,
         d.size::DOUBLE / (d.size::DOUBLE + r.words::DOUBLE / r.docs) AS w
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), g AS (
  SELECT source, size, any_value(w) AS w, any_value(rest) AS rest, sum(size)::DOUBLE AS at_size FROM j WHERE size > 0 GROUP BY 1, 2
), o AS (
  SELECT *, (rest - coalesce(sum(at_size) OVER b, 0)) / (sum(w * at_size) OVER (PARTITION BY source) - coalesce(sum(w * at_size) OVER b, 0)) AS factor
  FROM g WINDOW b AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT source, arg_max(factor, size) AS factor FROM o WHERE factor * w <= 1 GROUP BY 1
), p AS (
  SELECT j.*, greatest(1e-9, least(1.0::DOUBLE, coalesce(f.factor, 0) * w)) AS p FROM j LEFT JOIN f ON j.source IS NOT DISTINCT FROM f.source WHERE size > 0
), q AS (
  SELECT *, CASE WHEN p >= 1 THEN 0 ELSE (u / (1 - u)) / (p / (1 - p)) END AS q FROM p
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS through FROM q
), h AS (
  SELECT source, max(rest) - coalesce(sum(size) FILTER (through <= rest), 0) AS missing FROM c GROUP BY source
), z AS (
  SELECT c.source, arg_min(c.doc_id, (abs(h.missing - c.size), c.q, c.doc_id)) AS closing
  FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.through > c.rest AND abs(h.missing - c.size) < h.missing GROUP BY c.source
)
SELECT j.doc_id, j.size, j.words AS source_size, j.target,
       (j.size * (j.certain + CASE WHEN c.through <= c.rest OR c.doc_id = z.closing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j LEFT JOIN c ON c.doc_id = j.doc_id
       LEFT JOIN z ON z.source IS NOT DISTINCT FROM j.source
"""

OP3 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, len(regexp_extract_all(role || chr(10) || text, '<\\*/?s>|\[\\*/?INST\]')) AS escapes FROM c
), a AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role) + length(text) + escapes + 21) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM a
"""


def _op2() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT rid, {i} AS k, '{name}' AS kind, t AS m, g, {group} AS grp, {least} AS least, p FROM (SELECT rid, string_split_regex(text, p) AS g, regexp_extract_all(text, p) AS t, p FROM d, (SELECT '{pattern.replace(chr(39), chr(39) * 2)}' AS p))"
        for i, (name, pattern, group, least) in enumerate(PLAIN)
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED ({kinds}),
u AS (
  SELECT rid, k, kind, grp, least, p, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS i,
         unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s
  FROM f WHERE len(m) > 0
),
x AS (
  SELECT rid, k, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM u
  WHERE length(CASE grp WHEN 2 THEN regexp_extract(m, p, 2) ELSE m END) >= least
),
y AS (
  SELECT * FROM x AS a WHERE k < 3 OR EXISTS (
    SELECT 1 FROM x AS b WHERE b.rid = a.rid AND abs(b.s - a.s) <= {SCOPE} AND (a.k IN (0, 2, 4)) <> (b.k IN (0, 2, 4)))
),
j AS (
  SELECT a.rid, a.s, a.k, arg_min(b.s, (abs(b.s - a.s), b.s, b.k)) FILTER (b.k IN (1, 3)) AS i, arg_min(b.s, (abs(b.s - a.s), b.s)) FILTER (b.k = 5) AS e
  FROM x AS a JOIN x AS b ON b.rid = a.rid AND abs(b.s - a.s) <= {SCOPE} WHERE a.k IN (0, 2, 4) AND b.k IN (1, 3, 5) GROUP BY ALL
),
n AS (SELECT rid, string_agg(s || '>' || coalesce(i::VARCHAR, '') || '>' || coalesce(e::VARCHAR, ''), ',' ORDER BY s, k) AS links FROM j GROUP BY rid),
z AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM y GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links
FROM d LEFT JOIN z USING (rid) LEFT JOIN n USING (rid)
"""


OP2 = _op2()


def _op4() -> str:
    from tallyloom.llm.licenses import CONTAINMENT, SHINGLE, TEMPLATES

    quoted = lambda t: t.replace("'", "''")
    rows = ", ".join(f"('{n}', '{quoted(t)}')" for n, t in TEMPLATES.items())
    words = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    words = words.replace("{{", "{").replace("}}", "}")
    runs = f"unnest(list_transform(range(0, greatest(len(w) - {SHINGLE}, 0) + 1), lambda i: array_to_string(w[i + 1:i + {SHINGLE}], ' '))) AS g, unnest(range(0, greatest(len(w) - {SHINGLE}, 0) + 1)) AS p"
    return rf"""
WITH t AS (SELECT name, {words} AS w FROM (VALUES {rows}) AS v(name, text)),
tg AS (SELECT DISTINCT name, g FROM (SELECT name, {runs} FROM t)),
ts AS (SELECT name, count(*) AS m, greatest(1, count(*) // 2) AS step FROM tg GROUP BY name),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
dg AS (SELECT rid, {runs} FROM d WHERE len(w) > 0),
hit AS (SELECT dg.rid, dg.p, dg.g, ts.* FROM dg JOIN tg USING (g) JOIN ts ON ts.name = tg.name),
win AS (
  SELECT rid, name, m, step, g, unnest(range(greatest(ceil((p - m - step + 1) / step), 0)::BIGINT, p // step + 1)) AS k FROM hit
),
con AS (SELECT rid, name, k * step AS start, count(DISTINCT g) / m AS c FROM win GROUP BY rid, name, k, step, m),
best AS (SELECT rid, name, max(c) AS c, arg_min(start, (-c, start)) AS start FROM con WHERE c >= {CONTAINMENT} GROUP BY rid, name),
s AS (SELECT rid, count(*) AS n, string_agg(name || '@' || start, ',' ORDER BY name) AS l, min(c) AS c FROM best GROUP BY rid)
SELECT d.doc_id, coalesce(s.n, 0) AS n_licenses, coalesce(s.l, '') AS licenses, round(s.c, 6) AS least_containment
FROM d LEFT JOIN s USING (rid)
"""


OP4 = _op4()

#: Phrases of two to four words within pieces, counted as texts; every cut; the greatest count of a longer phrase around each.
OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), words AS (
  SELECT lang, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM cut
), ahead AS (
  SELECT lang, w1, lead(w1, 1) OVER here AS w2, lead(w1, 2) OVER here AS w3, lead(w1, 3) OVER here AS w4 FROM words WINDOW here AS (PARTITION BY id ORDER BY i)
), grams AS (
  SELECT lang, 1 AS m, w1 AS phrase FROM ahead
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead WHERE w4 IS NOT NULL
), f AS (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM cut GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2
), around AS (
  SELECT lang, array_to_string(ws[j : j + size - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, (SELECT unnest([1, 2, 3]) AS j), (SELECT unnest([2, 3]) AS size)
  WHERE size < m AND j + size - 1 <= m GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ((c.a::HUGEINT * 2000000) // (l.a + r.a)::HUGEINT)::BIGINT AS score
  FROM candidates c, (SELECT unnest([1, 2, 3]) AS k), f l, f r
  WHERE k < c.m AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : k], ' ') AND r.phrase = array_to_string(c.ws[k + 1 : c.m], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
  FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 80 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
