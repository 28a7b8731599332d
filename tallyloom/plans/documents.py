"""Queries over semi-structured texts: trees, records of lines, imports, and histories with stored pointers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators.lineage import fresh_folder
from tallyloom.operators.pointers import advance
from tallyloom.plans.base import query
from tallyloom.sources.blocks import text_records
from tallyloom.sources.imports import Field, id_or_key, import_rows
from tallyloom.sources.tables import table
from tallyloom.sources.trees import found_values, json_tree, rich_texts
from tallyloom.sources.versions import Versions

# JSON of a page's state: the wanted field at several depths, as text, number and object
_STATE = """CASE event_id % 6
WHEN 0 THEN '{"a":[],"videoId":null}'
WHEN 1 THEN '{"a":[{"videoId":"v' || event_id || '"},{"b":{"videoId":' || event_id || '}}]}'
WHEN 2 THEN '[[{"b":{"c":{"d":[1,{"videoId": "x\\\\"' || event_id || '"}]}}}],{"videoId":{"videoId":"in ' || user_id || '"}}]'
WHEN 3 THEN '{"videoId":[' || event_id || ',' || user_id || ']}'
WHEN 4 THEN '"videoId"'
ELSE '{"videoId":"v' || event_id || '"' END"""


@query(
    "state_search",
    f"""
WITH t AS (SELECT event_id, {_STATE.replace(chr(92) * 2, chr(92))} AS state FROM events),
v AS (SELECT event_id, state::JSON AS state FROM t WHERE json_valid(state))
SELECT event_id, count(*) AS n, string_agg(CASE WHEN j.type = 'NULL' THEN NULL WHEN j.type IN ('OBJECT', 'ARRAY') THEN j.value::VARCHAR ELSE json_extract_string(j.value, '$') END, '|' ORDER BY CASE WHEN j.type = 'NULL' THEN NULL WHEN j.type IN ('OBJECT', 'ARRAY') THEN j.value::VARCHAR ELSE json_extract_string(j.value, '$') END) AS found
FROM v, json_tree(v.state) j WHERE j.key = 'videoId' GROUP BY 1
""",
)
def state_search(spark, d):
    """A field of pages' states wherever it lies, whatever it is."""
    states = table(spark, d, "events").select("event_id", F.expr(_STATE).alias("state"))
    found = found_values(states, "event_id", "state", "videoId")
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_list("found")), "|"), F.lit("")).alias("found"))


@query(
    "state_sizes",
    f"""
WITH t AS (SELECT event_id, {_STATE.replace(chr(92) * 2, chr(92))} AS state FROM events),
v AS (SELECT event_id, state::JSON AS state FROM t WHERE json_valid(state))
SELECT event_id, count(*) AS n, count(*) FILTER (type IN ('OBJECT', 'ARRAY')) AS containers FROM v, json_tree(v.state) j GROUP BY 1
""",
)
def state_sizes(spark, d):
    """Values in pages' states at all depths."""
    states = table(spark, d, "events").select("event_id", F.expr(_STATE).alias("state"))
    return json_tree(states, "event_id", "state").groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin("OBJECT", "ARRAY")).alias("containers"))


@query(
    "rich_blocks",
    """
SELECT event_id, nth, block FROM (SELECT event_id, unnest([0, 1, 2]) AS nth, unnest(['Card ' || event_id || ' at hall ' || (event_id % 4), event_type || '"' || chr(10) || user_id, 'end']) AS block FROM events)
""",
)
def rich_blocks(spark, d):
    """Blocks of rich documents: nested text runs in order, a block within a block apart, empty ones left out."""
    rich = F.expr("""
'{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"Card ' || event_id || '"},{"type":"b","content":[{"type":"text","text":" at hall ' || (event_id % 4) || '"}]}]},'
|| '{"type":"list","content":[{"type":"item","content":[{"type":"text","text":"' || event_type || '\\\\"\\\\n' || user_id || '"}]},{"type":"item","content":[]}]},'
|| '{"type":"paragraph","content":[{"type":"image","src":"text"},{"type":"text","text":"end"},{"type":"text","text":7}]}]}'
""")
    blocks = rich_texts(table(spark, d, "events").select("event_id", rich.alias("rich")), "event_id", "rich", ["paragraph", "item"])
    return blocks.select("event_id", "nth", "block")


@query(
    "score_records",
    """
WITH l AS (SELECT l_orderkey, l_linenumber AS i, l_partkey, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS nth FROM lineitem),
c AS (SELECT *, min(nth) FILTER (i = 4) OVER (PARTITION BY l_orderkey) AS shut, l_orderkey % 7 = 0 AS bad_head, i = 3 AND l_orderkey % 5 = 0 AS bad_row FROM l),
k AS (SELECT *, shut IS NULL OR nth < shut AS inside FROM c WHERE i <> 4),
h AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS bad_head, floor(o_totalprice)::BIGINT AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
g AS (SELECT l_orderkey, count(*) AS n, sum(q)::BIGINT AS quantity FROM k WHERE inside AND NOT bad_row GROUP BY 1)
SELECT o_orderkey, 'record' AS kind, total AS total, g.n AS n, g.quantity FROM h JOIN g ON l_orderkey = o_orderkey WHERE NOT bad_head
UNION ALL SELECT o_orderkey, CASE WHEN bad_head THEN 'header' ELSE 'no rows' END, NULL, 1, NULL FROM h LEFT JOIN g ON l_orderkey = o_orderkey WHERE bad_head OR g.n IS NULL
UNION ALL SELECT l_orderkey, 'row', NULL, count(*), NULL FROM k WHERE inside AND bad_row GROUP BY 1
UNION ALL SELECT l_orderkey, 'header of its record', NULL, count(*), NULL FROM k WHERE inside AND NOT bad_row AND bad_head GROUP BY 1
UNION ALL SELECT l_orderkey, 'no record', NULL, count(*), NULL FROM k WHERE NOT inside GROUP BY 1
""",
)
def score_records(spark, d):
    """Scores with their members from blocks of text, and the lines that fit nowhere, by reason."""
    lines = table(spark, d, "lineitem")
    line = F.when(F.col("l_linenumber") == 4, "").when((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 5 == 0), "members only")
    line = line.otherwise(F.concat_ws("\t", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")))
    body = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", line.alias("line"))))
    bodies = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("body"))
    orders = table(spark, d, "orders").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"))
    total = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    texts = orders.select("o_orderkey", F.concat(F.lit("score\t"), total, F.lit("\n"), "body").alias("text"))
    cell = lambda line, i: F.get(F.split(line, "\t"), F.lit(i))
    good, bad = text_records(
        texts,
        "o_orderkey",
        "text",
        opens=lambda line: cell(line, 0) == "score",
        head=lambda line: {"total": F.regexp_replace(cell(line, 1), ",", "").try_cast("long")},
        row=lambda line: {"part": cell(line, 0).try_cast("long"), "quantity": cell(line, 1).try_cast("long")},
    )
    sums = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["quantity"])
    records = good.select("o_orderkey", F.lit("record").alias("kind"), "total", F.size("rows").cast("long").alias("n"), sums.alias("quantity"))
    rejects = bad.groupBy("o_orderkey", F.col("reason").alias("kind")).agg(F.count("*").alias("n"))
    return records.unionByName(rejects, allowMissingColumns=True)


@query(
    "imported_parts",
    """
WITH t AS (SELECT p_partkey, p_partkey % 17 = 0 AS broken, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 11 <> 1 THEN p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 120)::VARCHAR WHEN 3 THEN '00' || (p_partkey % 90) ELSE 'Supplier#' || lpad((p_partkey % 120)::VARCHAR, 9, '0') END AS ref, CASE WHEN p_partkey % 13 = 0 THEN '2024-13-40' ELSE '2024-02-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') END AS starts_on, CASE WHEN p_partkey % 9 = 0 THEN 'party' WHEN p_partkey % 2 = 0 THEN 'expo' END AS kind FROM part),
r AS (SELECT *, list_filter([CASE WHEN coalesce(title, '') = '' THEN 'missing title' END, CASE WHEN starts_on = '2024-13-40' THEN 'bad starts_on' END, CASE WHEN kind = 'party' THEN 'bad kind' END], lambda x: x IS NOT NULL) AS reasons FROM t)
SELECT p_partkey, CASE WHEN len(reasons) = 0 THEN title END AS title, CASE WHEN len(reasons) = 0 THEN starts_on::DATE END AS starts_on, CASE WHEN len(reasons) = 0 THEN coalesce(kind, 'expo') END AS kind, CASE WHEN len(reasons) = 0 THEN coalesce(a.s_suppkey, b.s_suppkey) END AS s_suppkey, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ', ') END AS reasons
FROM r LEFT JOIN supplier a ON a.s_name = ref LEFT JOIN supplier b ON regexp_full_match(ref, '[0-9]+') AND b.s_suppkey = try_cast(ref AS BIGINT) WHERE NOT broken
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'no JSON object' FROM r WHERE broken
""",
)
def imported_parts(spark, d):
    """Rows of a JSON file that keep a contract, with the supplier they name by key or id, and the rejects with reasons."""
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.expr("case when p_partkey % 5 = 0 then '' when p_partkey % 11 <> 1 then p_name end").alias("title"),
        F.expr("case p_partkey % 4 when 0 then string(p_partkey % 120) when 3 then '00' || (p_partkey % 90) else 'Supplier#' || lpad(p_partkey % 120, 9, '0') end").alias("ref"),
        F.expr("case when p_partkey % 13 = 0 then '2024-13-40' else '2024-02-' || lpad(1 + p_partkey % 28, 2, '0') end").alias("starts_on"),
        F.expr("case when p_partkey % 9 = 0 then 'party' when p_partkey % 2 = 0 then 'expo' end").alias("kind"),
    )
    line = F.when(F.col("p_partkey") % 17 == 0, F.concat(F.lit('{"p_partkey": '), F.col("p_partkey").cast("string"))).otherwise(F.to_json(F.struct("*")))
    path = fresh_folder(spark, "import")
    rows.select(line.alias("value")).write.text(path)
    contract = {
        "p_partkey": Field("long", required=True),
        "title": Field(required=True),
        "ref": Field(),
        "starts_on": Field("date", required=True, pattern=r"^\d{4}-\d{2}-\d{2}$"),
        "kind": Field(values=("expo", "concert"), default="expo"),
    }
    good, bad = import_rows(spark, path, contract)
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name")
    found = id_or_key(good, "ref", suppliers, "s_suppkey", "s_name", "s_suppkey").drop("ref")
    key = F.when(F.col("reasons")[0] != "no JSON object", F.get_json_object("line", "$.p_partkey").cast("long"))
    rejects = bad.select(key.alias("p_partkey"), F.array_join("reasons", ", ").alias("reasons"))
    return found.unionByName(rejects, allowMissingColumns=True)


@query(
    "stored_pointers",
    """
WITH n AS (SELECT conv_id, count(*) FILTER (turn <= 2) AS a, count(*) FILTER (turn <= 4) AS b, count(*) AS c FROM conversations WHERE turn >= 0 GROUP BY 1),
r1 AS (SELECT *, CASE WHEN a > 2 THEN 1 ELSE 0 END AS k1 FROM n), r2 AS (SELECT *, k1 + CASE WHEN b - 2 * k1 > 2 THEN 1 ELSE 0 END AS k2 FROM r1), r3 AS (SELECT *, k2 + CASE WHEN c - 2 * k2 > 2 THEN 1 ELSE 0 END AS k3 FROM r2),
t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, regexp_extract(text, '^\\s*(\\S+)', 1) AS word FROM conversations)
SELECT r3.conv_id, max(turn) AS pointer, max(k3)::BIGINT AS chunks, string_agg(word, ' ' ORDER BY nth) AS words FROM r3 JOIN t ON t.conv_id = r3.conv_id AND nth <= 2 * k3 WHERE k3 > 0 GROUP BY 1
""",
)
def stored_pointers(spark, d):
    """Three runs over growing conversations, each repeated once: every message is compacted once."""
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("nth"), "text")
    pointers = Versions(spark, fresh_folder(spark, "pointers"))
    for run, until in (("first", "nth <= 2"), ("second", "nth <= 4"), ("third", "true")):
        for _ in range(2):
            after = advance(pointers, said.filter(until), run, 2)
    return after.select(F.col("key").alias("conv_id"), "pointer", "chunks", F.replace("summary", F.lit("\n"), F.lit(" ")).alias("words"))
