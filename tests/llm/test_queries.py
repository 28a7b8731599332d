import duckdb
import pytest

from tallyloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    tidy = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted(map(repr, (tidy(r) for r in got.select(*names).collect()))) == sorted(map(repr, (tidy(r) for r in want.fetchall())))


def test_all_operators_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))


def test_rollup_holds_the_exact_totals(spark):
    from tallyloom.llm.tokencounts import count_tokens

    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in QUERIES["op6_token_rollup"](spark, SF).filter("version = 'word_bpe_49k'").collect()}
    docs = count_tokens(spark.read.parquet(f"{SF}/documents.parquet")).filter("tokens > 0")
    want = {(r["source"], r["lang"]): (r["n"], r["t"] + r["n"]) for r in docs.groupBy("source", "lang").agg({"tokens": "sum", "*": "count"}).toDF("source", "lang", "t", "n").collect()}
    assert got == want
