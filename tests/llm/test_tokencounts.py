from collections import Counter

import pytest
from tokenizers import Tokenizer

from tallyloom.llm.tokencounts import count_tokens, new_rollup
from tallyloom.llm.tokens import tokenizer_path

CHANGE = "kind string, source string, lang string, version string, tokens long, old_tokens long"


def test_counts_are_the_tokenizers(spark, documents, odd_rows):
    rows = [*odd_rows, (30, "Hello, world! It's 2024.", "s")]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = Counter((r["doc_id"], r["tokens"]) for r in count_tokens(documents(rows)).collect())
    assert got == Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)


def test_totals_follow_inserts_deletes_and_revisions(spark):
    rollup = new_rollup(spark)
    assert rollup.totals().count() == 0
    batches = {
        "1": [("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "en", "v1", 7, None), ("insert", "b", None, "v2", None, None)],
        "2": [("revise", "a", "en", "v1", 4, 5), ("delete", None, "en", "v1", 7, None)],
        "3": [],
    }
    for name, rows in batches.items():
        assert rollup.commit(name, spark.createDataFrame(rows, CHANGE))
    for name in ("1", "2"):  # again: nothing changes
        assert not rollup.commit(name, spark.createDataFrame(batches[name], CHANGE))
    got = {tuple(r) for r in rollup.totals().collect()}
    assert got == {("a", "en", "v1", 2, 14), ("b", None, "v2", 1, 0)}


def test_a_batch_that_failed_is_written_anew(spark):
    rollup = new_rollup(spark)
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit("1", spark.createDataFrame([("insert", "a", "en", "v1", 1, None), ("upsert", "a", "en", "v1", 1, None)], CHANGE))
    assert rollup.commit("1", spark.createDataFrame([("insert", "a", "en", "v1", 3, None)], CHANGE))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 3)]


def test_only_finished_batches_count(spark):
    """A folder that was being written counts neither by name nor by what lies in it."""
    rollup = new_rollup(spark)
    one = spark.createDataFrame([("insert", "a", "en", "v1", 3, None)], CHANGE)
    assert rollup.commit("a/b c=1", one) and not rollup.commit("a/b c=1", one)
    one.selectExpr("source", "lang", "version", "1L as docs", "100L as tokens").write.parquet(f"{rollup.path}/new/half/id=x")
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 3)]


def test_what_isnt_there_cannot_be_deleted(spark):
    rollup = new_rollup(spark)
    with pytest.raises(ValueError, match="isn't there"):
        rollup.commit("1", spark.createDataFrame([("delete", "a", "en", "v1", 3, None)], CHANGE))
    assert rollup.totals().count() == 0


def test_compaction_changes_no_total_and_keeps_batches_committed(spark):
    rollup = new_rollup(spark)
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None)], CHANGE)
    assert not rollup.compact()
    for n in (1, 2):
        rollup.commit(f"b{n}", batch(n))
    assert rollup.compact() and not rollup.compact()
    assert not rollup.commit("b1", batch(1)) and rollup.commit("b3", batch(3)) and rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 3, 6)]
    assert not rollup.commit("b3", batch(3))


def insert(spark, n, key="a"):
    return spark.createDataFrame([("insert", key, "en", "v1", n, None)], CHANGE)


def got(rollup):
    return sorted(tuple(r)[3:] for r in rollup.totals().collect())


def test_a_batch_committed_during_compaction_counts_once(spark, monkeypatch):
    """Between the look at the log and the sums another driver commits."""
    rollup = new_rollup(spark)
    other = type(rollup)(spark, rollup.path)
    rollup.commit("1", insert(spark, 1))
    names, late = rollup._names, []

    def slow(state):
        if not late:
            late.append(other.commit("2", insert(spark, 10)))
        return names(state)

    monkeypatch.setattr(rollup, "_names", slow)
    assert rollup.compact() and late == [True]
    assert got(rollup) == got(other) == [(2, 11)]
    assert not other.commit("2", insert(spark, 10)) and not rollup.commit("1", insert(spark, 1))
    assert rollup.compact() and got(rollup) == [(2, 11)]


def test_of_two_drivers_one_takes_a_number_and_the_other_is_judged_again(spark, monkeypatch):
    """Two deletes that each fit alone: the second one to be published is refused; one batch from two drivers counts once."""
    rollup = new_rollup(spark)
    other = type(rollup)(spark, rollup.path)
    rollup.commit("0", insert(spark, 5))
    take = spark.createDataFrame([("delete", "a", "en", "v1", 5, None)], CHANGE)
    publish, turns = rollup._publish, []

    def slow(parts, name):
        if not turns:
            turns.append(other.commit("1", take))
        return publish(parts, name)

    monkeypatch.setattr(rollup, "_publish", slow)
    with pytest.raises(ValueError, match="isn't there"):
        rollup.commit("2", take)
    assert turns == [True] and got(rollup) == []
    turns.clear()
    monkeypatch.setattr(rollup, "_publish", lambda parts, name: (turns or turns.append(other.commit("3", insert(spark, 7)))) and False or publish(parts, name))
    assert not rollup.commit("3", insert(spark, 7)) and got(rollup) == [(1, 7)]


def test_what_a_compaction_replaced_goes_after_the_grace(spark):
    rollup = new_rollup(spark)
    for n in range(1, 4):
        rollup.commit(f"b{n}", insert(spark, n))
        assert rollup.compact(grace_ms=0)
    assert [n for n, _ in rollup._state().log] == [3] and [n for n, _ in rollup.folder.entries("upto")] == [f"{n:012d}" for n in (2, 3)]
    assert got(rollup) == [(3, 6)]
    for n in range(1, 4):
        assert not rollup.commit(f"b{n}", insert(spark, n))
    assert rollup.commit("b4", insert(spark, 4)) and rollup.compact() and got(rollup) == [(4, 10)]
    assert rollup._state().last == 4 and len(rollup._state().log) == 2  # within the grace


def test_estimates_equal_sql(spark):
    """The half of the query that SQL can express: characters over four, rounded up, without documents that have none."""
    import duckdb

    from tallyloom.llm.queries import op6_token_rollup

    where = "/root/testdata/sf0.001"
    have = {tuple(r) for r in op6_token_rollup(spark, where).filter("version = 'chars_4'").select("source", "lang", "docs", "tokens").collect()}
    sql = f"SELECT source, lang, count(*), sum(t)::BIGINT FROM (SELECT source, lang, (coalesce(length(text), 0) + 3) // 4 AS t FROM '{where}/documents.parquet') WHERE t > 0 GROUP BY ALL"
    assert have == set(duckdb.sql(sql).fetchall())
