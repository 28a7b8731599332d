"""Records that span lines of a text: a header opens one, rows fill it, a blank line or the next header closes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines_of_records(texts: DataFrame, key: str, text: str, opens: Callable[[Column], Column], closes: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, at, line, kind, record): each line with what it does and the record it belongs to.

    kind is header, row, blank or stray; record is the line number of the record's header, null for blank and stray lines.
    The state before a line is the last header and the last closing line before it, so the automaton is two running
    maxima over a text's lines. closes: lines that end a record (blank ones if not given).
    """
    closes = closes or (lambda line: F.trim(line) == "")
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    before = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    line = F.col("line")
    header, blank = F.coalesce(opens(line), F.lit(False)), F.coalesce(closes(line), F.lit(False))
    marked = lines.withColumns({"header_": header, "blank_": blank & ~header})
    marked = marked.withColumns({"open_": F.max(F.when(F.col("header_"), F.col("at"))).over(before), "shut_": F.max(F.when(F.col("blank_"), F.col("at"))).over(before)})
    inside = F.col("open_").isNotNull() & (F.col("shut_").isNull() | (F.col("open_") > F.col("shut_")))
    kind = F.when(F.col("header_"), "header").when(F.col("blank_"), "blank").when(inside, "row").otherwise("stray")
    return marked.select(key, "at", "line", kind.alias("kind"), F.when(inside, F.col("open_")).alias("record"))


def text_records(texts: DataFrame, key: str, text: str, opens: Callable[[Column], Column], head: Callable[[Column], dict[str, Column]], row: Callable[[Column], dict[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(records: key, record, the header's fields, rows; rejects: key, at, line, reason).

    head and row give the fields of a line. A record is good if no field of its header is null and it has a row; its rows
    are those without a null field, in order. Whatever else is rejected with the reason, so every line but blank ones is
    in one of both tables.
    """
    lines = lines_of_records(texts, key, text, opens)
    names = list(head(F.col("line")))
    heads = lines.filter("kind = 'header'").select(key, "at", "line", *[c.alias(n) for n, c in head(F.col("line")).items()])
    fields = row(F.col("line"))
    complete = F.lit(True)
    for c in fields.values():
        complete = complete & c.isNotNull()
    parsed = lines.filter("kind = 'row'").select(key, "at", "line", "record", F.when(complete, F.struct(*[c.alias(n) for n, c in fields.items()])).alias("row_"))
    filled = parsed.filter("row_ is not null").groupBy(key, F.col("record").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "row_"))).alias("rows_"))
    joined = heads.join(filled, [key, "at"], "left")
    fine = F.lit(True)
    for n in names:
        fine = fine & F.col(n).isNotNull()
    reason = F.when(~fine, "header").when(F.col("rows_").isNull(), "no rows")
    judged = joined.withColumn("reason", reason)
    good = judged.filter("reason is null").select(key, F.col("at").alias("record"), *names, F.transform("rows_", lambda r: r["row_"]).alias("rows"))
    bad = judged.filter("reason is not null").select(key, "at", "line", "reason")
    orphans = parsed.filter("row_ is not null").select(key, F.col("record").alias("of_"), "at", "line").join(bad.filter("reason = 'header'").select(key, F.col("at").alias("of_")), [key, "of_"])
    rejects = bad.union(parsed.filter("row_ is null").select(key, "at", "line", F.lit("row")))
    rejects = rejects.union(orphans.select(key, "at", "line", F.lit("header of its record"))).union(lines.filter("kind = 'stray'").select(key, "at", "line", F.lit("no record")))
    return good, rejects
