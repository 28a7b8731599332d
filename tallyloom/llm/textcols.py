"""Column expressions over texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: the ASCII white space \x20 and \x09-\x0D.
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.size(F.array_remove(F.split(text, GAP), "")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a column named inside a lambda is otherwise computed for every element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, add, block: int) -> Column:
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, add)

    def over(wide: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(wide) - 1) / block).cast("int")), lambda j: total(F.slice(wide, j * block + 1, F.lit(block))))
        before = lambda sums: F.transform(
            wide,
            lambda _, i: add(
                total(F.slice(sums, F.lit(1), F.floor(i / block).cast("int"))),
                total(F.slice(wide, (i - i % block + 1).cast("int"), (i % block).cast("int"))),
            ),
        )
        return F.when(F.size(wide) > 0, let(blocks, before)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(values, lambda x: x.cast("long")), over)


def running_sums(values: Column, block: int = 64) -> Column:
    """For each element of an array of whole numbers, the sum of those before it.

    Blocks are summed first, so n elements take about n * (n / block + block) steps and no array is copied for each.
    """
    return _running(values, lambda a, x: a + x, block)


def running_max(values: Column, block: int = 64) -> Column:
    """For each element of an array of numbers of 0 or more, the largest of those before it, 0 for the first."""
    return _running(values, lambda a, x: F.greatest(a, x), block)


def boxed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")


def unboxed(docs: DataFrame, own: tuple[str, ...] = ()) -> list[Column]:
    """The columns of docs back from the struct, without those that the operator gives itself."""
    return [F.col(f"row_.`{c}`").alias(c) for c in docs.columns if c.lower() not in own]
