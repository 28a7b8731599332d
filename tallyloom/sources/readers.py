"""Readers of semi-structured input: JSON lists, HTML tables, feeds, embedded data and text blocks.

Fetching is not done here; every reader starts from files or from a column of page bodies.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.lineage import checkpointed


def read_json_list(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON files of objects, and the rejected ones: those that don't parse or lack a required field."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    fine = F.col("_corrupt_record").isNull()
    for c in required:
        fine = fine & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return rows.filter(fine).drop("_corrupt_record"), rows.filter(~fine)


def first_that_reads(readers: list, failures: list | None = None) -> DataFrame | None:
    """The first reader's result that has rows; None where all fail or are empty, so that old data can stay.

    failures gathers (place in the list, error) of the readers that fail.
    """
    for at, read in enumerate(readers):
        try:
            rows = read()
            if not rows.isEmpty():
                return rows
        except Exception as failed:  # noqa: BLE001  a source that is down is what the next one is for
            if failures is not None:
                failures.append((at, failed))
    return None


def feed_items(pages: DataFrame, body: str) -> DataFrame:
    """Items of RSS bodies: title, link, published; CDATA unwrapped."""
    field = lambda c, name: F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))
    items = pages.withColumn("item_", F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1)))
    return items.select(*[c for c in pages.columns if c != body], *[field(F.col("item_"), n).alias(a) for n, a in (("title", "title"), ("link", "link"), ("pubDate", "published"))])


def json_ld(html: Column, kind: str) -> Column:
    """Embedded JSON-LD objects of a type, as variants."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    return F.filter(parsed, lambda v: F.try_variant_get(v, "$.@type", "string") == kind)


def json_objects(column: Column) -> Column:
    """Objects of a JSON text that is an object, a list, or a list wrapped in ``data`` or ``items``."""
    v = F.try_parse_json(column)
    as_list = lambda path: F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(as_list("$"), as_list("$.data"), as_list("$.items"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))


def path_or(value: Column, path: str, kind: str, default: Column) -> Column:
    """What a variant has at a path, or the default."""
    return F.coalesce(F.try_variant_get(value, path, kind), default)


def state_values(text: Column, field: str) -> Column:
    """String values of a field wherever it lies in a JSON text, in its order."""
    return F.regexp_extract_all(text, F.lit(rf'"{field}"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1)


def rich_text(text: Column) -> Column:
    """Visible text of a rich document in JSON: its "text" strings in order."""
    parts = state_values(text, "text")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), p, F.lit('"'))), "$", "string"), p)), "")


def elements(html: Column, tag: str, css: str | None = None) -> Column:
    """Inner HTML of the elements of a tag (and a class), in order; an element of the same tag within one ends it."""
    attribute = rf"""(?=[^>]*\bclass\s*=\s*["'][^"']*\b{css}\b)""" if css else ""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b{attribute}[^>]*>(.*?)</{tag}\s*>"), 1)


def element_texts(html: Column, tag: str, css: str | None = None) -> Column:
    """Texts of the elements of a tag (and a class), without markup."""
    return F.transform(elements(html, tag, css), lambda e: F.trim(F.regexp_replace(F.regexp_replace(e, "<[^>]*>", " "), r"\s+", " ")))


#: Bodies whose tags are plain, without characters in codes, comments or what a parser reads by other rules.
_PLAIN = re.compile(r"""(?:[^<&]+|</?(?:table|thead|tbody|tfoot|tr|td|th|b|i|p|a|ul|li|div|span)(?:\x20[a-z]+="[^"<>&]*")*>)*""")
_CELL_TAGS = re.compile(r"<[^>]*>|[^<]+")


def _plain_rows(body: str) -> list[list[str]]:
    """What _Tables makes of a plain body."""
    rows, row, cell = [], None, None
    for part in _CELL_TAGS.findall(body):
        if part[0] != "<":
            if cell is not None:
                cell.append(part)
        elif part.startswith(("<td>", "<th>", "<td ", "<th ")):
            cell = [] if row is not None else cell
        elif part in ("</td>", "</th>"):
            if cell is not None and row is not None:
                row.append(" ".join("".join(cell).split()))
            cell = None
        elif part.startswith(("<tr>", "<tr ")):
            row = []
        elif part == "</tr>" and row:
            rows.append(row)
            row = None
    return rows


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            if self.cell is not None and self.row is not None:  # a row that ends within a cell leaves it without a row
                self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row:
            self.rows.append(self.row)
            self.row = None


def table_rows(pages: DataFrame, html: str, roles: dict[str, list[str]]) -> DataFrame:
    """Rows of HTML tables as maps from role to cell; a header row names the roles by any of their keywords."""

    @F.pandas_udf("array<map<string,string>>")
    def parse(bodies: pd.Series) -> pd.Series:
        def one(body):
            header, out = None, []
            if _PLAIN.fullmatch(body or ""):
                found = _plain_rows(body or "")
            else:
                parser = _Tables()
                parser.feed(body)
                found = parser.rows
            for cells in found:
                if header is None:
                    named = {i: r for i, c in enumerate(cells) for r, words in roles.items() if any(w in c.lower() for w in words)}
                    header = named or None
                else:
                    out.append({r: cells[i] for i, r in header.items() if i < len(cells)})
            return out

        return bodies.map(one)

    return pages.select(*[c for c in pages.columns if c != html], F.explode(parse(F.col(html))).alias("row"))


def tab_blocks(text: Column, names: list[str]) -> Column:
    """Tab-separated lines as structs; lines with another number of fields are left out."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.split(s, "\t")), lambda f: F.size(f) == len(names))
    return F.transform(lines, lambda f: F.struct(*[F.trim(F.get(f, F.lit(i))).alias(n) for i, n in enumerate(names)]))


def union_sources(sources: dict[str, DataFrame], priority: dict[str, int]) -> DataFrame:
    """All sources as one table with their name and priority, in which earlier means better."""
    out = None
    for name, rows in sources.items():
        tagged = rows.withColumn("source", F.lit(name)).withColumn("priority", F.lit(priority.get(name, 99)))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def run_sources(registry: dict[str, Callable[..., DataFrame]], specs: list[dict], keep: Callable[[DataFrame], DataFrame] = checkpointed) -> tuple[DataFrame | None, list[dict]]:
    """(rows of all sources with source and priority, a report of each) as specs say.

    A spec names its driver in the registry, a label and whether the source is a main one; what else it has are the driver's
    arguments. Main sources come first, and within either kind the order of the specs is the priority. Each source is read
    through by itself (keep), so that one that fails, whether at once or while its rows are read, costs no other; an unknown
    driver and an empty source are reported too. None if no source has rows.
    """
    out, report = None, []
    ordered = sorted(specs, key=lambda s: not s.get("main", False))
    for priority, spec in enumerate(ordered, 1):
        label, outcome, rows = spec.get("source", spec["driver"]), "read", None
        try:
            driver = registry[spec["driver"]]
            rows = keep(driver(**{k: v for k, v in spec.items() if k not in ("driver", "source", "main")}))
            outcome = "empty" if rows.isEmpty() else "read"
        except KeyError as missing:
            outcome = f"no driver {missing}" if spec["driver"] not in registry else f"failed: {missing!r}"
        except Exception as failed:  # noqa: BLE001  one source's failure is its own
            outcome = f"failed: {type(failed).__name__}"
        report.append({"source": label, "priority": priority, "outcome": outcome})
        if outcome == "read":
            tagged = rows.withColumns({"source": F.lit(label), "priority": F.lit(priority)})
            out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out, report
