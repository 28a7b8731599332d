"""Trees of JSON, records of lines, imports and stored pointers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.pointers import advance
from tallyloom.sources.blocks import lines_of_records, text_records
from tallyloom.sources.imports import Field, id_or_key, import_rows
from tallyloom.sources.trees import found_values, json_tree, rich_texts
from tallyloom.sources.versions import Conflict, Versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def walked(value, place=(), name=None):
    """Every value of a JSON text, objects' fields by name."""
    yield place, name, value
    inner = enumerate(value) if isinstance(value, list) else enumerate(value[k] for k in sorted(value)) if isinstance(value, dict) else ()
    names = sorted(value) if isinstance(value, dict) else None
    for i, one in inner:
        yield from walked(one, (*place, i), names[i] if names else None)


def made(rng, depth):
    kind = rng.randrange(4 if depth > 4 else 0, 6 if depth else 4)
    if kind < 4:
        return [rng.randrange(9), "x" * rng.randrange(4), None, True][kind]
    if kind == 4:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcde"): made(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_trees_against_a_walk(spark):
    rng = random.Random(5)
    values = [made(rng, 6) for _ in range(40)] + [[[[[[[[[["deep"]]]]]]]]]]
    texts = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, "{broken"), (101, None), (102, "")]
    df = spark.createDataFrame(texts, "id long, t string")
    want = sorted(((i, list(place), name) for i, v in enumerate(values) for place, name, _ in walked(v)), key=repr)
    assert sorted(((r["id"], r["place"], r["name"]) for r in json_tree(df, "id", "t").collect()), key=repr) == want
    got = {(r["id"], tuple(r["place"])): r["found"] for r in found_values(df, "id", "t", "a").collect()}
    found = {(i, place): v for i, whole in enumerate(values) for place, name, v in walked(whole) if name == "a"}
    assert got.keys() == found.keys() and len(found) > 5
    for k, v in found.items():
        assert (json.loads(got[k]) == v if isinstance(v, list | dict) else got[k] == (None if v is None else str(v).lower() if v is True else str(v))), k


def test_rich_texts_keep_blocks_apart(spark):
    block = lambda kind, *content: {"type": kind, "content": list(content)}
    text = lambda t: {"type": "text", "text": t}
    doc = block("doc", block("p", text("a"), block("b", text("b\n\"c\""))), block("list", block("p", text("d"), block("p", text("inner")), text("e"))), block("p"), text("outside"))
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "[]"), (3, None)], "id int, t string")
    assert rows(rich_texts(df, "id", "t", ["p"])) == [(1, 0, 'ab\n"c"'), (1, 1, "de"), (1, 2, "inner")]


def test_records_of_lines_against_a_fold(spark):
    """A state machine over the lines of random texts, written out."""
    rng = random.Random(6)
    kinds = ["H 1", "H x", "1 2", "2 3", "bad", "", "  "]
    texts = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(0, 14)))) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(texts, "id long, t string")
    good, bad = [], []
    for i, text in texts:
        current = None

        def close(record):
            if record is None:
                return
            at, head, filled = record
            if head == "H x":
                bad.append((i, at, head, "header"))
                bad.extend((i, n, line, "header of its record") for n, line in filled)
            elif not filled:
                bad.append((i, at, head, "no rows"))
            else:
                good.append((i, at, 1, [tuple(map(int, line.split())) for _, line in filled]))

        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.startswith("H"):
                close(current)
                current = (n, line, [])
            elif not line.strip():
                close(current)
                current = None
            elif current is None:
                bad.append((i, n, line, "no record"))
            elif line == "bad":
                bad.append((i, n, line, "row"))
            else:
                current[2].append((n, line))
        close(current)
    cell = lambda line, at: F.get(F.split(line, " "), F.lit(at)).try_cast("int")
    a, b = text_records(df, "id", "t", lambda line: line.startswith("H"), lambda line: {"n": cell(line, 1)}, lambda line: {"x": cell(line, 0), "y": cell(line, 1)})
    assert sorted((r["id"], r["record"], r["n"], [tuple(x) for x in r["rows"]]) for r in a.collect()) == sorted(good)
    assert rows(b) == sorted(bad, key=repr) and {r[3] for r in bad} == {"header", "no rows", "header of its record", "row", "no record"}
    assert lines_of_records(df, "id", "t", lambda line: line.startswith("H")).count() == sum(t.count("\n") + 1 for _, t in texts if t is not None)


def test_imports_keep_what_breaks_the_contract(spark, tmp_path):
    lines = ['{"id": 1, "title": " A ", "on": "2024-01-02"}', '{"id": "x", "title": "", "on": "2024-1-2", "kind": "z"}', "{broken", "[1]", "", '{"id": 2, "title": "B", "on": "2024-02-30", "extra": [1]}', '{"id": 3, "title": {"a": 1}, "on": null, "kind": "k"}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    contract = {"id": Field("int", required=True), "title": Field(required=True), "on": Field("date", pattern=r"^\d{4}-\d\d-\d\d$"), "kind": Field(values=("k", "d"), default="d")}
    good, bad = import_rows(spark, f"file://{tmp_path}/in.json", contract)
    assert [(r["id"], r["title"], str(r["on"]), r["kind"]) for r in good.orderBy("id").collect()] == [(1, "A", "2024-01-02", "d"), (3, '{"a":1}', "None", "k")]
    got = {r["line"]: r["reasons"] for r in bad.collect()}
    assert got == {lines[1]: ["bad id", "missing title", "bad on", "bad kind"], lines[2]: ["no JSON object"], lines[3]: ["no JSON object"], lines[5]: ["bad on"]}


def test_ids_or_keys(spark):
    masters = spark.createDataFrame([(1, "a"), (2, "7"), (7, "b"), (9, "a")], "id int, k string")
    refs = spark.createDataFrame([("a",), ("7",), ("07",), ("2",), ("x",), (None,), ("00",)], "ref string")
    assert {r["ref"]: r["to"] for r in id_or_key(refs, "ref", masters, "id", "k", "to").collect()} == {"a": 1, "7": 2, "07": 7, "2": 2, "x": None, None: None, "00": None}


def test_pointers_survive_reruns_and_races(spark, tmp_path):
    pointers = Versions(spark, f"file://{tmp_path}/p")
    said = spark.createDataFrame([(k, i, f"{k}{i} more") for k in "ab" for i in range(6 if k == "a" else 2)], "key string, nth long, text string")
    state = lambda df: {r["key"]: (r["pointer"], r["chunks"], r["summary"]) for r in df.collect()}
    one = state(advance(pointers, said, "r1", 2))
    assert one == {"a": (1, 1, "a0 a1")} == state(advance(pointers, said, "r1", 2))  # again: nothing changes
    other = Versions(spark, pointers.folder.path)
    publish = pointers.publish

    def late(*args, **kw):
        advance(other, said, "r2", 2)  # another driver's run comes first
        return publish(*args, **kw)

    pointers.publish = late
    with pytest.raises(Conflict):
        advance(pointers, said, "r3", 2)
    pointers.publish = publish
    assert state(pointers.read()) == {"a": (3, 2, "a0 a1\na2 a3")}
    assert state(advance(pointers, said, "r3", 2)) == {"a": (3, 2, "a0 a1\na2 a3")}  # two are left, not more than two
    more = said.union(spark.createDataFrame([("b", 2, "b2"), ("c", 0, "c0")], said.schema))
    assert state(advance(pointers, more, "r4", 2)) == {"a": (3, 2, "a0 a1\na2 a3"), "b": (1, 1, "b0 b1")}
