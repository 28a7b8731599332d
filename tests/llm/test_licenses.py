import random
import re

from tallyloom.llm import licenses as L


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(text):
    """Templates of which some window on the grid contains four fifths."""
    own, found = shingles(text), set()
    for name, template in L.TEMPLATES.items():
        wanted = set(shingles(template))
        step = max(1, len(wanted) // 2)
        length = len(wanted) + step
        for start in range(0, max(1, len(own)), step):
            if len(wanted & set(own[start : start + length])) >= 0.8 * len(wanted):
                found.add(name)
    return found


def test_templates_are_found_as_by_brute_force(spark, documents, odd_rows):
    filler = " ".join(f"f{i}" for i in range(100))
    mit = L.TEMPLATES["mit-text"]
    changed = mit.replace("sublicense", "relicense")
    cut = " ".join(mit.split()[:30])
    texts = [*L.TEMPLATES.values(), f"{filler}\n{mit.upper()}\n{filler}", f"{filler} {changed}", f"{filler} {cut} {filler}", "Released under the MIT", "MIT License the under Released", filler]
    rows = [(100 + i, t, "s") for i, t in enumerate(texts)] + odd_rows
    out = L.scan_licenses(documents(rows))
    got = sorted((str(r["doc_id"]), tuple(sorted(m["license"] for m in r["licenses"]))) for r in out.collect())
    assert got == sorted((str(i), tuple(sorted(brute(t)))) for i, t, _ in rows)
    assert "mit-text" in dict(got)[str(100 + len(L.TEMPLATES))] and "mit-text" in dict(got)[str(101 + len(L.TEMPLATES))]


def test_place_and_containment(spark, documents):
    text = " ".join(f"f{i}" for i in range(100)) + " " + L.TEMPLATES["apache-2.0-header"]
    match = [m for m in L.scan_licenses(documents([(1, text, "s")])).collect()[0]["licenses"] if m["license"] == "apache-2.0-header"][0]
    assert match["containment"] == 1.0 and 50 <= match["start"] <= 100
    assert L.scan_licenses(documents([(1, text, "s")]).filter("doc_id = 2")).count() == 0


def test_the_index_of_samples_loses_no_window(spark, documents):
    """Banding every window of every template, with no look at shingles first, finds the same."""
    rng = random.Random(5)
    texts = []
    for name in ("mit-text", "zlib", "mit", "apache-2.0-header"):
        for share in (0.0, 0.05, 0.1):
            w = [x if rng.random() >= share / 3 else "changed" for x in L.TEMPLATES[name].split()]
            texts.append(" ".join([f"g{i}" for i in range(rng.randrange(40))] + w + ["end"]))
    some = {n: L.TEMPLATES[n] for n in ("mit-text", "zlib", "mit", "apache-2.0-header", "cc-by-4.0")}
    df = documents([(i, t, "s") for i, t in enumerate(texts)] + [(99, None, "s"), (98, "", "s")])
    listed = lambda every: {r["doc_id"]: r["licenses"] for r in L.scan_licenses(df, some, every).collect()}
    assert listed(True) == listed(False)


def test_many_templates_in_one_expression(spark, documents):
    many = {f"t{i}": " ".join(f"a{i}x{j}" for j in range(12 + i % 30)) for i in range(500)}
    got = L.scan_licenses(documents([(1, "see " + many["t77"] + " and " + many["t400"], "s"), (2, "none", "s")]), many)
    assert {r["doc_id"]: [m["license"] for m in r["licenses"]] for r in got.collect()} == {1: ["t400", "t77"], 2: []}


def test_bands_collide_with_high_probability():
    similarity = 0.8 / (1 + 0.5 + 0.2)
    assert (1 - similarity) ** L.BANDS < 1e-4
