import corpus_pipeline as C
import numpy as np


def test_each_stage_on_its_own_input(spark, tmp_path, odd_rows):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(400)]
    rows = [(100 + i, " ".join(rng.choice(words, 90)), "en", f"s{i % 5}", 1) for i in range(150)]
    rows += [(400 + i, rows[i][1] + " end", "en", "s1", 1) for i in range(10)]
    rows += [(500, rows[20][1] + " token = abcdef123456 done", "en", "s2", 1)]
    rows += [(600 + i, "junk " * 80, "en", "s3", 1) for i in range(3)]
    rows += [(i, t, "en", s, 1) for i, t, s in odd_rows]
    rows = [(*r, True, 0.5, "c", 7, "n", "s") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id string, copy_ int, node string, secret_spans string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert {100 + i for i in range(150)} <= ids("quality") and not {600, 601, 602, 1, 2, 3} & ids("quality")
    assert {100 + i for i in range(150)} <= ids("near_dedup") and not {400 + i for i in range(10)} & ids("near_dedup")
    assert len(seen["secrets"]) == len(seen["near_dedup"]) and not any("abcdef123456" in r["text"] for r in seen["secrets"])
    assert sum(len(r["text"].split()) for r in seen["mixing"]) > sum(len(r["text"].split()) for r in seen["secrets"])
    tokens = {}
    for p in seen["packing"]:
        tokens.setdefault(p["sequence_id"], []).append(p["length"])
    assert all(sum(n) <= 4096 for n in tokens.values())
    copies = {}
    for p in seen["packing"]:
        copies.setdefault(p["example_id"], []).append(p)
    assert len(copies) == len(seen["mixing"])  # every copy is packed whole and is told apart
    assert all(sorted(i for p in ps for i in range(p["start"], p["start"] + p["length"])) == list(range(ps[0]["doc_tokens"])) for ps in copies.values())
    whole = C.run(spark, str(tmp_path))
    assert whole.count() == len(seen["packing"]) and sum(r["length"] for r in whole.collect()) == sum(map(sum, tokens.values()))


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
