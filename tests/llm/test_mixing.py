from collections import Counter, defaultdict


from tallyloom.llm.mixing import inclusion_factors, mix_sources, mixed_documents, source_targets


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing, capping and sharing again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, total = {}, set(order), share * sum(sizes.values())
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level >= most * sizes[s]}
        for s in over:
            target[s] = most * sizes[s]
        left -= over
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
    return target


def test_targets_are_shared_again_until_none_is_above(spark):
    sizes = {"a": 10, "b": 500, "c": 40, "d": 1000, "é": 3, None: 200}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "mix_source string, words long, docs long")
    got = {r["mix_source"]: r["target"] for r in source_targets(rows).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_words_taken_come_near_the_targets_and_reruns_agree(spark, documents):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 211)), ("hot" if i % 3 else f"s{i % 12}")) for i in range(1500)]
    docs = documents(rows)
    got = [tuple(r) for r in mix_sources(docs).select("doc_id", "source", "mix_size", "mix_target", "mix_copies").collect()]
    taken, target = defaultdict(int), {}
    for _, source, size, goal, copies in got:
        assert 0 <= copies <= 2
        taken[source] += size * copies
        target[source] = goal
    assert len(got) == 1500 and all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 2 for s in target)
    again = [tuple(r) for r in mix_sources(docs.repartition(5)).select("doc_id", "source", "mix_size", "mix_target", "mix_copies").collect()]
    assert Counter(got) == Counter(again)


def test_odd_rows_and_clashing_columns(spark, documents, odd_rows):
    docs = documents(odd_rows)
    out = mix_sources(docs)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and set(docs.columns) <= set(out.columns)
    assert {r["mix_size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert len({r["mix_copies"] for r in rows if r["doc_id"] == 5}) == 1
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = sum(r["mix_copies"] for r in rows)
    assert mixed.count() == copies


def test_realised_inclusion_is_the_probability(spark):
    """Two hundred sources with the same sizes are as many samples: a size is taken about as often as its probability says."""
    sizes = [3 + (i * i) % 97 for i in range(60)]
    rows = [(1000 * s + i, "w " * n, f"s{s:03d}") for s in range(200) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs, weights=(1,), share=0.6, max_copies=2).select("doc_id", "mix_copies").collect()
    share, mean = 0.6 * sum(sizes), sum(sizes) / len(sizes)
    weight = [n / (n + mean) for n in sizes]
    low, high = 0.0, 1e6
    for _ in range(200):  # the factor by bisection
        factor = (low + high) / 2
        low, high = (factor, high) if sum(n * min(1, factor * w) for n, w in zip(sizes, weight, strict=True)) < share else (low, factor)
    taken = [0] * len(sizes)
    for r in got:
        taken[r["doc_id"] % 1000] += r["mix_copies"] / 200
    p = [min(1, factor * w) for w in weight]
    assert max(p) < 1 and all(abs(t - q) < 4 * (q * (1 - q) / 200) ** 0.5 + 0.03 for t, q in zip(taken, p, strict=True))


def test_what_would_pass_one_is_certain(spark):
    units = spark.createDataFrame([("a", 1, 90), ("a", 1000, 1)], "mix_source string, mix_size long, n long")
    targets = spark.createDataFrame([("a", 1030.0, 1090 / 91)], "mix_source string, rest_words double, mean_size double")
    factor = inclusion_factors(units, targets).collect()[0]["factor"]
    weight = 1 / (1 + 1090 / 91)
    assert abs(90 * factor * weight - 30) < 1e-9 and factor * 1000 / (1000 + 1090 / 91) > 1


def test_empty_table(documents):
    empty = documents([(1, "a", "s")]).filter("doc_id = 0")
    assert mix_sources(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_certain_copies_come_first(spark, documents):
    docs = documents([(i, "a b c d", "only") for i in range(40)])
    copies = [r[0] for r in mix_sources(docs).select("mix_copies").collect()]
    assert min(copies) == 1 and sum(copies) == 60
