"""Nearest neighbours by cosine through multi-index hashing.

Vectors become binary codes: signs after centring and a learned rotation (iterative quantization, fitted on a bounded
sample; more bits than dimensions use more rotations). A code is cut into SUBSTRINGS of WIDTH bits, and every substring has
an index of its own. Two codes that differ in at most SUBSTRINGS * (r + 1) - 1 bits agree within r bits on some substring
(pigeonhole), so probing all values within r of a query's substrings retrieves every code of that Hamming radius.
What is retrieved is ranked by its floats.

1. Equal vectors are one class, of which the k + 1 least ids can be needed.
2. Every row is indexed once for each substring: the entry has the row's id and its unit vector in 8 bits a component with
   the length of what that leaves out. Entries are dealt by substring, leading bits of its value and, where these hold
   more than GROUP_ROWS, a salt. A query goes to the groups whose leading bits it can meet.
3. A task holds one group. Of what a query retrieves there it keeps what may be among its k nearest there: with c the cosine
   to the 8-bit vector and e the length left out, the true one is within c - e to c + e. So about k pairs for each query
   and group leave a task, however many rows lie close together, and each pair from one group only.
4. Pairs meet the original vectors, and the k best by their double-precision cosine are the answer.
5. From the angle of a query's neighbours, once centred, follows the probability that its radius retrieves vectors as near. Queries
   for which that is under TRUST are asked again with the next radius, and what is left after the last one, or has fewer than
   k neighbours, is compared with all rows in blocks. So sparse tables are searched more widely than dense ones.

Defined cases: vectors that are null, empty, of another length than the model's, zero or hold nulls, NaN or infinities
take no part, nor do rows with a null id; rows with the query's id are not its candidates; repeated rows are candidates
each, repeated query ids are asked once (the least vector); ties go to the smaller id; an empty table gives an empty
result; other columns take no part.
"""

from __future__ import annotations

from math import acos, comb, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.joins import bounded_join
from tallyloom.llm.staging import staged

#: Rows that the rotation is fitted on, at most about.
FIT_ROWS = 8192
FIT_ROUNDS = 20
SUBSTRINGS, WIDTH = 24, 16
BITS = SUBSTRINGS * WIDTH
#: Radii probed in each substring, one round after the other, and the probability that a round must reach.
RADII = (3, 4)
TRUST = 0.95
#: Index entries in a group, about; rows and queries in a block where all are compared.
GROUP_ROWS = 262_144
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048
#: More than sums of products in another order differ by, relative to unit vectors.
ROUNDING = 1e-6
_ONES = np.bitwise_count(np.arange(2**WIDTH, dtype=np.uint32))
_BY_ONES = np.argsort(_ONES, kind="stable")
ENTRY = "vec_id long, vec array<double>, copies long, subs array<int>, code binary, small binary, scale double, lost double"
PAIR = "query_id long, vec_id long"


def usable(vec: Column) -> Column:
    norm = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad & (norm > 0)


def fit_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) by iterative quantization; more bits than dimensions use more rotations."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(0)
    centred = unit - mean
    rng = np.random.default_rng(11)
    _, axes = np.linalg.eigh(centred.T @ centred)
    parts = []
    for at in range(0, bits, unit.shape[1]):
        kept = axes[:, ::-1][:, : min(unit.shape[1], bits - at)]
        low = centred @ kept
        turn = np.linalg.qr(rng.normal(size=(kept.shape[1], kept.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (left @ right).T
        parts.append(kept @ turn)
    return mean, np.concatenate(parts, axis=1)


def substrings(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """SUBSTRINGS numbers of WIDTH bits for each row of unit vectors."""
    packed = np.packbits((unit - model[0]) @ model[1] > 0, axis=1)
    return packed.view(">u2").reshape(len(unit), SUBSTRINGS).astype(np.int32)


def retrieval(cosine: float, radius: int) -> float:
    """Probability that a vector at a cosine agrees with the query within radius bits on some substring."""
    p = acos(max(-1.0, min(1.0, cosine))) / pi
    one = sum(comb(WIDTH, i) * p**i * (1 - p) ** (WIDTH - i) for i in range(radius + 1))
    return 1 - (1 - one) ** SUBSTRINGS


def trusted_cosine(radius: int, trust: float = TRUST) -> float:
    """The least cosine whose vectors a radius retrieves with that probability."""
    low, high = -1.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if retrieval(middle, radius) >= trust else (middle, high)
    return high


def _coded(model):
    def run(batches):
        for pdf in batches:
            out = pdf[["vec_id", "vec", "copies"]].copy()
            x = np.stack(pdf["vec"].to_numpy()).astype(float) if len(pdf) else np.empty((0, len(model[0])))
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            scale = np.abs(unit).max(1, initial=0) / 127
            small = np.rint(unit / np.maximum(scale, 1e-300)[:, None]).astype(np.int8)
            subs = substrings(unit, model)
            out["subs"] = list(subs)
            out["code"] = [row.tobytes() for row in subs.astype("<u2")]
            out["small"] = [row.tobytes() for row in small]
            out["scale"] = scale
            out["lost"] = np.linalg.norm(unit - small * scale[:, None], axis=1) + ROUNDING
            yield out

    return run


class SubstringIndex:
    """The rows of a group by the value of its substring."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        self.counts = np.bincount(values, minlength=2**WIDTH)
        self.starts = np.cumsum(self.counts) - self.counts

    def within(self, value: int, radius: int) -> np.ndarray:
        """All rows whose value differs from value in at most radius bits."""
        probed = _BY_ONES[: np.searchsorted(_ONES[_BY_ONES], radius, side="right")] ^ value
        counts = self.counts[probed]
        met = counts > 0
        counts, starts = counts[met], self.starts[probed[met]]
        ends = np.cumsum(counts)
        if not len(ends):
            return np.empty(0, np.int64)
        return self.order[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1])]


def _screened(k: int, radius: int):
    """Pairs of a group that may be among a query's k nearest of it."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out_q, out_v = [], []
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy()
            small = np.frombuffer(b"".join(rows["small"]), np.int8).reshape(len(rows), -1)
            scale, lost = rows["scale"].to_numpy(), rows["lost"].to_numpy()
            codes = np.frombuffer(b"".join(rows["code"]), "<u2").reshape(len(rows), -1)
            asked = np.frombuffer(b"".join(queries["code"]), "<u2").reshape(len(queries), -1)
            index = SubstringIndex(rows["value"].to_numpy())
            q = np.stack(queries["vec"].to_numpy()).astype(float)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            for query_id, value, vector, code in zip(queries["query_id"].to_numpy(), queries["value"].to_numpy(), q, asked, strict=True):
                found = index.within(int(value), radius)
                found = found[ids[found] != query_id]
                if len(found) > k:
                    near = (small[found].astype(np.float32) @ vector.astype(np.float32)) * scale[found]
                    low, high = near - lost[found], near + lost[found]
                    found = found[high >= np.partition(low, -k)[-k]]
                met = np.bitwise_count(codes[found] ^ code) <= radius
                found = found[met.argmax(1) == key[0]]  # the first substring that meets gives the pair
                out_q.append(np.full(len(found), query_id))
                out_v.append(ids[found])
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pd.DataFrame({"query_id": join(out_q).astype(np.int64), "vec_id": join(out_v).astype(np.int64)})

    return run


def _compared(k: int):
    """Pairs of a block of queries and a block of rows that may be among a query's k nearest of the block."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out_q, out_v = [], []
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy()
            x = np.stack(rows["vec"].to_numpy()).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for query_id, vector in zip(queries["query_id"].to_numpy(), queries["vec"].to_numpy(), strict=True):
                vector = np.asarray(vector, float)
                near = np.where(ids != query_id, x @ (vector / np.linalg.norm(vector)), -np.inf)
                floor = np.partition(near, -k)[-k] if len(near) > k else -np.inf
                found = np.flatnonzero((near >= floor - ROUNDING) & (ids != query_id))
                out_q.append(np.full(len(found), query_id))
                out_v.append(ids[found])
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pd.DataFrame({"query_id": join(out_q).astype(np.int64), "vec_id": join(out_v).astype(np.int64)})

    return run


def _cosines(mean: np.ndarray):
    """Cosine of two vectors, and of the two unit vectors once centred, which is what their codes see."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"score": [], "alike": []}, dtype=float)
        x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        # summed row by row, so that equal vectors have equal scores wherever they lie
        score = (x * y).sum(1) / (nx * ny)
        x, y = x / nx[:, None] - mean, y / ny[:, None] - mean
        sides = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        return pd.DataFrame({"score": score, "alike": np.where(sides > 0, (x * y).sum(1) / np.maximum(sides, 1e-300), 1.0)})

    return F.pandas_udf(run, "score double, alike double")


def _ranked(pairs: DataFrame, asked: DataFrame, coded: DataFrame, mean: np.ndarray, k: int) -> DataFrame:
    """The k best rows of each query of the pairs, by the vectors themselves; alike is the cosine of the centred ones."""
    met = pairs.distinct().join(coded.select("vec_id", "vec", "copies"), "vec_id").join(asked.select("query_id", F.col("vec").alias("asked")), "query_id")
    scored = met.select("query_id", "vec_id", "copies", _cosines(mean)("vec", "asked").alias("c"))
    each = scored.select("query_id", "vec_id", "c.score", "c.alike", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "alike")


def _entries(coded: DataFrame, *columns: str) -> DataFrame:
    return coded.select(*columns, F.posexplode("subs").alias("s", "value"))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Of each set of equal vectors, the k + 1 least ids, with the number of their rows up to k."""
    counted = rows.groupBy("vec", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    nth = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    return counted.withColumn("nth_", nth).filter(F.col("nth_") <= k + 1).drop("nth_")


def probed_pairs(asked: DataFrame, coded: DataFrame, groups: DataFrame, prefix_bits: int, k: int, radius: int) -> DataFrame:
    """Pairs of queries and rows that the index retrieves within a radius, less what can't be among the k nearest."""
    head = lambda value: F.shiftright(value, WIDTH - prefix_bits)
    salt = lambda: F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int").alias("salt")
    rows = _entries(coded, "vec_id", "code", "small", "scale", "lost").withColumn("prefix", head(F.col("value")))
    rows = bounded_join(rows, groups, ["s", "prefix"], "inner").select("s", "prefix", salt(), "vec_id", "value", "code", "small", "scale", "lost")
    near = F.array(*[F.lit(int(x)) for x in range(2**prefix_bits) if int(x).bit_count() <= radius])
    queries = _entries(asked, "query_id", "vec", "code").withColumn("prefix", F.explode(F.transform(near, lambda x: head(F.col("value")).bitwiseXOR(x))))
    queries = bounded_join(queries, groups, ["s", "prefix"], "inner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)))
    key = ["s", "prefix", "salt"]
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(_screened(k, radius), PAIR)


def compared_pairs(asked: DataFrame, coded: DataFrame, total: int, questions: int, k: int) -> DataFrame:
    """Pairs of queries and rows, less what can't be among the k nearest, by comparing all in blocks."""
    row_blocks, query_blocks = max(1, -(-total // BLOCK_ROWS)), max(1, -(-questions // BLOCK_QUERIES))
    spread = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", "vec", spread("query_id", query_blocks).alias("q"), every(row_blocks).alias("b"))
    right = coded.select("vec_id", "vec", spread("vec_id", row_blocks).alias("b"), every(query_blocks).alias("q"))
    return left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(_compared(k), PAIR)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, radii: tuple[int, ...] = RADII, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score. vectors, queries: vec_id and embedding."""
    spark = vectors.sparkSession
    vec = F.transform("embedding", lambda x: x.cast("double")).alias("vec")
    fine = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), vec)
    asked = queries.filter(fine).select(F.col("vec_id").cast("long").alias("query_id"), vec).groupBy("query_id").agg(F.min("vec").alias("vec"))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").take(1)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, total = lengths[0]["n"], lengths[0]["count"]
    rows, asked = rows.filter(F.size("vec") == length), asked.filter(F.size("vec") == length)
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(2**31)) < int(2**31 * min(1.0, fit_rows / total))
    sample = np.array([r["vec"] for r in rows.filter(chosen).limit(2 * fit_rows).collect()] or [[1.0] * length], float)
    model = fit_rotation(sample)

    coded = staged(_classes(rows, k).mapInPandas(_coded(model), ENTRY), "ann-rows")
    left = asked.select(F.col("query_id").alias("vec_id"), "vec", F.lit(1).cast("long").alias("copies")).mapInPandas(_coded(model), ENTRY)
    left = staged(left.select(F.col("vec_id").alias("query_id"), "vec", "subs", "code"), "ann-queries")
    prefix_bits = min(12, max(0, (total // GROUP_ROWS).bit_length()))
    groups = _entries(coded).groupBy("s", F.shiftright("value", WIDTH - prefix_bits).alias("prefix")).count()
    groups = staged(groups.select("s", "prefix", F.ceil(F.col("count") / GROUP_ROWS).alias("salts")), "ann-groups")
    parts, questions = [], left.count()
    for radius in radii:
        found = staged(_ranked(probed_pairs(left, coded, groups, prefix_bits, k, radius), left, coded, model[0], k), "ann-found")
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("alike").alias("least"))
        sure = kth.filter((F.col("n") == k) & (F.col("least") >= trusted_cosine(radius))).select("query_id")
        parts.append(bounded_join(found, sure, "query_id", "left_semi"))
        left = staged(bounded_join(left, sure, "query_id", "left_anti"), "ann-queries")
        questions = left.count()
        if not questions:
            break
    else:
        parts.append(_ranked(compared_pairs(left, coded, total, questions, k), left, coded, model[0], k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")
