"""MinHash near-duplicates with odd sketches.

Documents are sets of distinct word shingles. Equal sets are one class from the start, so copies cost no pairs. Each
class has MinHash samples, which give band keys and, folded into a parity bitmap, an odd sketch: the XOR of two
sketches has as many bits as samples differ (less collisions), so its population count estimates high similarities
closely. Steps:

1. signatures by document; classes by set (both 64-bit halves of a 128-bit digest).
2. classes that share a band key, hung on the least of the bucket, give candidate groups (connected components), so a
   bucket of n classes costs n - 1 rows and not n * n.
3. the full sets of the classes in groups of two or more are computed anew and dealt out in blocks; each pair of blocks
   is one task's work, inside which sketches are compared first, then full sets, exactly. Groups of more than CHAINED
   blocks, which hits between texts that aren't alike may have chained, are dealt by band key instead, in blocks again. Only a spanning forest of the
   confirmed links leaves the task. Large groups are many pairs of blocks, and a pair of classes that is already
   connected is not confirmed again, so the links between different texts are all kept up to connection.
4. the components of the confirmed links.

Bands follow from the threshold: at 0.85 there are 24 of 6 samples, which a pair misses with probability (1 - 0.85^6)^24 =
1.2e-5; at 0.8, 28 of 5 (1.5e-5). The sketch passes pairs estimated up to 5 standard deviations under the threshold: 0.68 at
0.85, 0.61 at 0.8.

Defined cases: a null text or one without words has the empty set and is linked with nothing; a text shorter than a
shingle is one shingle; repeated rows have one set and one component; different texts that share a doc_id are one
document, so what either is linked with is one component; rows with a null doc_id link like others but give no component
id (it stays null where all ids are null, and such rows are kept); an empty table gives an empty result; other columns
take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.graph import components
from tallyloom.llm.joins import bounded_join
from tallyloom.llm.staging import staged
from tallyloom.llm.textcols import boxed, unboxed
from tallyloom.llm.words import mixed, shingle_set, slices

#: MinHash samples, which bands share out, and the probability to miss that a pair at the threshold may have.
SAMPLES = 144
MISSED = 2e-5
SKETCH_BITS = 512
#: Classes in a block: two blocks with their full sets are what a task holds.
BLOCK = 1024
#: Blocks of a group up to which all of its pairs of blocks are compared; in a larger one, which band hits between texts
#: that aren't alike may have chained, only members that share a band are.
CHAINED = 64
#: Shingles hashed at once, to stay in a CPU's cache.
CHUNK = 32_768

_SEEDS = np.random.default_rng(20240901).integers(1, 2**63, size=(SAMPLES, 2), dtype=np.int64).astype(np.uint64)
_MULS = _SEEDS[:, 0] | np.uint64(1)
_ADDS = _SEEDS[:, 1]
_BIT_SHIFT = np.uint64(64 - int(np.log2(SKETCH_BITS)))


def banding(percent: int) -> tuple[int, int]:
    """(bands, samples in a band): the longest bands of all samples with which a pair at percent is missed seldom enough."""
    for rows in range(SAMPLES, 1, -1):
        bands = SAMPLES // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISSED:
            return bands, rows
    return SAMPLES, 1


def sketch_floor(percent: int) -> float:
    """The similarity that the sketch of a pair at percent estimates but for 5 standard deviations: of the samples, and of the bits."""
    s = percent / 100
    return s - 5 * ((s * (1 - s) / SAMPLES) + 0.0165**2) ** 0.5


def max_differing_bits(floor: float) -> int:
    """Bits that the XOR of two odd sketches has at most, on average, at similarities of floor or more."""
    differing = 2 * SAMPLES * (1 - floor)
    return int(np.ceil(SKETCH_BITS * (1 - np.exp(-2 * differing / SKETCH_BITS)) / 2))


def estimated_similarity(bits: np.ndarray) -> np.ndarray:
    """Similarity that the number of bits in the XOR of two odd sketches stands for."""
    left = np.maximum(1 - 2 * np.asarray(bits, float) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(left)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES x len(sets) least values; no set may be empty."""
    out = np.empty((SAMPLES, len(sets)), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for i in range(SAMPLES):
            out[i, at:end] = np.minimum.reduceat(flat * _MULS[i] + _ADDS[i], starts)
        at = end
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches, a row of bytes for each set."""
    count = samples.shape[1]
    bits = (mixed(samples + _ADDS[:, None]) >> _BIT_SHIFT).astype(np.int64)
    cells = (bits + np.arange(count)[None, :] * SKETCH_BITS).ravel()
    parity = np.bincount(cells, minlength=count * SKETCH_BITS).reshape(count, SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1)


def _signatures(shingle: int, percent: int):
    bands_, rows_ = banding(percent)

    def run(batches):
        for pdf in slices(batches):
            sets = [shingle_set(t, shingle) for t in pdf["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            out = pdf[["doc_id", "text_key"]].copy()
            out["n_shingles"] = [len(s) for s in sets]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2) if digests else np.empty((0, 2), np.int64)
            out["set_a"], out["set_b"] = halves[:, 0], halves[:, 1]
            bands, sketch = [None] * len(sets), [None] * len(sets)
            if full:
                samples = minhashes([sets[i] for i in full])
                folded = samples[: bands_ * rows_].reshape(bands_, rows_, -1)
                keys = np.arange(bands_, dtype=np.uint64)[:, None] * np.ones(len(full), np.uint64)
                for r in range(rows_):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + folded[:, r])
                packed = sketches(samples)
                for at, i in enumerate(full):
                    bands[i], sketch[i] = keys[:, at].view(np.int64), packed[at].tobytes()
            out["bands"], out["sketch"] = bands, sketch
            yield out[["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch"]]

    return run


def _sets(shingle: int):
    def run(batches):
        for pdf in slices(batches):
            yield pd.DataFrame({"node": pdf["node"], "shingles": [shingle_set(t, shingle).tobytes() for t in pdf["text"]]})

    return run


def confirm_links(nodes: np.ndarray, block: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union. across: pairs of two blocks only."""
    count = len(nodes)
    sizes = np.array([len(s) for s in sets])
    root = np.arange(count)
    links = []
    most = max_differing_bits(sketch_floor(percent))
    for a in range(count - 1):
        rest = np.arange(a + 1, count)
        fine = (np.bitwise_count(sketch[rest] ^ sketch[a]).sum(1) <= most) & (root[rest] != root[a])
        fine &= 100 * np.minimum(sizes[rest], sizes[a]) >= percent * np.maximum(sizes[rest], sizes[a])
        if across:
            fine &= block[rest] != block[a]
        rest = rest[fine]
        if not len(rest):
            continue
        flat = np.concatenate([sets[b] for b in rest])
        at = np.minimum(np.searchsorted(sets[a], flat), sizes[a] - 1)
        common = np.add.reduceat((sets[a][at] == flat).astype(np.int64), np.cumsum([0, *sizes[rest[:-1]]]))
        for b in rest[100 * common >= percent * (sizes[rest] + sizes[a] - common)]:
            if root[b] != root[a]:
                root[root == root[b]] = root[a]
                links.append((int(nodes[a]), int(nodes[b])))
    return links


def _confirm(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
        links = confirm_links(pdf["node"].to_numpy(), pdf["block"].to_numpy(), sketch, sets, percent, key[1] != key[2])
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component) and kept, a row for each row of docs."""
    slim = docs.select("doc_id", F.xxhash64(F.col("text")).alias("text_key"), "text")
    schema = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"
    signed = staged(slim.mapInPandas(_signatures(shingle, percent), schema), "signatures")

    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("of"), "text_key", "bands", "sketch"))
    classes = signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(first.alias("f"), F.min("doc_id").alias("doc_id"))
    # numbered as they are written, once; every later step reads the written numbers
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "doc_id", "f.text_key", "f.bands", "f.sketch")
    classes = staged(classes, "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).filter("least <> most")
    shared = staged(shared, "shared-bands")
    stars = banded.join(shared, "band").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    grouped = components(stars)
    grouped = staged(grouped.union(grouped.select(F.col("root").alias("node"), "root").distinct()), "groups")

    sized = grouped.join(grouped.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "root")
    members = staged(sized.join(classes.select("node", "doc_id", "text_key", "sketch"), "node"), "members")
    wanted = members.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "node")
    texts = slim.withColumn("text_key", F.xxhash64(F.col("text")))
    texts = bounded_join(texts, wanted, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "inner")
    sets = texts.select("node", "text").mapInPandas(_sets(shingle), "node long, shingles binary")
    small = members.filter(F.col("blocks") <= CHAINED).select("root", "node", "sketch", "blocks")
    large = members.filter(F.col("blocks") > CHAINED).select("node", "sketch").join(banded, "node").join(shared.select("band", "n"), "band")
    units = small.union(large.select("band", "node", "sketch", F.ceil(F.col("n") / BLOCK)))
    units = units.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = units.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", "node", "sketch", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # copies of a text give its set once for each
    blocks = dealt.join(sets.dropDuplicates(["node"]), "node").groupBy("root", "i", "j")
    links = blocks.applyInPandas(_confirm(percent), "u long, v long")

    found = components(links.union(_same_documents(signed, classes)))
    rooted = classes.select("node", "doc_id", "set_a", "set_b").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    placed = rooted.join(least, "root").select("set_a", "set_b", "component")
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(placed, ["set_a", "set_b"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _same_documents(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id but not their set."""
    here = F.struct("set_a", "set_b")
    several = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(here).alias("one"), F.max(here).alias("other")).filter("one <> other")
    rows = signed.filter("n_shingles > 0").join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_a", "set_b").distinct()
    nodes = rows.join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"])
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each component is kept; rows that share a doc_id are one."""
    judged = staged(near_duplicates(docs, shingle, percent).select("doc_id", "kept"), "judged")
    dropped = judged.filter(~F.col("kept")).select("doc_id").distinct()
    rest = bounded_join(docs, dropped, "doc_id", "left_anti").select(*docs.columns)
    again = staged(judged.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return rest
    once = bounded_join(rest, again, "doc_id", "left_anti").select(*docs.columns)
    first = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    more = bounded_join(rest, again, "doc_id", "left_semi").select(boxed(docs), "doc_id", "text")
    more = more.withColumn("nth_", F.row_number().over(first)).filter("nth_ = 1").select(*unboxed(docs))
    return once.unionByName(more)
