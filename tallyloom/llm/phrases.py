"""Collocations by contiguous pattern growth: phrases of a few words that recur, scored by how tightly their parts bind.

1. Words of every language are counted; the most frequent ones get numbers by frequency. Pairs of neighbouring words are
   counted too, as buckets of a fixed number; both give filters of fixed size (a bit for each bucket with enough
   occurrences), which may let rare ones through but lose no frequent one.
2. Projection: every occurrence of a pair that may be frequent is a pointer; what goes with it are the words that follow,
   as long as each pair on the way may be frequent, up to the longest phrase. Equal pointers of a task are one with a number.
3. Prefixes of two words are dealt to units of work. There a prefix's pointers meet, sorted by what follows, and it is
   grown to the right depth-first: each extension that is frequent is a phrase, and its own pointers are extended in turn.
   A prefix in a bucket with more than a HOT_PARTS-th of all words is dealt out by what follows; its parts give their counts,
   frequent or not, and the sums by phrase follow, combined before they are shuffled.
4. Phrases look up the counts of their parts, in one join, and the greatest count of a longer phrase around them.

Buckets and pointers are shuffled as packed columns, sorted, a row for each task and unit, so that a corpus whose pairs are
all frequent needs a few bytes for each word.

Words are 64-bit hashes, seeded with their language's, on the way, and texts again in the result (two words among those of
a corpus share a hash with a probability of 3e-7 for 2e7 words of which 3e5 are frequent). Counts are 64 bits wide, products decimals.

Defined cases: a null text has no words; a null language is ``und``, together with rows that say so; very long texts are
processed whole; repeated rows count each; rows are never told apart by doc_id; ties of a score are ordered by count
and then by phrase; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.joins import bounded_join
from tallyloom.llm.staging import forget_shuffles, staged
from tallyloom.llm.words import forget, mixed, parts_by_bytes

MIN_COUNT = 30
LONGEST = 4
KEPT = 2000
#: A phrase goes where a longer one around it has so many percent of its occurrences.
ABSORBED = 80
#: log2 of the buckets of words and of pairs, which are the bits of the filters: 8 MB and 32 MB.
WORD_BITS, PAIR_BITS = 26, 28
#: Prefixes of a bucket with more than this part of all words are dealt out; there are fewer of these buckets than that.
HOT_PARTS = 4096
SLICE = 3_000_000
#: The most frequent words, which have numbers by frequency; the others keep their hashes (16 MB of hashes at most).
NUMBERED = 2_000_000
#: Pointers that a task gathers before it packs them (of pairs four times as many); a unit of work has no more of them, about.
GATHERED = 1_000_000
#: log2 of the buckets that are counted together.
CHUNK_BITS = 17
#: Parts that a language's phrases are ranked in first.
RANK_PARTS = 64
#: Spark's seed: a word's number in tasks is xxhash64(lang, word) as Spark computes it.
SEED = 42
#: Ends a piece of text; what is left between spaces and tabs are words.
ENDS = b".,;:!?\n\v\f\r"

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(ENDS)] = 2
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, A-Z in lower case, and where each begins, with the end of the last."""
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, starts - starts[0]


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(places in the vocabulary, piece numbers, text numbers, vocabulary) of the words of a slice of texts, in order."""
    raw, starts = _flat(texts)
    kind = _KIND[raw]
    inside = np.append(kind == 0, False)
    first = np.zeros(len(raw) + 1, bool)
    first[starts] = True
    before = np.append(False, inside[:-1])
    begins = np.flatnonzero(inside & (first | ~before))
    if not len(begins):
        none = np.empty(0, np.int64)
        return none, none, none, []
    letters = np.flatnonzero(inside)
    offsets = np.append(np.searchsorted(letters, begins), len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letters])])
    found = words.dictionary_encode()
    stops = np.append(kind == 2, False)
    stops |= first
    pieces = np.cumsum(stops)[begins]
    return found.indices.to_numpy().astype(np.int64), pieces, np.searchsorted(starts, begins, "right") - 1, found.dictionary.to_pylist()


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of numbers from 0, in order, and the place of each among them."""
    most = int(keys.max(initial=-1)) + 1
    if most > 8 * len(keys):
        return np.unique(keys, return_inverse=True)
    used = np.zeros(most, bool)
    used[keys] = True
    return np.flatnonzero(used), (np.cumsum(used) - 1)[keys]


class Slice:
    """Words of a slice of texts: their numbers by language and word, and the hashes, words and languages of these."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        codes, self.pieces, text, vocabulary = cut(texts)
        coded = pc.fill_null(langs, "und").dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text] if len(codes) else codes
        several = max(1, len(vocabulary))
        keys, self.words = _numbered(of * several + codes)
        self.lang, self.word = keys // several, keys % several
        self.langs, self.vocabulary = coded.dictionary.to_pylist(), vocabulary
        spoken = [xxhash.xxh64_intdigest(x, seed=SEED) for x in self.langs]
        word, lang = map(vocabulary.__getitem__, self.word.tolist()), map(spoken.__getitem__, self.lang.tolist())
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, word, lang), np.uint64, len(keys))

    def pairs(self) -> np.ndarray:
        """Whether a word and the next one lie in one piece."""
        return np.append(self.pieces[1:] == self.pieces[:-1], False) if len(self.pieces) else np.empty(0, bool)


def _slices(batches):
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang")
        for lo, part in parts_by_bytes(texts, SLICE):
            yield Slice(part, langs[lo : lo + len(part)])
    forget()


def _word_counts(batches):
    for s in _slices(batches):
        counts = np.bincount(s.words, minlength=len(s.hashes))
        words = pa.array(s.vocabulary, pa.binary()).cast(pa.string()).take(pa.array(s.word))
        langs = pa.array(s.langs, pa.string()).take(pa.array(s.lang))
        yield pa.RecordBatch.from_arrays([langs, words, pa.array(counts)], ["lang", "word", "n"])


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _MUL + b)


def _bits(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _has(filter_: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (filter_[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


def bucket_filter(buckets: DataFrame, bits: int) -> np.ndarray:
    """Bits of the buckets (column bucket) that are there: 2^bits of them in chunks of 4 KB, gathered on the driver."""
    number = F.col("bucket") + 1  # Spark counts them from 1
    chunk = F.bitmap_bucket_number(number).alias("chunk")
    chunks = buckets.groupBy(chunk).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = np.zeros(2**bits // 8, np.uint8)
    for r in chunks.collect():  # at most 2^bits / 2^15 rows
        at = (r["chunk"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(r["bits"], np.uint8)[: len(out) - at]
    return out


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers in one: the bytes of equal weight of a column lie together, compressed."""
    planes = np.stack([c.astype(np.uint64) for c in columns])[..., None].view(np.uint8)
    return pa.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)), "zstd", asbytes=True)


def unpacked(data: bytes, rows: int, columns: int) -> np.ndarray:
    """The columns that were packed, one a row of the result."""
    planes = np.frombuffer(pa.decompress(data, rows * columns * 8, "zstd"), np.uint8).reshape(columns, 8, rows)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[..., 0]


def _packed_rows(keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row (to, size, data) for each of the keys, which are sorted: how many rows it has, and these packed."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
    data = [packed(*(c[lo:hi] for c in columns)) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(keys[bounds[:-1]].astype(np.int64)), pa.array(np.diff(bounds)), pa.array(data, pa.binary())], ["to", "size", "data"])


PACKED = "to long, size long, data binary"


def _gathered(parts, most: int):
    """Arrays of one or two dimensions joined along the last, as soon as they have so many entries, and what is left."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.shape[-1]
        if size >= most:
            yield np.concatenate(held, axis=-1)
            held, size = [], 0
    if size:
        yield np.concatenate(held, axis=-1)


def _pair_buckets(words, bits: int):
    """Buckets of pairs by chunks, packed: the place in the chunk less the one before, and a number."""

    def found(batches, known):
        for s in _slices(batches):
            near = s.pairs()
            fine = _has(known, _bits(s.hashes, WORD_BITS))[s.words]
            at = np.flatnonzero(near[:-1] & fine[:-1] & fine[1:]) if len(near) else np.empty(0, np.int64)
            yield _bits(_pair_hash(s.hashes[s.words[at]], s.hashes[s.words[at + 1]]), bits)

    def run(batches):
        for buckets in _gathered(found(batches, words.value), 4 * GATHERED):
            buckets, counts = np.unique(buckets, return_counts=True)
            chunks = buckets >> CHUNK_BITS
            steps = np.diff(buckets, prepend=0)
            first = np.append(True, chunks[1:] != chunks[:-1])
            steps[first] = buckets[first] & (2**CHUNK_BITS - 1)
            yield _packed_rows(chunks, steps, counts)

    return run


def _counted(least: int):
    """The buckets of a chunk with enough occurrences, and their numbers."""

    def of_chunk(table: pa.Table) -> pa.Table:
        sums = np.zeros(2**CHUNK_BITS, np.int64)
        for size, data in zip(table["size"].to_pylist(), table["data"].to_pylist(), strict=True):
            steps, counts = unpacked(data, size, 2).astype(np.int64)
            sums[np.cumsum(steps)] += counts  # every place once
        at = np.flatnonzero(sums >= least)
        return pa.table({"bucket": at + (table["to"][0].as_py() << CHUNK_BITS), "n": sums[at]})

    return of_chunk


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first equals the one before."""
    return np.logical_and.reduce([c[1:] == c[:-1] for c in columns])


def numbered(words: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words by number, from 1 on; NUMBERED at most, gathered on the driver."""
    power = F.floor(F.log2("n")).alias("power")
    sizes = {r["power"]: r["count"] for r in words.filter("id is not null").groupBy(power).count().collect()}  # under 64 rows
    from_ = min((p for p in sizes if sum(c for q, c in sizes.items() if q >= p) <= NUMBERED), default=64)
    top = words.filter(F.col("id").isNotNull() & (F.floor(F.log2("n")) >= from_)).select("id", "n").toArrow()
    ids, n = (top[c].to_numpy().astype(np.int64) for c in ("id", "n"))
    return np.append(np.uint64(0), ids[np.lexsort((ids, -n))].view(np.uint64))


def _projected(pairs, hot, spelt, bits: int, longest: int, units: int):
    """Pointers of the pairs that may be frequent, packed for their units of work: the pair, the words that follow (0 where the
    way ends), a number, and whether the pair is dealt out, as those of hot buckets are, by what follows.

    Words are numbers by frequency, or hashes where they have none.
    """

    def found(batches):
        known, often, hashes = pairs.value, hot.value, spelt.value
        order = np.argsort(hashes)
        ranked = hashes[order]
        for s in _slices(batches):
            at = np.searchsorted(ranked[:-1], s.hashes)
            values = np.append(np.uint64(0), np.where(ranked[at] == s.hashes, order[at].astype(np.uint64), s.hashes))
            near = s.pairs()
            at = np.flatnonzero(near)
            own = s.hashes[s.words]
            good, dealt = np.zeros(len(near) + longest, bool), np.zeros(len(near), bool)
            if len(at):
                buckets = _bits(_pair_hash(own[at], own[at + 1]), bits)
                good[at] = _has(known, buckets)
                dealt[at] = np.isin(buckets, often)
            at = np.flatnonzero(good)
            ids = np.append(s.words + 1, np.zeros(longest, np.int64))
            columns, on = [ids[at], ids[at + 1]], np.ones(len(at), bool)
            for k in range(2, longest):
                on = on & good[at + k - 1]
                columns.append(np.where(on, ids[at + k], 0))
            yield np.stack([*(values[c] for c in columns), dealt[at].astype(np.uint64)])

    def run(batches):
        for rows in _gathered(found(batches), GATHERED):
            follows = mixed(sum((c * (_MUL + np.uint64(2 * k)) for k, c in enumerate(rows[2:-1])), np.zeros(rows.shape[1], np.uint64)))
            part = np.where(rows[-1] == 1, (follows >> np.uint64(58)) + np.uint64(1), np.uint64(0))
            unit = mixed(_pair_hash(rows[0], rows[1]) + part) % np.uint64(units)
            order = np.lexsort([*rows[-2::-1], unit])
            rows, unit = rows[:, order], unit[order]
            starts = np.flatnonzero(np.append(True, ~_same(unit, *rows)))
            yield _packed_rows(unit[starts], *rows[:, starts], np.diff(np.append(starts, len(order))))

    return run


def _grown(spelt, longest: int, least: int):
    """Phrases of the prefixes of a unit of work: the prefix, and depth-first every extension that is frequent."""
    names = [f"w{k}" for k in range(1, longest + 1)]

    def of_unit(table: pa.Table) -> pa.Table:
        packs = zip(table["size"].to_pylist(), table["data"].to_pylist(), strict=True)
        rows = np.concatenate([unpacked(data, size, longest + 2) for size, data in packs], axis=1)
        rows = rows[:, np.lexsort(rows[longest - 1 :: -1])]
        total = np.concatenate([[0], np.cumsum(rows[-1].astype(np.int64))])
        new, groups = np.ones(rows.shape[1], bool), []
        new[1:] = ~_same(rows[0], rows[1])
        groups.append(np.append(np.flatnonzero(new), len(new)))
        for k in range(2, longest):
            new = new.copy()
            new[1:] |= ~_same(rows[k])
            groups.append(np.append(np.flatnonzero(new), len(new)))
        found: list[tuple[int, int, int]] = []

        def extend(depth: int, low: int, high: int, floor: int) -> None:
            """The prefix of rows[low:high], and what it grows to."""
            count = int(total[high] - total[low])
            if count < floor:
                return
            found.append((low, depth, count))
            if depth == longest:
                return
            bounds = groups[depth - 1]
            first, last = np.searchsorted(bounds, (low, high))
            for x, y in zip(bounds[first:last].tolist(), bounds[first + 1 : last + 1].tolist(), strict=True):
                if total[y] - total[x] >= floor and rows[depth][x]:  # 0: the way ends
                    extend(depth + 1, x, y, floor)

        counts = total[groups[0][1:]] - total[groups[0][:-1]]
        dealt = rows[-2][groups[0][:-1]] == 1
        for g in np.flatnonzero(dealt | (counts >= least)).tolist():
            extend(2, int(groups[0][g]), int(groups[0][g + 1]), 1 if dealt[g] else least)
        at, depth, count = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        hashes = spelt.value
        words = [np.where(depth > k, rows[k][at], np.uint64(0)) for k in range(longest)]
        words = [np.where(w < len(hashes), hashes[np.minimum(w, np.uint64(len(hashes) - 1))], w).view(np.int64) for w in words]
        return pa.table([*(pa.array(w) for w in words), pa.array(count)], [*names, "n"])

    return of_unit


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(words: lang, word, id, n of every frequent word, and n of the others of a language together; phrases: ids, n of every
    phrase of two words to longest with n >= least)."""
    spark = docs.sparkSession
    texts = docs.filter("text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counted = texts.mapInArrow(_word_counts, "lang string, word string, n long")
    sums = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("id", F.xxhash64("lang", "word"))
    # words that are not frequent are one row of their language
    frequent = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    words = staged(sums.select("lang", frequent("word"), frequent("id"), "n").groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "words")
    forget_shuffles(spark)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    bucket = F.shiftrightunsigned("id", 64 - WORD_BITS).alias("bucket")
    some = spark.sparkContext.broadcast(bucket_filter(words.filter("id is not null").select(bucket), WORD_BITS))
    pairs = texts.mapInArrow(_pair_buckets(some, PAIR_BITS), PACKED).groupBy("to").applyInArrow(_counted(least), "bucket long, n long")
    pairs = staged(pairs, "pairs")
    forget_shuffles(spark)
    near = spark.sparkContext.broadcast(bucket_filter(pairs.select("bucket"), PAIR_BITS))
    hot = pairs.filter(F.col("n") > max(least, total // HOT_PARTS)).select("bucket").collect()  # under HOT_PARTS rows
    hot = spark.sparkContext.broadcast(np.array([r["bucket"] for r in hot], np.int64))

    names = [f"w{k}" for k in range(1, longest + 1)]
    columns = ", ".join(f"{x} long" for x in names)
    spelt = spark.sparkContext.broadcast(numbered(words))
    units = total // GATHERED + 64
    pointers = texts.mapInArrow(_projected(near, hot, spelt, PAIR_BITS, longest, units), PACKED)
    found = pointers.groupBy("to").applyInArrow(_grown(spelt, longest, least), f"{columns}, n long")
    phrases = found.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    ids = F.filter(F.array(*names), lambda w: w != 0)
    phrases = staged(phrases.select(ids.alias("ids"), "n"), "phrases")
    forget_shuffles(spark)
    return words, phrases


def _parts(longest: int) -> Column:
    """What a phrase looks up: (what, k, ids) of its words w, and of its proper parts of two words and more before (l) and after (r) a cut."""
    ids = F.col("ids")
    m = F.size(ids)
    part = lambda what, k, of: F.struct(F.lit(what).alias("what"), F.lit(k).alias("k"), of.alias("part"))
    out = [F.when(m >= k, part("w", k, F.slice(ids, k, 1))) for k in range(1, longest + 1)]
    out += [F.when(m > k, part("l", k, F.slice(ids, 1, k))) for k in range(2, longest)]
    out += [F.when(m > k + 1, part("r", k, F.slice(ids, F.lit(k + 1), m - k))) for k in range(1, longest - 1)]
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def _inside(longest: int) -> Column:
    """The parts of two words and more of a phrase that are shorter than it."""
    ids = F.col("ids")
    m = F.size(ids)
    out = [F.when((m > n) & (m >= at + n - 1), F.slice(ids, at, n)) for n in range(2, longest) for at in range(1, longest - n + 2)]
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, absorbed: int = ABSORBED, kept: int = KEPT) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    a: occurrences; l, r: those of the parts before and after the cut with the least score, floor(2000000 a / (l + r)),
    of equal cuts the first; n: words of the language.
    """
    words, phrases = frequent_phrases(docs, least, longest)
    longer = phrases.filter(F.size("ids") > 2).select(F.explode(_inside(longest)).alias("ids"), "n").groupBy("ids").agg(F.max("n").alias("around"))
    stay = phrases.join(longer, "ids", "left").filter(F.col("around").isNull() | (100 * F.col("around") < absorbed * F.col("n")))
    stay = stay.select("ids", F.col("n").alias("a"))

    one = words.filter("id is not null").select(F.array("id").alias("part"), "n", "lang", "word")
    counts = one.unionByName(phrases.filter(F.size("ids") < longest).select(F.col("ids").alias("part"), "n"), allowMissingColumns=True)
    asked = stay.select("ids", "a", F.inline(_parts(longest)))
    known = bounded_join(asked, counts, "part", "inner")
    of = lambda what, k: F.max(F.when((F.col("what") == what) & (F.col("k") == k), F.col("n")))
    spelt = F.array_sort(F.collect_list(F.when(F.col("what") == "w", F.struct("k", "word", "n"))))
    sums = [of("l", k).alias(f"l{k}") for k in range(2, longest)] + [of("r", k).alias(f"r{k}") for k in range(1, longest - 1)]
    known = known.groupBy("ids").agg(F.first("a").alias("a"), F.max("lang").alias("lang"), spelt.alias("spelt"), *sums)
    m = F.size("ids")
    cuts = []
    for k in range(1, longest):
        left = F.col("spelt")[0]["n"] if k == 1 else F.col(f"l{k}")
        right = F.when(m == k + 1, F.element_at("spelt", -1)["n"])
        right = right.otherwise(F.col(f"r{k}")) if k < longest - 1 else right
        score = F.expr("cast(a as decimal(20,0)) * 2000000 div cast(l_ + r_ as decimal(20,0))")
        known = known.withColumns({"l_": left, "r_": right}).withColumn(f"cut{k}", F.when(m > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col("l_").alias("l"), F.col("r_").alias("r"))))
        cuts.append(F.col(f"cut{k}"))
    best = known.withColumn("cut", F.array_min(F.array(*cuts)))
    phrase = F.array_join(F.transform("spelt", lambda w: w["word"]), " ")
    best = best.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("ids"), F.lit(RANK_PARTS)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = best.withColumn("nth", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("nth") <= kept)
    top = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= kept)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return bounded_join(top, totals, "lang", "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
