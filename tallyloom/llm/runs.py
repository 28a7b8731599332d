"""Maximal repetitions (runs) in texts as sequences of words, by the runs theorem.

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring word extends. Every run
holds a Lyndon word of length q, under the order of words or its reverse, that is the longest Lyndon word where it begins:

1. Texts of a slice are coded as numbers and laid one after the other. One suffix array for each text comes from prefix
   doubling over the whole slice; only places whose rank is still shared are sorted again.
2. The longest Lyndon word at a place ends before the next smaller value of the inverse suffix array; under the reverse
   order, before the next smaller value of its mirror.
3. Each such word (i, j) is a root: it is extended to the right by the longest common extension of i and j, the least LCP
   between their ranks, from a sparse table of which one level is held at a time. To the left the same is done on
   the mirrored texts, and only for texts with a root that can still become a run.

All steps but the last are array operations over a slice of texts, and each text is one row's own work, so nothing is
shuffled; memory is about 200 bytes for each word of a slice, which is SLICE bytes of texts or one text.

Defined cases: a null text has no words; a text without words has no runs and collapses to an empty text; very long texts
are processed whole; rows that repeat or lack a doc_id are judged each by its own text; an empty table gives an empty
result; other columns pass through, except that the operator's own replace input columns of their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.coding import coded
from tallyloom.llm.textcols import boxed, unboxed
from tallyloom.llm.words import forget, parts_by_bytes

#: Words that a run has at least, besides two periods.
MIN_WORDS = 12
#: Bytes of texts that are looked at together.
SLICE = 1_000_000
#: Steps of jumping after which the next smaller values that are still open are looked up in a tree of minima.
JUMPS = 12
#: Words before a root that are compared one by one before the mirrored texts are sorted for it.
LOOKED_AT = 4
OWN = ("runs", "collapsed")
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _groups(keys: np.ndarray) -> np.ndarray:
    """Whether each of the sorted keys differs from the one before."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


class Suffixes:
    """Suffix array, its inverse and LCPs of several texts laid one after the other, each text's suffixes by themselves.

    codes: the words as numbers; sizes: words of each text. A suffix that begins another comes before it. Ranks of a later
    text are all below those of an earlier one, so the next smaller rank is never beyond the text's end.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        n = len(codes)
        self.codes, self.sizes = codes, sizes
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        keys = (len(sizes) - 1 - self.text) * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(keys, kind="stable")
        new = _groups(keys[order])
        slots = np.arange(n)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        levels, step = [rank], 1
        shared = ~new | ~np.append(new[1:], True)
        slots, at = slots[shared], order[shared]
        while len(at):
            after = at + step
            inside = after < self.end[at]
            second = np.where(inside, rank[np.where(inside, after, 0)].astype(np.int64) + 1, 0)
            keys = rank[at].astype(np.int64) * (n + 1) + second
            sub = np.argsort(keys, kind="stable")
            at, new = at[sub], _groups(keys[sub])
            order[slots] = at
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            levels.append(rank)
            step *= 2
            shared = ~new | ~np.append(new[1:], True)
            slots, at = slots[shared], at[shared]
        self.order, self.rank = order, rank.astype(np.int64)
        self.lcp = self._lcps(levels[:-1])

    def _lcps(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each suffix and the one before it in order; ranks of level k are equal where 2^k words are."""
        lcp = np.zeros(len(self.order), np.int32)
        nested, slots = [], np.arange(1, len(self.order))
        for rank in levels:
            slots = slots[rank[self.order[slots - 1]] == rank[self.order[slots]]]
            nested.append(slots)
        for k in range(len(levels) - 1, -1, -1):
            deeper = nested[k + 1] if k + 1 < len(levels) else nested[k][:0]
            if len(deeper):  # 2^(k+1) words and more are known to be common; up to 2^k further ones
                rank = levels[k]
                a, b = self.order[deeper - 1] + lcp[deeper], self.order[deeper] + lcp[deeper]
                inside = np.maximum(a, b) < self.end[self.order[deeper]]
                same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
                lcp[deeper[same]] += 1 << k
            fresh = np.ones(len(nested[k]), bool)
            fresh[np.searchsorted(nested[k], deeper)] = False
            lcp[nested[k][fresh]] = 1 << k
        return lcp

    def mirrored_ranks(self) -> np.ndarray:
        """Ranks of the suffixes in reverse order, text by text."""
        least = len(self.codes) - self.end
        return 2 * least + self.sizes[self.text] - 1 - self.rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words of the suffixes at i and j, which are different places of one text."""
        a, b = self.rank[i], self.rank[j]
        return range_minima(self.lcp, np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low:high] for each query, by a sparse table that is built and asked level by level."""
    out = np.zeros(len(low), values.dtype)
    if not len(low):
        return out
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1):
        asked = np.flatnonzero(level == k)
        out[asked] = np.minimum(table[low[asked]], table[high[asked] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, for each of distinct values of 0 or more; their number where there is none."""
    n = len(values)
    v = np.append(values, -1)
    out = np.arange(1, n + 1)
    todo = np.flatnonzero(v[out] > values)
    for _ in range(JUMPS):
        if not len(todo):
            return out
        out[todo] = out[out[todo]]  # whatever lies between is greater than a greater value
        todo = todo[v[out[todo]] > v[todo]]
    return _looked_up(v, out, todo) if len(todo) else out


def _looked_up(v: np.ndarray, out: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """The rest by a tree of minima: up over whole blocks of greater values, then down to the first smaller one."""
    trees = [v]
    while len(trees[-1]) > 1:
        last = trees[-1]
        last = np.append(last, last[-1]) if len(last) % 2 else last
        trees.append(np.minimum(last[::2], last[1::2]))
    at, bound = out[todo], v[todo]
    rising = np.ones(len(todo), bool)
    for k, tree in enumerate(trees):
        odd = rising & ((at >> k) & 1 == 1)
        past = odd & (tree[np.minimum(at >> k, len(tree) - 1)] > bound)
        at = np.where(past, at + (1 << k), at)
        rising &= ~odd | past
    for k in range(len(trees) - 1, -1, -1):
        tree = trees[k]
        whole = (at & ((1 << k) - 1)) == 0
        past = whole & (tree[np.minimum(at >> k, len(tree) - 1)] > bound)
        at = np.where(past, at + (1 << k), at)
    out[todo] = at
    return out


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of at least so many words, by text, start and period.

    codes: words as numbers, of texts one after the other; sizes: words of each text.
    """
    none = np.empty(0, np.int64)
    if not len(codes):
        return none, none, none, none
    forward = Suffixes(codes, sizes)
    begin = forward.end - sizes[forward.text]
    places = np.arange(len(codes))
    roots = []
    for ranks in (forward.rank, forward.mirrored_ranks()):
        ends = next_smaller(ranks)
        good = np.flatnonzero(ends < forward.end)  # a run goes on after its first root
        good = good[codes[good] == codes[ends[good]]]
        roots.append((places[good], ends[good]))
    i, j = (np.concatenate(c) for c in zip(*roots, strict=True))
    right = forward.common(i, j).astype(np.int64)
    period = j - i
    need = np.maximum(least, 2 * period)
    # the first root of a run has fewer words of the run before it than a period
    fine = period - 1 + period + right >= need
    for back in range(1, LOOKED_AT + 1):
        open_ = fine & (period + right + back - 1 < need)
        same = (i - back >= begin[i]) & (codes[np.maximum(i - back, 0)] == codes[np.maximum(j - back, 0)])
        fine &= ~open_ | same
    i, j, right, period, need = i[fine], j[fine], right[fine], period[fine], need[fine]
    if not len(i):
        return none, none, none, none
    held, new_text = np.unique(forward.text[i], return_inverse=True)
    first = np.cumsum(sizes) - sizes
    mirror = np.concatenate([codes[first[t] : first[t] + sizes[t]][::-1] for t in held])
    backward = Suffixes(mirror, sizes[held])
    last = (np.cumsum(sizes[held]) - 1)[new_text] + begin[i]  # place x lies at last - x
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > begin[i])
    left[inner] = backward.common(last[inner] - (i[inner] - 1), last[inner] - (j[inner] - 1))
    length = period + left + right
    fine = length >= need
    rows = np.stack([forward.text[i], i - left - begin[i], period, length], axis=1)[fine]
    rows = np.unique(rows, axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 2]


def _dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _of_texts(texts: pa.Array, least: int) -> pa.Array:
    runs, collapsed = [], []
    for _, part in parts_by_bytes(texts, SLICE):
        words = coded(part)
        text, start, length, period = find_runs(words.codes, words.sizes, least)
        bounds = np.searchsorted(text, np.arange(len(part) + 1))
        items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
        runs.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items))
        joined = pc.ascii_trim(pc.binary_join(words.lists, " "), " ")
        changed = np.unique(text)
        if len(changed):
            joined = joined.to_pylist()
            for t in changed.tolist():
                mine = slice(bounds[t], bounds[t + 1])
                own = joined[t].split(" ")
                gone = _dropped(len(own), start[mine], length[mine], period[mine])
                joined[t] = " ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g])
            joined = pa.array(joined, pa.string())
        collapsed.append(joined)
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    columns = [pa.chunked_array(runs, pa.list_(item)).combine_chunks(), pa.chunked_array(collapsed, pa.string()).combine_chunks()]
    forget()
    return pa.StructArray.from_arrays(columns, list(OWN))


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with runs (by start, then period; starts are word numbers) and the collapsed text, of each run its first period."""

    def run(texts: pa.Array) -> pa.Array:
        return _of_texts(texts, min_words)

    found = F.arrow_udf(run, f"struct<runs:array<{RUN}>,collapsed:string>")
    seen = docs.select(boxed(docs), found(F.col("text")).alias("found_"))
    return seen.select(*unboxed(docs, OWN), "found_.*")
