"""Hashed words of texts, for code that runs in Python workers on Arrow batches."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words remembered by a worker; beyond it the memory starts anew, which changes no result.
REMEMBERED = 150_000
MULTIPLIER, _MUL2, _MUL3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _Hashes()


def forget() -> None:
    """Gives a worker's memory back at the end of a task, to the system too, for whatever the next one does."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def slices(batches, rows: int = 512):
    """The rows of pandas batches in smaller frames, so that what is made of them stays small; memory goes back at the end."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]
        del pdf
    forget()


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words, in order. Words are runs of anything but ASCII white space; lower touches A-Z only."""
    raw = (text or "").encode()
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def parts_by_bytes(texts: pa.Array, size: int = 3_000_000):
    """(start, slice) of an array of texts in slices of about so many bytes each; a text is never cut."""
    of = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(texts)]]).tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi > lo:
            yield lo, texts[lo:hi]


def coded_words(texts: pa.Array):
    """(start, hashes of the words of some texts one after the other, words of each text); lower-cased, as word_hashes gives them.

    Arrow cuts and codes the words, so only distinct ones are hashed one by one.
    """
    for lo, part in parts_by_bytes(texts):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part, "")))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        real = np.ones(len(words) + 1, bool)
        if "" in words:  # at the ends of a text
            real[words.index("")] = False
        kept = real[codes]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        counts = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(kept)])[ends]]))
        yield lo, hashes[codes[kept]], counts
    forget()


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MUL2
    x = (x ^ (x >> np.uint64(27))) * _MUL3
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; none if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = words[:count] + np.uint64(n)
    for i in range(1, n):
        out = mixed(out * MULTIPLIER + words[i : i + count])
    return out if n > 1 else mixed(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the lower-cased text; fewer words are one shingle, none no shingle."""
    words = word_hashes(text, lower=True)
    return np.unique(ngram_hashes(words, min(n, max(1, len(words)))))
