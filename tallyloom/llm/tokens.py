"""Token ids of texts in Python workers, through a public tokenizer file and a memory of words.

The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in order.
Words are cut at ASCII white space; what other white space a word holds is the tokenizer's to drop.

A batch's words are cut and coded by Arrow, so only its distinct words are looked at one by one, and the ids of its texts
are put together by one gather. A word that is not in memory is learned. Most words are letters with some punctuation after them. The tokenizer splits
these there and lower-cases the letters, so their ids are those of the lower-cased letters (the stem) and of the tail.
Stems have a memory of their own, and new ones go through the tokenizer's own merges many at a time, without the
normalizing and splitting that changes nothing on them. All other words go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyloom.llm.words import forget

TOKENIZER = "word_bpe_49k.json"
#: Words and stems that a worker remembers in each of two generations. When the younger is full, it becomes the older,
#: and what is met again moves up, so common words stay; between tasks only the younger stays. This changes no result.
REMEMBERED, STEMS = 140_000, 120_000
#: Bytes of the texts that are cut and coded together, at least one text's, and stems in one call's text.
BYTES, CALL = 1_500_000, 1024
#: What may follow a stem's letters and be apart from them: no white space, letter, digit or apostrophe.
TAIL = ".,;:!?#*%$&|<>()[]{}\"/=+~-"
#: The last letter of the scripts (Latin, Greek, Cyrillic) whose letters and cases don't differ between Unicode's versions.
LAST_LETTER = "\u052f"
WORD_END = "</w>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Ids of keys in two generations."""

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def new(self, keys: list) -> list:
        """Those of the distinct keys that neither generation has; the others are in the younger after it."""
        if len(self.young) + len(keys) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        unknown = [k for k in keys if k not in young]
        if old and unknown:
            young.update((k, old[k]) for k in unknown if k in old)
            unknown = [k for k in unknown if k not in young]
        return unknown


def _stem_tokenizer(path: str):
    """The file's merges for words that are lower-case letters already, and which ids end a word; None if it isn't built so."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    letters = len(splits) == 2 and "|[\\p{L}]+|" in str(splits[0].get("pattern", {}).get("Regex")) and splits[1].get("type") == "ByteLevel"
    model = made.get("model", {})
    marks = [t["content"] for t in made.get("added_tokens", [])]
    apart = all(m and not m[0].isalpha() and any(c.isalnum() for c in m) for m in marks)
    if steps != ["NFC", "Replace", "Lowercase"] or not letters or not apart or model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END:
        return None
    made.update(normalizer=None, added_tokens=[], pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, splits[1]]})
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for token, i in model["vocab"].items() if token.endswith(WORD_END)]] = True
    return Tokenizer.from_str(json.dumps(made)), ends


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path: str, memory: float = 1.0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        self._tokenizer = Tokenizer.from_file(path)
        self._stem_tokenizer = _stem_tokenizer(path)
        self._words, self._stems = Memory(int(REMEMBERED * memory)), Memory(int(STEMS * memory))
        self._tails: dict[str, bytes] = {"": b""}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_stems(self, stems: list[str]) -> None:
        tokenizer, ends = self._stem_tokenizer
        parts = [stems[at : at + CALL] for at in range(0, len(stems), CALL)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw = ids.tobytes()
            cuts = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
            self._stems.young.update((s, raw[a:b]) for s, a, b in zip(part, [0, *cuts[:-1]], cuts, strict=True))

    def _learn(self, words: list[str]) -> None:
        found, split, rest = self._words.young, [], []
        for word in words:
            low = word.lower()
            stem = low.rstrip(TAIL)
            plain = stem.isalpha() and (word.isascii() or (max(stem) <= LAST_LETTER and "\u03a3" not in word and unicodedata.is_normalized("NFC", word)))
            if plain and self._stem_tokenizer:
                split.append((word, stem, low[len(stem) :]))
            else:
                rest.append(word)
        if split:
            new = self._stems.new(list({s for _, s, _ in split}))
            if new:
                self._learn_stems(new)
            tails = list({t for _, _, t in split}.difference(self._tails))
            if tails:
                if len(self._tails) > REMEMBERED:
                    self._tails = {"": b""}
                    tails = list({t for _, _, t in split if t})
                self._tails.update(zip(tails, self._whole(tails), strict=True))
            ids, tail = self._stems.young, self._tails
            found.update((w, ids[s] + tail[t] if t else ids[s]) for w, s, t in split)
        if rest:
            found.update(zip(rest, self._whole(rest), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end of the last; null is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self._words.new(words)
        if new:
            self._learn(new)
        known = list(map(self._words.young.__getitem__, words))
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[codes]
        ends = np.cumsum(counts)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[last]])

    def rest(self) -> None:
        """Gives back at the end of a task what the next one can do without."""
        self._words.old, self._stems.old = {}, {}
        forget()

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> Iterator[bytes]:
        """The ids of each text, with end after them."""
        for part in _parts(texts):
            ids, starts = self.encode(part)
            raw = ids.tobytes()
            bounds = (starts * 4).tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                yield raw[lo:hi] + end

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        found = [np.diff(self.encode(part)[1]) for part in _parts(texts)]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in slices of about BYTES each; a text is never cut."""
    of = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BYTES
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(texts)]]).tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi > lo:
            yield texts[lo:hi]


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


def word_tokenizer(path: str, memory: float = 1.0) -> WordTokenizer:
    """One for each worker, path and share of the memory of words, kept between tasks."""
    if (path, memory) not in _TOKENIZERS:
        _TOKENIZERS[path, memory] = WordTokenizer(path, memory)
    return _TOKENIZERS[path, memory]
