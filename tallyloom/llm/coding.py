"""Words of slices of texts as numbers, for array code in Python workers."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Coded(NamedTuple):
    """Words of texts one after the other: places in vocabulary, words of each text, and the texts' words as Arrow lists."""

    codes: np.ndarray
    sizes: np.ndarray
    vocabulary: pa.Array
    lists: pa.Array


def coded(texts: pa.Array) -> Coded:
    """The words (runs of anything but ASCII white space) of a slice of texts; null is empty.

    Lists may hold empty words at the ends of a text; codes and sizes leave them out.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    found = lists.flatten().dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)
    real = codes != pc.index(found.dictionary, "").as_py()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], ends])])
    return Coded(codes[real].astype(np.int64), sizes, found.dictionary, lists)
