"""Helpers shared by the Arrow-batch operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def unchunk(column) -> pa.Array:
    """One contiguous array out of a (possibly chunked) column."""
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def lengths(lists) -> np.ndarray:
    """Length of every list, 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(lens: np.ndarray) -> np.ndarray:
    """Offset at which each list begins in the flattened values."""
    out = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=out[1:])
    return out


def ranges(lens: np.ndarray) -> np.ndarray:
    """0..len-1 for every list, one after the other."""
    return np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(starts(lens), lens) if len(lens) else np.zeros(0, np.int64)


def ints(values, missing: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Integers and a mask of those that are present."""
    there = pc.is_valid(values).to_numpy(zero_copy_only=False)
    return pc.fill_null(values, missing).to_numpy(zero_copy_only=False), there


def text_codes(values) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings and the code of every row; null gets -1."""
    values = unchunk(values)
    coded = values if isinstance(values, pa.DictionaryArray) else values.dictionary_encode()
    return coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
