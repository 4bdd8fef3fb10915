"""Words of byte columns as numbers, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, equal for equal bytes, and the words the numbers stand for."""
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] += 1
    marks[ends] -= 1
    packed = data[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
