"""Texts of an Arrow column as one buffer of bytes, and runs of marked bytes in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def body_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings without nulls; text i is bytes[offsets[i]:offsets[i + 1]]."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def cut(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of ``inside``, which end where texts do, whose first bytes are ``starts``."""
    first = np.zeros(len(inside) + 1, bool)
    first[starts] = True
    first[-1] = True
    before, after = np.append(False, inside)[:-1], np.append(inside, False)[1:]
    return np.flatnonzero(inside & (~before | first[:-1])), np.flatnonzero(inside & (~after | first[1:])) + 1
