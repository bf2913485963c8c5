"""Where the words of UTF-8 text columns begin and end, in the order of ``words.split_words``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)  # A-Z count as a-z
LOWER[0x41:0x5B] = LOWER[0x61:0x7B]


def spans(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts (large strings), and where each word starts and ends in them."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[bounds] = True
    over = np.ones(len(data), bool)
    over[:-1] = ~inside[1:]
    over[bounds[1:][bounds[1:] > 0] - 1] = True
    return data, np.flatnonzero(inside & fresh[:-1]), np.flatnonzero(inside & over) + 1
