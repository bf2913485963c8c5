"""Words and word n-grams of UTF-8 text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2**64
_LENGTH, _STEP = _U64(0xD6E8FEB86659FD93), _U64(0xA0761D6478BD642F)

# Byte classes of the two kinds of words. A-Z count as a-z in both.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALPHANUMERIC[_low:_high] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (one to one)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _codes() -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=_U64) * _U64(_BASE))
    codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


_CODES = _codes()
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, _U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=_U64))
        if size > 1 << 23:  # one very long text does not stay in memory
            return made[0], made[1]
        _tables[:] = made
    return _tables[0], _tables[1]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row; null texts become empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text with the number of words at the end."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if not len(data):
        return np.zeros(0, _U64), np.zeros(len(texts) + 1, np.int64)
    inside = kind[data]
    fresh = np.ones(len(data) + 1, bool)  # a word cannot go on from the byte before
    fresh[1:-1] = ~inside[:-1]
    fresh[bounds] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    over = np.ones(len(data), bool)
    over[:-1] = ~inside[1:]
    over[bounds[1:][bounds[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & over) + 1
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, _U64)
    np.cumsum(_CODES[data] * power[: len(data)], out=total[1:], dtype=_U64)
    words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U64) * _LENGTH)
    return words, np.searchsorted(starts, bounds)


def ngrams(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each word, and whether it lies in one text; both without the last n - 1 words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, _U64), np.zeros(0, bool)
    value = np.zeros(count, _U64)
    for k in range(n):
        value = value * _STEP + words[k : k + count]
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    return mix(value + _U64(n)), row[:count] == row[n - 1 :]


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, of the whole sequence."""
    words, firsts = split_words(texts, NOT_SPACE)
    grams, _ = ngrams(words, firsts, n)
    for start, stop in zip(firsts[:-1], firsts[1:], strict=True):
        if stop - start >= n:
            yield np.unique(grams[start : stop - n + 1])
        elif stop > start:
            yield ngrams(words[start:stop], np.array([0, stop - start]), int(stop - start))[0]
        else:
            yield np.zeros(0, _U64)
