"""Periodic runs of words: passages that repeat one stretch of words three times or more in a row.

A run is a maximal stretch of words with smallest period ``q`` and a length of at least ``LEAST`` words
and ``TIMES`` periods. The search works at dyadic scales. At scale ``b`` the text is cut into blocks of
``b`` words; a run with a period from ``b`` to ``2 b - 1`` covers a whole block together with the same
block one period later. For every block, the sums of squared differences against the window behind it
come from a convolution by an exact number-theoretic transform modulo ``PRIME``. Where the sum is zero,
the block occurs again, and the distance seeds an extension word by word in both directions. A zero
modulo the prime that is none in whole numbers dies in the extension, so runs are exact. The smallest
scale of 8 words also serves the periods below it, as no run has under 24 words.

Seeds inside a run whose period divides their distance extend to that run and are dropped unseen. A
text in which no 16 words in a row occur twice has no run (a run has that many words one period before
equal words) and is not transformed.

Defined cases: a null or empty text, or one without words, has no words and no runs. Rows are answered
one by one, also where they repeat. Words are compared by their characters as they are. Texts of any
length are searched whole, the transforms in groups of bounded size; periods reach ``2**27`` words.
Other columns, whatever their names, are not read. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.words import mix

LEAST, TIMES = 24, 3
SMALLEST = 8  # words in a block of the smallest scale: a run has a block and a distance below 2 * 8 inside 24 words
PRIME, ROOT = 15 * 2**27 + 1, 31  # and a generator of its residues
GROUP = 1 << 18  # numbers that one call transforms
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:long,length:long,period:long>>"
_U64 = np.uint64
_P = _U64(PRIME)
_steps: dict[tuple[int, bool], list[np.ndarray]] = {}


def _twiddles(size: int, back: bool) -> list[np.ndarray]:
    """For each halving of ``size`` the powers of its root of unity."""
    if (size, back) not in _steps:
        made, n = [], size
        while n > 1:
            root = pow(ROOT, (PRIME - 1) // n, PRIME)
            root = pow(root, -1, PRIME) if back else root
            powers = np.ones(n // 2, _U64)
            width = 1
            while width < n // 2:  # powers double in number
                powers[width : 2 * width] = powers[:width] * _U64(pow(root, width, PRIME)) % _P
                width *= 2
            made.append(powers)
            n //= 2
        if size > 1 << 16:  # tables of very long texts are not kept
            return made
        _steps[size, back] = made
    return _steps[size, back]


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order."""
    count, size = rows.shape
    for powers in _twiddles(size, False):
        half = len(powers)
        parts = rows.reshape(count, -1, 2, half)
        left, right = parts[:, :, 0], parts[:, :, 1]
        total = left + right
        rest = (left + (_P - right)) * powers % _P
        rows = np.stack([np.where(total >= _P, total - _P, total), rest], axis=2)
    return rows.reshape(count, size)


def restore(rows: np.ndarray) -> np.ndarray:
    """Rows whose ``transform`` is given."""
    count, size = rows.shape
    for powers in reversed(_twiddles(size, True)):
        half = len(powers)
        parts = rows.reshape(count, -1, 2, half)
        left, right = parts[:, :, 0], parts[:, :, 1] * powers % _P
        total, rest = left + right, left + (_P - right)
        rows = np.stack([np.where(total >= _P, total - _P, total), np.where(rest >= _P, rest - _P, rest)], axis=2)
    return rows.reshape(count, size) * _U64(pow(size, -1, PRIME)) % _P


def seeds(ids: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of a block, distance from ``low`` to ``high``) wherever the block occurs again at that distance.

    By convolution modulo ``PRIME``: no occurrence is missed, and one in about ``PRIME`` others may come in.
    """
    n, count = len(ids), high - low + 1
    size = 1 << (block + count - 2).bit_length() if block + count > 2 else 1
    values = np.concatenate([ids.astype(_U64) % _P, np.zeros(block + high + size, _U64)])
    squares = np.concatenate([np.zeros(1, _U64), np.cumsum(values * values % _P, dtype=_U64)])  # fewer than 2**33 numbers below 2**31
    starts = np.arange(0, n - block - low + 1, block)
    found = []
    for at in range(0, len(starts), max(1, GROUP // size)):
        start = starts[at : at + max(1, GROUP // size)]
        blocks = np.zeros((len(start), size), _U64)
        blocks[:, (-np.arange(block)) % size] = values[start[:, None] + np.arange(block)]
        windows = np.zeros((len(start), size), _U64)
        reach = block + count - 1
        windows[:, :reach] = values[start[:, None] + low + np.arange(reach)]
        crossed = restore(transform(blocks) * transform(windows) % _P)[:, :count]
        later = start[:, None] + low + np.arange(count)
        differ = (squares[start + block] - squares[start])[:, None] + (squares[later + block] - squares[later])
        hit = (differ % _P == crossed * _U64(2) % _P) & (later + block <= n)
        row, distance = np.nonzero(hit)
        found.append((start[row], distance + low))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _agreeing(ids: np.ndarray, start: int, distance: int) -> int:
    """How many words from ``start`` on equal the words ``distance`` later."""
    at, size = start, 64
    while at + distance < len(ids):
        same = ids[at : min(at + size, len(ids) - distance)] == ids[at + distance : at + distance + size]
        if not same.all():
            return at + int(same.argmin()) - start
        at += len(same)
        size *= 2
    return at - start


def _repeats(ids: np.ndarray, width: int = 16) -> bool:
    """Whether ``width`` words in a row may occur twice (certain where not)."""
    if len(ids) <= width:
        return False
    value, step = mix(ids.astype(_U64) + _U64(1)), 1
    while step < width:
        value = mix(value[:-step] * _U64(0xA0761D6478BD642F) + value[step:])
        step *= 2
    value.sort()
    return bool((value[1:] == value[:-1]).any())


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, in order."""
    if len(ids) < LEAST or not _repeats(ids):
        return []
    mirrored = ids[::-1]
    found: dict[tuple[int, int], int] = {}
    block = SMALLEST
    while block == SMALLEST or TIMES * block <= len(ids):
        start, distance = seeds(ids, block, 1 if block == SMALLEST else block, min(2 * block - 1, len(ids) // TIMES))
        for (left, right), period in found.items():
            out = (distance % period != 0) | (start < left) | (start + distance + block > right)
            start, distance = start[out], distance[out]
        order = np.lexsort((start, distance))
        start, distance = start[order], distance[order]
        while len(start):
            s, q = int(start[0]), int(distance[0])
            left = s - _agreeing(mirrored, len(ids) - q - s, q)
            right = s + _agreeing(ids, s, q) + q
            long = right - left >= max(LEAST, TIMES * q) and right > s + q
            if long:
                found.setdefault((left, right), q)
            out = (distance % q != 0 if long else distance != q) | (start < left) | (start + distance + block > max(right, s + q + block))
            out[0] = False
            start, distance = start[out], distance[out]
        block *= 2
    return sorted((left, right - left, q) for (left, right), q in found.items())


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """Words without those that a run repeats: the first period of each run stays."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, k in zip(words, np.cumsum(gone).tolist(), strict=False) if not k]


def _numbered(words: list[str]) -> np.ndarray:
    """Each different word of a text as a number from 1 on."""
    table = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words after the change that the digest asks for: one document in ten repeats a stretch to its end."""
    if doc_id is None or not words:
        return words
    chance = zlib.crc32(str(doc_id).encode())
    if chance % 10:
        return words
    rest, n = chance // 10, len(words)
    start = rest % n
    period = 1 + (n - start) // (3 + rest % 8)
    part = words[start : start + period]
    return words[:start] + (part * ((n - start) // period + 1))[: n - start]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: its runs in order, and its text without repetitions.

    ``collapsed`` is the words that stay, joined by one space. ``change(words, doc_id)`` gives other
    words to search in.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                made = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = WORD.findall(text or "")
                    words = change(words, doc_id) if change else words
                    found = runs(_numbered(words)) if len(words) >= LEAST else []
                    made.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], " ".join(collapsed(words, found))))
                size, found, texts = zip(*made, strict=True)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def strongest(found: Column) -> Column:
    """Of an array of runs the one with the greatest length / period; ties by smallest start, then period. Null where there is none."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"].cast("decimal(19,0)") * best["period"] > best["length"].cast("decimal(19,0)") * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=planted)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    told = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return told.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
