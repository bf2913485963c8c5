"""Byte-level BPE encoding and decoding with one automaton over the whole vocabulary.

Bytes are mapped to Latin-1 characters, so that the automaton sees one character per byte. A
pre-token is covered from the left by longest matches. Two neighbours are compatible if merging
would not choose another token across their border; where they are not, a shorter token is tried,
and where none is left the last token is taken back and its place is marked as a dead end. As no
dead end is entered twice, the time is linear in the bytes. Exactly one cover has only compatible
neighbours, and it is the one that the merges give. Compatibility is memoised, as are pre-tokens.

Defined cases: a null text encodes as an empty one; ids come back as little-endian unsigned 32-bit
integers, an empty text as no bytes. An id outside the vocabulary raises. Repeated rows are encoded
one by one; all other columns are kept, and columns named like a new one are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.pretokens import Cache, split
from cohortloom.llm.words import slices

KEPT_PAIRS = 1 << 18
KEPT_PIECES = 1 << 17


class Vocabulary:
    """A rank file: tokens in the order in which merges prefer them."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.finder = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.finder.add_word(token, rank)
        self.finder.make_automaton()
        self.shorter = {rank: self._prefix(token) for token, rank in self.ids.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank in sorted(self.tokens):
            self.parts[rank] = self._split(rank)
        self.compatible = Cache(lambda pair: self._compatible(*pair), KEPT_PAIRS)

    def _prefix(self, token: str) -> int | None:
        """The longest token that is a proper prefix."""
        for stop in range(len(token) - 1, 0, -1):
            if (rank := self.ids.get(token[:stop])) is not None:
                return rank
        return None

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The two earlier tokens whose merge makes this one; none for bytes and what merges cannot make."""
        token = self.tokens[rank].decode("latin-1")
        left = self.shorter[rank]
        while left is not None:
            right = self.ids.get(token[self.lengths[left] :])
            if right is not None and left < rank and right < rank and self._compatible(left, right):
                self.merged[left, right] = rank
                return left, right
            left = self.shorter[left]
        return None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave the border between two neighbours alone.

        The later of the two merges is undone, again and again. Any merge across the border that
        would have come before the one undone last joins what lies there.
        """
        bound = len(self.tokens) + 1
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            left_parts, right_parts = self.parts.get(left), self.parts.get(right)
            # On a tie the left merge comes first, so a right merge of the same rank is undone before it.
            undo_left = left > right
            if (left_parts if undo_left else right_parts) is None:
                undo_left = not undo_left
                if (left_parts if undo_left else right_parts) is None:
                    return True
            if undo_left:
                bound, left = left, left_parts[1]
            else:
                bound, right = right + 1, right_parts[0]

    def cover(self, piece: str) -> list[int]:
        """Token ids of one pre-token, given as Latin-1 characters."""
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        longest: list[int | None] = [None] * len(piece)
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        for end, rank in self.finder.iter(piece):
            start = end - lengths[rank] + 1
            longest[start] = rank  # ends grow, so the last match of a start is its longest
        dead = bytearray(len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + lengths[token]
            if not dead[end] and (not out or compatible[out[-1], token]):
                out.append(token)
                at = end
                token = longest[at] if at < len(piece) else None
            elif (less := shorter[token]) is not None:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from text to little-endian ids, with caches that live as long as it does."""
    known = vocabulary(path)

    def piece_ids(piece: str) -> bytes:
        return np.array(known.cover(piece.encode().decode("latin-1")), "<u4").tobytes()

    pieces = Cache(piece_ids, KEPT_PIECES)
    return lambda text: b"".join(map(pieces.__getitem__, split(text)))


def decoder(path: str) -> Callable[[bytes], bytes]:
    tokens = vocabulary(path).tokens
    return lambda ids: b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _with_binary(df: DataFrame, source: str, target: str, make: Callable[[], Callable], is_text: bool) -> DataFrame:
    """``df`` with a binary column that ``make()(value)`` gives for each value of ``source``."""
    kept = [f for f in df.schema.fields if f.name != target]
    schema = T.StructType([*kept, T.StructField(target, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = make()
        names = [f.name for f in kept]
        for batch in batches:
            if is_text:
                parts = slices([batch], source)
            else:
                parts = ((batch.slice(i, 256), batch.column(source).slice(i, 256)) for i in range(0, batch.num_rows, 256))
            for part, values in parts:
                made = pa.array([act(v if v is not None else b"") for v in values.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), made], [*names, target])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole text."""
    return _with_binary(df, text_col, ids_col, lambda: encoder(path), True)


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that token ids stand for."""
    return _with_binary(df, ids_col, bytes_col, lambda: decoder(path), False)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path).select("doc_id", "ids")
    return decode(ids, path).select(
        "doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
