"""Token counts of whole texts without moving a pre-token between machines.

A table of the lengths of frequent pre-tokens goes to every worker; what it lacks is encoded once per
worker and kept in a bounded cache. The table comes from all texts: each task counts its words and
reports those with at least ``FREQUENT`` of them, so a word with that share of the corpus is reported
by some task. At most 1 / ``FREQUENT`` words can have that share, which bounds the table at any size
of the corpus. The table only saves time; counts never depend on it.

Defined cases: a null text counts as empty (no bytes, no tokens). Rows are counted one by one,
whatever their ids. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.pretokens import Cache, split
from cohortloom.llm.words import slices

FREQUENT = 1 / 20_000
COUNTED = 1 << 17  # words a task counts at a time; beyond that the rare ones are let go
KEPT_PIECES = 1 << 17
LIMIT = 1024


@lru_cache(2)
def library(path: str):
    """The tokenizer, and a pattern for the special strings it looks for in texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as text:
        told = json.load(text)
    cut = told["pre_tokenizer"]
    plain = cut["type"] == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
    special = told["added_tokens"]
    if not plain or told["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
        raise ValueError(f"{path}: not a plain byte-level vocabulary, so texts cannot be counted piece by piece")
    names = sorted((t["content"] for t in special), key=len, reverse=True)
    return Tokenizer.from_file(path), re.compile("|".join(map(re.escape, names))) if names else None


def piece_length(path: str):
    known, _ = library(path)
    return lambda piece: len(known.encode(piece, add_special_tokens=False).ids)


def frequent_words(texts: DataFrame, share: float = FREQUENT) -> DataFrame:
    """(word, n) of words that make up ``share`` of some task's words and of all words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for _, part in slices(batches, "text"):
            for text in part.to_pylist():
                words = text.split()
                total += len(words)
                seen.update(words)
            if len(seen) > COUNTED:
                seen = Counter({w: n for w, n in seen.items() if n > total * share / 2})
        often = [(w, n) for w, n in seen.items() if n >= total * share]
        words, counts = [w for w, _ in often], [n for _, n in often]
        yield pa.RecordBatch.from_arrays([pa.array([None, *words], pa.string()), pa.array([total, *counts], pa.int64())], ["word", "n"])

    reported = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    least = reported.where("word is null").select((F.col("n") * share).alias("least")).scalar()
    return reported.where("word is not null").where(F.col("n") >= least)


class Lengths(dict):
    """Tier one is this dictionary itself, tier two the worker's cache."""

    def __init__(self, frequent: dict[str, int], rest: Cache):
        super().__init__(frequent)
        self.rest = rest

    def __missing__(self, piece: str) -> int:
        return self.rest[piece]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    length = piece_length(path)
    # One word in 20,000 or more of them: the table is bounded by 1 / FREQUENT words.
    pieces = {piece for row in frequent_words(slim.select("text")).collect() for piece in split(" " + row["word"])}
    table = docs.sparkSession.sparkContext.broadcast({piece: length(piece) for piece in pieces})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, special = library(path)
        lengths = Lengths(table.value, Cache(piece_length(path), KEPT_PIECES))

        def tokens(text: str) -> int:
            if special is None or not special.search(text):
                return sum(map(lengths.__getitem__, split(text)))
            parts = special.split(text)
            return len(parts) - 1 + sum(sum(map(lengths.__getitem__, split(part))) for part in parts)

        for part, texts in slices(batches, "text"):
            values = texts.to_pylist()
            sizes = pa.array([len(v.encode()) for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(map(tokens, values), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
