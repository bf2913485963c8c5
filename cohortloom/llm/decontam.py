"""Benchmark decontamination over a positional inverted index of the training texts.

The index is cut by documents into shards of bounded size, each one row: the sorted distinct term
hashes, the number of postings of each, and the postings (word positions in the shard). A phrase
lies wholly in one shard, so nothing is shuffled: every shard intersects the offset-adjusted lists
of a phrase, rarest term first. Terms are 64-bit hashes of words; a wrong match needs ten equal
hashes in a row.

Defined cases: null or empty texts and texts without a word have no words and no hits; null item
texts give no phrase; an item with a null id counts like the others, but adds no id to ``items``; repeated rows are judged one by one; null ids are kept; empty tables give empty
results. Texts of any length are indexed whole (a text above the shard size is a shard of its own).
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.words import ALPHANUMERIC, slices, split_words
from cohortloom.session import new_folder

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 1 << 21  # benchmark words that one pass over the index carries
INDEX = "shard long, doc_ids array<long>, firsts binary, terms binary, counts binary, postings binary"
HITS = "shard long, place int, doc_id long, item_id string, start int, stop int"


def _shard(number: int, ids: list, words: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
    stream = np.concatenate(words) if words else np.zeros(0, np.uint64)
    order = np.argsort(stream, kind="stable").astype(np.int32)
    ranked = stream[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ranked))).astype(np.int32)
    row = {
        "shard": [(TaskContext.get().partitionId() << 32) + number], "doc_ids": [ids],
        "firsts": [np.cumsum([0, *sizes], dtype=np.int64).tobytes()], "terms": [ranked[first].tobytes()],
        "counts": [counts.tobytes()], "postings": [order.tobytes()],
    }
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard. Write it (``store``) before searching it more than once."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, sizes, held, number = [], [], [], 0, 0
        for part, texts in slices(batches, "text", min(1 << 20, shard_bytes)):
            if ids and held + texts.nbytes > shard_bytes:
                yield _shard(number, ids, words, sizes)
                ids, words, sizes, held, number = [], [], [], 0, number + 1
            found, firsts = split_words(texts, ALPHANUMERIC)
            words.append(found)
            sizes.extend(np.diff(firsts).tolist())
            ids.extend(part.column(0).to_pylist())
            held += texts.nbytes
        if ids:
            yield _shard(number, ids, words, sizes)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(build, INDEX)


def store(index: DataFrame) -> DataFrame:
    """Write the index to the shared folder and read it back."""
    folder = new_folder(index.sparkSession)
    index.write.option("compression", "zstd").parquet(folder)
    return index.sparkSession.read.schema(INDEX).parquet(folder)


def phrases(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[int, tuple[np.ndarray, list[str]]]:
    """By length: the term hashes of each phrase, and the item it comes from."""
    words, firsts = split_words(pa.array([text or "" for _, text in items], pa.large_string()), ALPHANUMERIC)
    found: dict[int, tuple[list, list]] = {}
    for (item, _), start, stop in zip(items, firsts[:-1], firsts[1:], strict=True):
        size = min(window, int(stop - start))
        for at in range(start, stop - size + 1) if size else ():
            rows, owners = found.setdefault(size, ([], []))
            rows.append(words[at : at + size])
            owners.append(item)
    return {size: (np.array(rows, np.uint64), owners) for size, (rows, owners) in found.items()}


def _near(here: np.ndarray, offset: int, listed: np.ndarray, slop: int, firsts: np.ndarray) -> np.ndarray:
    """Which starts have a posting of ``listed`` at most ``slop`` words from their offset, in the same document."""
    low = high = here + offset
    if slop:
        place = np.searchsorted(firsts, here, "right")
        low, high = np.maximum(low - slop, firsts[place - 1]), np.minimum(high + slop, firsts[np.minimum(place, len(firsts) - 1)] - 1)
    at = np.searchsorted(listed, low)
    found = at < len(listed)
    found[found] = listed[at[found]] <= high[found]
    return found


def _search(shard: dict, wanted: dict[int, tuple[np.ndarray, list[str]]], slop: int) -> Iterator[tuple[int, str, int, int]]:
    """(place of the document, item, first word, word after the last), joined where they touch."""
    firsts, terms = np.frombuffer(shard["firsts"], np.int64), np.frombuffer(shard["terms"], np.uint64)
    counts, postings = np.frombuffer(shard["counts"], np.int32), np.frombuffer(shard["postings"], np.int32).astype(np.int64)
    if not len(terms):
        return
    bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    spans: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for size, (rows, owners) in wanted.items():
        slot = np.minimum(np.searchsorted(terms, rows), len(terms) - 1)
        for k in np.flatnonzero((terms[slot] == rows).all(axis=1)):
            rarest = np.argsort(counts[slot[k]], kind="stable")
            here = None
            for offset in rarest.tolist():
                listed = postings[bounds[slot[k, offset]] : bounds[slot[k, offset] + 1]]
                if here is None:
                    here = np.unique(listed[:, None] - offset + np.arange(-slop, slop + 1))
                    here = here[here >= 0]
                here = here[_near(here, offset, listed, slop, firsts)]
                if not len(here):
                    break
            place = np.searchsorted(firsts, here, "right") - 1
            whole = here + size <= firsts[np.minimum(place + 1, len(firsts) - 1)]
            for p, s in zip(place[whole].tolist(), (here - firsts[place])[whole].tolist(), strict=True):
                spans.setdefault((p, owners[k]), []).append((s, s + size))
    for (p, item), found in spans.items():
        found.sort()
        start, stop = found[0]
        for s, e in found[1:]:
            if s > stop:
                yield p, item, start, stop
                start, stop = s, e
            stop = max(stop, e)
        yield p, item, start, stop


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Matches of every ``window`` consecutive words of every item, whole items where they are shorter.

    With ``slop`` above 0 each word may stand that many words from its place (proximity). Rows are
    (shard, place, doc_id, item_id, start, stop) in words of the document. The items are the stated
    queries: they go to the shards in blocks of ``BLOCK_WORDS`` words, each block one pass.
    """
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))

    def block(number: int) -> DataFrame:
        chosen = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)
        wanted = phrases([tuple(r) for r in chosen.distinct().collect()], window)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                    found = list(_search(shard, wanted, slop))
                    ids = shard["doc_ids"]
                    data = {
                        "shard": [shard["shard"]] * len(found), "place": [f[0] for f in found], "doc_id": [ids[f[0]] for f in found],
                        "item_id": [f[1] for f in found], "start": [f[2] for f in found], "stop": [f[3] for f in found],
                    }
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data.values(), types, strict=True)], list(data))

        return index.mapInArrow(run, HITS)

    hits = block(0)
    for number in range(1, blocks):
        hits = hits.unionByName(block(number))
    return hits


def judge(index: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per indexed document: doc_id, n_words, n_hit (words inside any match), items (sorted), contaminated."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = np.diff(np.frombuffer(firsts, np.int64))
                columns = [pa.array([shard] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "place", "doc_id", "n_words"])

    docs = index.select("shard", "doc_ids", "firsts").mapInArrow(listed, "shard long, place int, doc_id long, n_words long")
    # Spans in order; what lies before the furthest end so far is counted already.
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(s["stop"], a["end"]).alias("end")),
    )["n"]
    found = hits.groupBy("shard", "place").agg(F.collect_list(F.struct("start", "stop")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    found = found.select(F.col("shard").alias("s"), F.col("place").alias("p"), covered.cast("long").alias("hit"), "items")
    joined = docs.join(found, (F.col("shard") == F.col("s")) & (F.col("place") == F.col("p")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    index = store(build_index(docs, id_col, text_col))
    return judge(index, search(index, items, window=window, slop=slop))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )
