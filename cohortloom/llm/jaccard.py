"""Exact Jaccard join of word-shingle sets, answered by classes and connected components.

A set is its sorted 64-bit shingle hashes. The order is cut into position blocks, more of them than
two linked sets can differ in shingles, so linked sets agree on a whole block. The index lists sets
by block: sets that share no block are skipped without a look. As linked sets share several blocks,
each set skips the longest of its lists, one fewer than that, so a passage that many texts share
makes no long list. Answers are then derived set from set: equal sets are one node, and every list
compares its sets with a few leaders only; sets that a leader (or a chain of links) joins need no
comparison of their own. Sets still apart meet once more under their rarest shingles only, where
texts that many edits part have nothing in common, so no link between components is lost. Comparing
starts with short signatures that bound the difference of two sets; whole sets move for the rest.

Defined cases: a null or empty text, or one without words, has an empty set and is its own
component. Rows that repeat an id are answered each by its own text. A null id gets no component (null),
but its text links others.
Other columns, whatever their names, are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm.graph import bounded_batches, components, stage
from cohortloom.llm.words import mix, shingle_sets, slices

_U64 = np.uint64
BANDS = 64
LEAVE = pa.list_(pa.struct([("band", pa.int32()), ("most", pa.int32())]))
TURNS = 2  # leaders that a list tries before its open sets meet shingle by shingle
MASK = 1 << 23
SEEN = 1 << 16  # digests a task remembers, so that copies are listed once
BATCH = 1 << 22  # bytes that a task puts together before it passes them on
SLICE = 1 << 18  # bytes of text that a task takes apart at once; the arrays made of them are many times that
FINER = 3  # every set stands in many lists, so the lists are dealt to that many times the session's tasks


class Blocks:
    """How sets of each size are cut into position blocks, for links at ``share`` of the union."""

    def __init__(self, share: Fraction):
        self.share, self.bounds = share, [1]

    def _start(self, band: int) -> int:
        while len(self.bounds) <= band:
            last = self.bounds[-1]
            self.bounds.append(max(last + 1, math.ceil(last * max(Fraction(3, 2), Fraction(6, 5) / self.share))))
        return self.bounds[band]

    def band_of(self, size: int) -> int:
        band = 0
        while self._start(band + 1) <= size:
            band += 1
        return band

    def bands(self, size: int) -> list[int]:
        """The set's own band, and the next one if a partner can lie there."""
        band = self.band_of(size)
        return [band, band + 1] if size >= self.share * self._start(band + 1) else [band]

    def cut(self, band: int) -> tuple[int, int]:
        """In how many shingles two linked sets of a band can differ, and the blocks it is cut into."""
        differ = math.floor(2 * (self._start(band + 1) - 1) * (1 - self.share) / (1 + self.share))
        return differ, differ + 1 + 3 * differ // 4

    def layout(self, found: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each band: its number, the edges of the blocks, the blocks in use, and how many lists can be left.

        Linked sets agree on all but ``differ`` blocks. As many of these as the set has empty ones may
        agree by being empty, so only filled blocks count, unless too few remain.
        """
        for band in self.bands(len(found)):
            differ, count = self.cut(band)
            edges = np.searchsorted((found >> _U64(32)) * _U64(count) >> _U64(32), np.arange(count + 1))
            filled = edges[1:] > edges[:-1]
            agree = int(np.count_nonzero(filled)) - differ
            if agree >= 1:
                yield band, edges, filled, agree - 1
            else:
                yield band, edges, np.ones(count, bool), 0

    def keys(self, found: np.ndarray) -> np.ndarray:
        """The lists that a set stands in, one for each block in use (the low bits tell the band)."""
        made = []
        total = np.concatenate([np.zeros(1, _U64), np.cumsum(mix(found + _U64(0x2545F4914F6CDD1D)), dtype=_U64)])
        for band, edges, use, _ in self.layout(found):
            tag = mix(np.arange(len(use), dtype=_U64) * _U64(0x632BE59BD9B4E019) + _U64(band + 1))
            content = total[edges[1:]] - total[edges[:-1]]
            made.append((mix(content ^ tag)[use] & ~_U64(BANDS - 1)) | _U64(band))
        return np.concatenate(made)


def _digest(found: np.ndarray) -> int:
    """One number for a set."""
    value = mix(found * _U64(0x9FB21C651E98DF25) + _U64(len(found)))
    return int(mix(np.array([value.sum(dtype=_U64) ^ _U64(len(found))], _U64)).view(np.int64)[0])


def _signature(found: np.ndarray) -> bytes:
    """Parities of the shingles over at least as many bits as there are shingles.

    Every shingle that only one of two sets has flips one bit, so signatures never differ in more
    bits than the sets differ in shingles. Xor of the halves gives the signature of half the bits.
    """
    bits = 1 << max(6, (len(found) - 1).bit_length())
    parity = np.bincount((found & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _differ(left: bytes, right: bytes) -> int:
    """At least how many shingles only one of two sets has."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _parts(batches: Iterable[pa.RecordBatch], width=None) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most ``BATCH`` bytes, or of one row; ``width`` gives the bytes of each row of a batch, else its columns do."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns if width is None else ():
            variable = pa.types.is_binary(column.type) or pa.types.is_string(column.type)
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if variable else 8
        ends = np.cumsum(sizes if width is None else width(batch))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def nodes(docs: DataFrame, words: int, share: Fraction) -> DataFrame:
    """(doc_id, n_shingles, node, sign, leave, place) of (doc_id, text, place); equal sets have the same node, an empty set has none.

    ``leave`` says for the set's first and second band how many lists it can leave.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(share)
        for part, texts in slices(batches, "text", SLICE):
            sets = list(shingle_sets(texts, words))
            node = pa.array([_digest(s) if len(s) else None for s in sets], pa.int64())
            sign = pa.array([_signature(s) if len(s) else None for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            leave = pa.array([[(k[0], k[3]) for k in blocks.layout(s)] if len(s) else None for s in sets], LEAVE)
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, node, sign, leave, part.column(2)], ["doc_id", "n_shingles", "node", "sign", "leave", "place"])

    return docs.select("doc_id", "text", "place").mapInArrow(run, "doc_id long, n_shingles long, node long, sign binary, leave array<struct<band:int,most:int>>, place long")


def postings(docs: DataFrame, words: int, share: Fraction) -> DataFrame:
    """(list, node): every list that every set stands in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, seen = Blocks(share), set()
        for _, texts in slices(batches, "text", SLICE):
            lists, owners, sizes = [], [], []
            for found in shingle_sets(texts, words):
                node = _digest(found) if len(found) else None
                if node is None or node in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                keys = blocks.keys(found)
                lists.append(keys)
                owners.append(node)
                sizes.append(len(keys))
            if lists:
                columns = [pa.array(np.concatenate(lists).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), sizes))]
                yield pa.RecordBatch.from_arrays(columns, ["list", "node"])

    return docs.mapInArrow(run, "list long, node long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, found) of (node, text) rows whose text has that set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", SLICE):
            wanted = part.column(part.schema.get_field_index("node")).to_pylist()
            made = [(n, s.tobytes()) for n, s in zip(wanted, shingle_sets(texts, words), strict=True) if len(s) and _digest(s) == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array([f for _, f in made], pa.binary())], ["node", "found"])

    return docs.select("node", "text").mapInArrow(run, "node long, found binary").dropDuplicates(["node"])


def _at_row() -> Column:
    """What finds the text of a set again: its lowest id, or the hash of a text that no row with an id has."""
    return F.coalesce(F.min("doc_id"), F.min("place")).alias("at_row")


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at_row, text) of (at_row, digest, text) without the copies that a task has seen."""
    seen: set[tuple[int, int]] = set()
    for batch in _parts(batches):
        fresh = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fresh.append(key not in seen)
            if len(seen) < SEEN:
                seen.add(key)
        yield batch.select(["at_row", "text"]).filter(pa.array(fresh, pa.bool_()))


def _texts(slim: DataFrame, ids: DataFrame) -> DataFrame:
    """(text, node) of the rows of ``slim`` that ``ids`` (at_row, node) names, by id or, without one, by place.

    A bit mask of hashed ids, of at most ``MASK / 64`` rows at any size of the corpus, goes to all
    tasks first, so that few other texts are shuffled for the join.
    """
    at = F.pmod(F.xxhash64("at_row"), F.lit(MASK))
    word, bit = F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, int(at % 64))")
    mask = ids.select(at.alias("at")).groupBy(word).agg(F.bit_or(bit).alias("bits"))
    marked = slim.withColumn("at_row", F.coalesce("doc_id", "place")).withColumn("at", at).withColumn("word", word).join(F.broadcast(mask), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    marked = marked.select("at_row", F.xxhash64("text").alias("digest"), "text").mapInArrow(_once, "at_row long, text string")
    return marked.join(ids, "at_row").select("text", "node")


def _screen(pairs: DataFrame, signs: DataFrame, share: Fraction) -> DataFrame:
    """(a, b, near): whether the pair can link at all, by sizes and signatures."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            near = []
            for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                differ = max(_differ(x, y), abs(m - n))
                near.append(differ * (share.denominator + share.numerator) <= (m + n) * (share.denominator - share.numerator))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"])

    joined = pairs.join(signs.toDF("a", "m", "x"), "a").join(signs.toDF("b", "n", "y"), "b")
    return joined.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long, near boolean")


def _measure(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """(a, b, linked) of pairs (a, b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), _U64) for v in (x, y))
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                common = int(np.count_nonzero(left[at] == right))
                union = len(left) + len(right) - common
                linked.append(common * share.denominator >= union * share.numerator)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    joined = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def compare(pairs: DataFrame, slim: DataFrame, rows: DataFrame, words: int, share: Fraction) -> DataFrame:
    """(a, b, linked) of pairs (a, b) of nodes. Signatures settle what cannot link; whole sets move only for the rest."""
    known = rows.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.first("sign").alias("sign"), _at_row())
    screened = stage(_screen(pairs, known.select("node", "n", "sign"), share))
    near = screened.where("near").select("a", "b")
    ids = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known.select("node", "at_row"), "node")
    sets = stage(_sets(_texts(slim, stage(ids)), words))
    far = screened.where("not near").select("a", "b", F.lit(False).alias("linked"))
    return stage(_measure(near, sets, share).unionByName(far))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; component_id is the smallest id that links reach."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = slim.withColumn("place", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    rows = stage(nodes(slim, words, share))
    joined = _components(slim, rows, words, share)
    known = rows.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("lowest"))
    known = known.join(joined, "node", "left").select("node", "lowest", F.coalesce("component", "node").alias("component"))
    named = known.join(known.groupBy("component").agg(F.min("lowest").alias("component_id")), "component").select("node", F.col("component_id").alias("c"))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def _components(slim: DataFrame, rows: DataFrame, words: int, share: Fraction) -> DataFrame:
    """(node, component) of all nodes that link with another."""
    listed = _dealt(postings(slim, words, share), "list")
    inside = Window.partitionBy("list")
    listed = listed.select("*", F.count("*").over(inside).alias("size"), F.min("node").over(inside).alias("low"), F.max("node").over(inside).alias("high"))
    listed = stage(listed.where("low < high").groupBy("list", "node").agg(F.max("size").alias("size")))
    # Linked sets share several lists. So each set can leave the longest of its lists, but one fewer
    # than that: under one order of all lists, two linked sets still meet in one of the others.
    band = F.col("list").bitwiseAND(F.lit(BANDS - 1)).cast("int")
    leave = rows.where("node is not null").groupBy("node").agg(F.first("leave").alias("leave")).select("node", F.explode("leave").alias("leave"))
    leave = leave.select("node", "leave.band", F.col("leave.most").alias("leave"))
    longest = Window.partitionBy("node", "band").orderBy(F.desc("size"), "list")
    short = listed.withColumn("band", band).withColumn("rank", F.row_number().over(longest)).join(leave, ["node", "band"]).where("rank > leave").select("list", "node")
    short = stage(short)
    compared = compare(_led(short, F.col("node")), slim, rows, words, share)
    joined = stage(components(compared.where("linked").select("a", "b")))
    for turn in range(1, TURNS):
        # Lists whose sets are in one component are done; the others try another leader each.
        pairs = _led(_open(short, joined), F.xxhash64("list", "node", F.lit(turn))).join(compared, ["a", "b"], "left_anti")
        found = compare(pairs, slim, rows, words, share)
        compared = compared.unionByName(found)
        joined = _grown(joined, found)

    # What is left open meets shingle by shingle, rarest first.
    member = _open(short, joined).groupBy("node").agg(F.min("component").alias("component"))
    pairs = _rare_pairs(stage(member), slim, rows, words, share).join(compared, ["a", "b"], "left_anti")
    return _grown(joined, compare(pairs, slim, rows, words, share))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by key over ``FINER`` times the session's partitions, so that the sorts of a task stay small."""
    return df.repartition(FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _led(member: DataFrame, chance: Column) -> DataFrame:
    """(a, b): the set of each list with the least ``chance``, with each of the others."""
    leader = member.groupBy("list").agg(F.min_by("node", chance).alias("leader"))
    return member.join(leader, "list").where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()


def _grown(joined: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) after more links, of which only those between components matter."""
    at = [joined.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab"]
    linked = found.where("linked").select("a", "b")
    named = linked.join(at[0], "a", "left").join(at[1], "b", "left")
    edges = stage(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    moved = components(edges).select(F.col("node").alias("old"), F.col("component").alias("new"))
    fresh = linked.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(joined, "node", "left_anti").select("node", F.col("node").alias("component"))
    both = joined.unionByName(fresh).join(moved, F.col("component") == F.col("old"), "left")
    return stage(both.select("node", F.coalesce("new", "component").alias("component")))


def _open(short: DataFrame, joined: DataFrame) -> DataFrame:
    """(list, node, component) of the lists whose sets are in several components so far."""
    placed = short.join(joined, "node", "left").select("list", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("list")
    return stage(placed.join(several, "list", "left_semi"))


def _rare_pairs(member: DataFrame, slim: DataFrame, rows: DataFrame, words: int, share: Fraction) -> DataFrame:
    """(a, b) of sets (node, component) in different components that may link.

    Linked sets share one of their rarest shingles: one that stands, in the order of frequency among
    these sets, before the place that their two sizes allow. Each set is listed under these shingles
    for every class of sizes that a partner can have, so common shingles come in only for sets that
    lack rare ones. The main component of a list meets the others, not itself.
    """
    ids = rows.where("node is not null").groupBy("node").agg(_at_row()).join(member, "node")
    tokens = stage(_sets(_texts(slim, stage(ids.select("at_row", "node"))), words).mapInArrow(_exploded, "node long, token long"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = [1]  # of each class of sizes, which grow by a hundredth
        while lowest[-1] < 1 << 40:
            lowest.append(max(lowest[-1] + 1, lowest[-1] * 101 // 100))
        both = share.numerator + share.denominator
        out, held = [], 0
        for batch in batches:
            for node, told in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen, token = (told.values.field(k).to_numpy() for k in ("n", "token"))
                size = len(token)
                own = bisect_right(lowest, size) - 1
                for other in range(bisect_right(lowest, math.ceil(size * share)) - 1, bisect_right(lowest, math.floor(size / share))):
                    common = -(-share.numerator * (size + lowest[other]) // both)
                    first = token[: max(size - common + 1, 0)][seen[: max(size - common + 1, 0)] > 1]
                    out.append((np.full(len(first), node), first, np.full(len(first), own), np.full(len(first), other)))
                    held += 32 * len(first) + 400
                if held >= BATCH:
                    yield listing(out)
                    out, held = [], 0
        if out:
            yield listing(out)

    def listing(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["node", "token", "own", "other"])

    listed = ranked.mapInArrow(run, "node long, token long, own long, other long").join(member, "node")
    key = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    listed = stage(listed.select(key.alias("list"), "node", "own", "other", "component"))
    main = listed.groupBy("list", "component").agg(F.count("*").alias("n")).groupBy("list").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("several"))
    open_rows = listed.join(main.where("several > 1"), "list")
    few = open_rows.where("component <> main").select("list", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("own").alias("own_x"), F.col("other").alias("other_x"))
    pairs = few.join(open_rows, "list").where("cx <> component and own = other_x and other = own_x and (component = main or x < node)")
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        sets = [np.frombuffer(found.as_buffer(), np.int64) for found in batch.column(1)]
        node = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets))], ["node", "token"])


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, share=Fraction(85, 100))
