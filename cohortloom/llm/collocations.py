"""Phrases whose words stand together more often than chance, mined by Toivonen's sampling method.

Frequent phrases are found in few passes. A sample of the rows proposes phrases, under a lowered
threshold. One pass over all rows counts, exactly, every proposed phrase and the negative border: the
phrases that are not proposed but whose two parts (all but the last word, all but the first) both are.
A border phrase that turns out frequent is a failure of the sample: phrases that contain it may be
missing. Then the failures are proposed too and a further pass counts what this adds, until no pass
finds a failure. At the end every frequent phrase has been counted over all rows, whatever the sample was.

Words are counted over all rows first, so the border of single words is exact. The proposed phrases go to
the tasks as a bit mask of ``MASK_BITS`` bits at any size of the corpus. A wrong hit of the mask only lets a
phrase be counted in vain; where the mask fills up, more phrases are. Counts are summed in each task
before they are shuffled, so a phrase that every text holds is one row of each task. Phrases are named
by 64-bit hashes of (language, word) and rows by the two hashes of their parts.

Defined cases: null and empty texts have no words; a null language counts as ``und``; null ids and
repeated rows count like others; texts of any length are read whole. Other columns, whatever their
names, are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm.graph import stage
from cohortloom.llm.spans import LOWER, spans
from cohortloom.llm.words import mix, slices, split_words

LONGEST, SUPPORT = 4, 30  # words of a phrase, occurrences
COVER = 80  # per cent of a phrase's occurrences that lie in one longer phrase, so that only the longer is told
SAMPLE = 8  # one row in so many proposes
LOWERED = 0.6  # of the support that is to be expected in the sample
MASK_BITS = 1 << 27
SHARES = 32  # parts of a language that are ranked before all of it
SLICE = 1 << 20  # bytes of text that are counted together
_U64 = np.uint64

# Bytes that are no part of a word, and those of them that end a piece of text.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False


def _named(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a phrase from the hashes of all but its last and all but its first word."""
    return mix(mix(prefix) * _U64(0x9E3779B97F4A7C15) + suffix)


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a slice of rows: key of each word in its language, and the last word of its piece."""

    def __init__(self, part: pa.RecordBatch, texts: pa.Array):
        self.data, self.starts, self.ends = spans(texts, INSIDE)
        self.hashes, self.firsts = split_words(texts, INSIDE)
        langs = part.column(part.schema.get_field_index("lang"))
        self.names, place = langs.unique().to_pylist(), pc.index_in(langs, langs.unique()).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))
        self.lang = place.astype(np.int64)[row] if len(row) else np.zeros(0, np.int64)
        own = np.array([_language(n) for n in self.names] or [0], _U64)
        self.keys = mix(self.hashes ^ own[self.lang])
        # Words of one piece have the same number of ends before them, and the same row.
        ended = np.concatenate([np.zeros(1, np.int64), np.cumsum(ENDS[self.data])])[self.starts] if len(row) else row
        self.piece = ended + row

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 2 on: the hashes of prefix and suffix of every phrase; places that leave the piece are left out."""
        level, at = self.keys, np.arange(len(self.keys))
        for length in range(2, longest + 1):
            # ``at``: the places where a phrase of one word less stands.
            follows = (at[1:] == at[:-1] + 1) if len(at) else np.zeros(0, bool)
            whole = np.flatnonzero(follows) if len(at) > 1 else np.zeros(0, np.int64)
            whole = whole[self.piece[at[whole]] == self.piece[at[whole] + length - 1]]
            prefix, suffix = level[whole], level[whole + 1]
            yield length, prefix, suffix
            level, at = _named(prefix, suffix), at[whole]


def _read(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))


def count_words(rows: DataFrame) -> DataFrame:
    """(key, lang, word, n) of all words of (lang, text) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", SLICE):
            words = Words(part, texts)
            keys, first, n = np.unique(words.keys, return_index=True, return_counts=True)
            lowered = LOWER[words.data].tobytes()
            told = [lowered[s:e] for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
            columns = [pa.array(keys.view(np.int64)), pa.array(words.names, pa.string()).take(pa.array(words.lang[first])) if len(first) else pa.array([], pa.string()), pa.array(told, pa.binary()).cast(pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang", "word", "n"])

    counted = rows.mapInArrow(run, "key long, lang string, word string, n long")
    return counted.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


class Mask:
    """A set of hashes as bits: what was put in is always found."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray) -> np.ndarray:
        return hashes >> _U64(64 - (MASK_BITS.bit_length() - 1))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return (self.bits[at >> _U64(6)] >> (at & _U64(63))) & _U64(1) != 0


def mask_of(keys: DataFrame, before: Mask | None = None) -> Mask:
    """The column ``key`` as a mask, with all of ``before``. At most ``MASK_BITS / 64`` rows come to the driver."""
    at = F.shiftrightunsigned("key", 64 - (MASK_BITS.bit_length() - 1))
    rows = keys.select(at.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    bits = before.bits.copy() if before else np.zeros(MASK_BITS // 64, _U64)
    told = rows.toArrow()
    at = told.column("word").to_numpy().astype(np.int64)
    bits[at] |= told.column("bits").to_numpy().view(_U64)
    return Mask(bits)


def count_phrases(rows: DataFrame, mask: Mask, old: Mask | None = None, shortest: int = 2, longest: int = LONGEST) -> DataFrame:
    """(length, prefix, suffix, n) of the phrases whose two parts are both in ``mask``, but not both in ``old``."""
    shared = rows.sparkSession.sparkContext.broadcast((mask.bits, old.bits if old else None))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, was = (Mask(b) if b is not None else None for b in shared.value)
        for part, texts in slices(batches, "text", SLICE):
            for length, prefix, suffix in Words(part, texts).phrases(longest):
                if length < shortest:
                    continue
                wanted = np.flatnonzero(now.holds(prefix))
                wanted = wanted[now.holds(suffix[wanted])]
                if was:
                    wanted = wanted[~(was.holds(prefix[wanted]) & was.holds(suffix[wanted]))]
                prefix, suffix = prefix[wanted], suffix[wanted]
                _, first, n = np.unique(_named(prefix, suffix), return_index=True, return_counts=True)
                columns = [pa.array(np.full(len(first), length, np.int32)), pa.array(prefix[first].view(np.int64)), pa.array(suffix[first].view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["length", "prefix", "suffix", "n"])

    counted = rows.mapInArrow(run, "length int, prefix long, suffix long, n long")
    return counted.groupBy("length", "prefix", "suffix").agg(F.sum("n").alias("n"))


def _with_keys(counted: DataFrame) -> DataFrame:
    """(key, length, prefix, suffix, n): each phrase with its own hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, suffix = (batch.column(k).to_numpy().view(_U64) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(_named(prefix, suffix).view(np.int64)), *batch.columns], ["key", "length", "prefix", "suffix", "n"])

    return counted.mapInArrow(run, "key long, length int, prefix long, suffix long, n long")


def frequent(rows: DataFrame, words: DataFrame, support: int = SUPPORT, longest: int = LONGEST, sample: int = SAMPLE) -> DataFrame:
    """(key, length, prefix, suffix, n) of all phrases of 2 to ``longest`` words with ``support`` occurrences in (lang, text) ``rows``."""
    mask = mask_of(words.where(F.col("n") >= support).select("key"))
    # The sample proposes, level by level.
    drawn = stage(rows.where(F.pmod(F.xxhash64("lang", "text", F.lit(17)), F.lit(sample)) == 0))
    least = max(2, int(support * LOWERED / sample))
    proposed = []
    for length in range(2, longest):
        told = _with_keys(count_phrases(drawn, mask, shortest=length, longest=length).where(F.col("n") >= least))
        proposed.append(stage(told.select("key")))
        mask = mask_of(proposed[-1], mask)
    # One pass counts them and their border; failures of the border ask for another one.
    found = stage(_with_keys(count_phrases(rows, mask, longest=longest).where(F.col("n") >= support)))
    news = found
    while True:
        missed = news.where(F.col("length") < longest).select("key")
        for keys in proposed:
            missed = missed.join(keys, "key", "left_anti")
        missed = stage(missed)
        if missed.isEmpty():
            return found
        proposed.append(missed)
        old, mask = mask, mask_of(missed, mask)
        news = stage(_with_keys(count_phrases(rows, mask, old, longest=longest).where(F.col("n") >= support)))
        found = found.unionByName(news)


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = SUPPORT, longest: int = LONGEST, cover: int = COVER, sample: int = SAMPLE) -> DataFrame:
    """(lang, phrase, length, a, l, r, n, score) of every phrase that no longer one covers, with its weakest cut.

    ``a``, ``l`` and ``r`` are the occurrences of the phrase and of the two parts of its weakest cut, ``n``
    all words of the language, ``score`` 2,000,000 a / (l + r) as a whole number.
    """
    rows = _read(docs, lang_col, text_col)
    words = stage(count_words(rows))
    found = frequent(rows, words, support, longest, sample)
    level = words.where(F.col("n") >= support).select("key", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails"))
    levels = []
    for length in range(2, longest + 1):
        here = found.where(F.col("length") == length)
        left = level.select(F.col("key").alias("prefix"), "lang", "phrase", F.col("n").alias("head"), "heads")
        right = level.select(F.col("key").alias("suffix"), "last", F.col("n").alias("tail"), "tails")
        level = here.join(left, "prefix").join(right, "suffix").select(
            "key", "prefix", "suffix", "length", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n",
            F.concat("heads", F.array("head")).alias("heads"), F.concat(F.array("tail"), "tails").alias("tails"),
        )
        level = stage(level)
        levels.append(level)
    everything = levels[0]
    for more in levels[1:]:
        everything = everything.unionByName(more)
    # A longer phrase is never more frequent than one inside it, so only phrases with one word more count.
    longer = everything.where("length > 2").select(F.explode(F.array("prefix", "suffix")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("most"))
    kept = everything.join(longer, "key", "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(19,0)") * 100 < F.col("n").cast("decimal(19,0)") * cover))
    cuts = F.transform("heads", lambda l, k: F.struct(k.alias("k"), l.alias("l"), F.get("tails", k).alias("r")))
    told = kept.select("lang", "phrase", "length", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "length", "a", "cut.*")
    told = told.withColumn("score", F.expr("cast(cast(a as decimal(25,0)) * 2000000 div (cast(l as decimal(25,0)) + r) as long)"))
    weakest = told.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    return weakest.join(total, "lang").select("lang", "phrase", "length", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def best(found: DataFrame, first: int) -> DataFrame:
    """The ``first`` phrases of each language by score, occurrences and bytes, with their rank.

    Each language is cut down in ``SHARES`` shares before it comes together.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    shared = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    near = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= first)
    ranked = near.drop("rank", "share").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def digest(spark: SparkSession, sf_dir: str, first: int = 2000) -> DataFrame:
    found = mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return best(found, first)


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), f AS (
  SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS n FROM places, range(1, 5) AS lengths(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, g, n AS a FROM f WHERE k > 1 AND n >= 30
), inner_parts AS (
  SELECT lang, g[i:i + m - 1] AS g, max(a) AS most FROM candidates, range(1, 4) AS starts(i), range(2, 4) AS lengths(m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.g, c.a, j, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * c.a // (x.n + y.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) AS c
  JOIN f AS x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f AS y ON y.lang = c.lang AND y.g = c.g[j + 1:c.k]
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM weakest LEFT JOIN inner_parts USING (lang, g) WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n AS n, score
FROM ranked JOIN total USING (lang) QUALIFY rank <= 2000
"""
