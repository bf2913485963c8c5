"""Document quality rules with host verdicts, in native expressions only.

Each text is judged by its words; hosts are judged by how many of their documents fail. Host rates
are shrunk towards the corpus with a beta prior whose mean and strength come from the spread of all
host rates (method of moments), so a host with few documents is never condemned by chance. A host
is rejected when its shrunk failure rate is above ``worst`` by two posterior deviations.

Defined cases: a null text has no words and fails. A null host has no verdict, so only its documents' own rules count.
Rows are judged one by one, also where they repeat. Empty tables give empty results. In ``judge``
only the named columns are read; ``keep`` returns the columns of its input as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.graph import stage

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MOST_REPEATED = 20, 30  # words; per cent of words in repeated windows
WORST = 0.5
STRONGEST = 1000.0  # documents that the prior counts as at most


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def _neighbours(values: Column, apart: int) -> Column:
    """Hash of every value with the one ``apart`` places later."""
    n = F.size(values) - apart
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 1 + apart, n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words inside those 8-word windows (given as hashes) that occur twice or more."""

    def places(ranked: Column) -> Column:
        same = lambda e, i: (F.get(ranked, i - 1)["h"] == e["h"]) | (F.get(ranked, i + 1)["h"] == e["h"])
        return F.array_sort(F.filter(F.transform(ranked, lambda e, i: F.when(same(e, i), e["at"])), lambda at: at.isNotNull()))

    def union(starts: Column) -> Column:
        step = lambda a, s: F.struct((a["n"] + F.least(F.lit(8), s + 8 - a["end"])).alias("n"), (s + 8).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ranked, lambda r: union(places(r))))


def features(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))

    def repeated(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        eight = let(hashes, lambda one: let(_neighbours(one, 1), lambda two: let(_neighbours(two, 2), lambda four: _neighbours(four, 4))))
        return F.when(F.size(words) > 8, let(eight, _covered)).otherwise(0)

    def told(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long")).alias("n_dup_lines"),
            repeated(words).cast("long").alias("n_repeat_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), 0), told)


def fails(told: Column) -> Column:
    return (told["n_words"] < MIN_WORDS) | (told["n_repeat_words"] * 100 > told["n_words"] * MOST_REPEATED)


def host_verdicts(judged: DataFrame, worst: float = WORST) -> DataFrame:
    """(host, n, failures, rate, rejected) of (host, base_failed) rows; rate is the shrunk one."""
    hosts = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    sums = hosts.agg(F.sum("n").alias("docs"), F.sum("failures").alias("bad"), F.count("*").alias("hosts"), F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("squares"))
    mean = F.col("bad") / F.col("docs")
    within = mean * (1 - mean)
    # Variance of host rates, less what chance alone gives hosts of these sizes.
    between = F.col("squares") / F.col("docs") - mean * mean - within * F.col("hosts") / F.col("docs")
    strength = F.when(within <= 0, 2.0).when(between * (STRONGEST + 1) <= within, STRONGEST).otherwise(F.greatest(within / between - 1, F.lit(2.0)))
    prior = sums.where("docs > 0").select(mean.alias("mean"), strength.alias("strength"))
    # Two numbers for the whole corpus, as scalar subqueries.
    known = hosts.withColumn("mean", prior.select("mean").scalar()).withColumn("strength", prior.select("strength").scalar())
    rate = (F.col("mean") * F.col("strength") + F.col("failures")) / (F.col("strength") + F.col("n"))
    low = F.col("rate") - 2 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("strength") + F.col("n") + 1))
    return known.withColumn("rate", rate).select("host", "n", "failures", "rate", (low > worst).alias("rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", worst: float = WORST) -> DataFrame:
    """Each row's features, ``base_failed`` and ``kept``."""
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), features(F.col(text_col).cast("string")).alias("told"))
    judged = stage(told.select("doc_id", "host", "told.*", fails(F.col("told")).alias("base_failed")))
    rejected = host_verdicts(judged, worst).where("rejected").select("host", F.lit(True).alias("bad_host"))
    kept = ~F.col("base_failed") & F.col("bad_host").isNull()
    return judged.join(rejected, "host", "left").select(*(c for c in judged.columns if c != "host"), kept.alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", worst: float = WORST) -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host is not rejected, columns as they were."""
    told = features(F.col(text_col).cast("string"))
    judged = docs.select(F.col(host_col).cast("string").alias("host"), told.alias("told")).select("host", fails(F.col("told")).alias("base_failed"))
    name = "rejected host"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    rejected = stage(host_verdicts(judged, worst).where("rejected").select(F.col("host").alias(name)))
    good = docs.where(~let(told, fails))
    return good.join(rejected, F.col(host_col).cast("string") == F.col(f"`{name}`"), "left_anti")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 7], ' ')) AS seen
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows WHERE seen > 1) GROUP BY doc_id
), told AS (
  SELECT w.doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated ON w.doc_id = repeated.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM told
), hosts AS (
  SELECT source AS host, count(*) AS n, count(*) FILTER (base_failed) AS failures FROM judged WHERE source IS NOT NULL GROUP BY source
), sums AS (
  SELECT sum(failures) / sum(n) AS mean, sum(failures * failures / n) / sum(n) - power(sum(failures) / sum(n), 2)
    - sum(failures) / sum(n) * (1 - sum(failures) / sum(n)) * count(*) / sum(n) AS spread FROM hosts
), prior AS (
  SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 2 WHEN spread * 1001 <= mean * (1 - mean) THEN 1000
    ELSE greatest(mean * (1 - mean) / spread - 1, 2) END AS strength FROM sums
), rates AS (
  SELECT host, (mean * strength + failures) / (strength + n) AS rate, strength + n + 1 AS size FROM hosts, prior
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate - 2 * sqrt(rate * (1 - rate) / size) <= 0.5, true) AS kept
FROM judged LEFT JOIN rates ON source = host
"""
