"""From raw documents to token ids: the training-data operators in a row.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept and returns
the documents that go on; all but the last return the columns of ``documents``. Every stage is written
as Parquet in the shared folder and read again.

Near copies and benchmark passages are judged row by row, under a key of the id and the text, so that
no row goes for what another row of its id holds.

Defined cases: documents without an id are judged like the others; a group of near copies keeps one of
them besides its smallest id. Rows that repeat an id with other texts stay, each judged by its own text; where several
rows of a group share its smallest id, one of them stays, and so does one of rows with the same id and text. A null
text fails the quality rules. Other columns, whatever their names, come out as they went in. Texts of any length are
taken whole. Empty tables go through as empty tables. Row keys are 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm import bpe, decontam, jaccard, pii, quality
from cohortloom.llm.graph import stage

WORDS, SHARE = 5, Fraction(4, 5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and come from no rejected host."""
    return quality.keep(docs)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer where ``docs`` has a column of that name in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row that only rows of the same id and text share, and the key's name."""
    key = _free(docs, "row key")
    return docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")), key


def _without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is none of those in the one column of ``gone``."""
    name = _free(keyed, "gone key")
    return keyed.join(gone.toDF(name), F.col(f"`{key}`") == F.col(f"`{name}`"), "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, and one of those without an id."""
    keyed, key = _keyed(docs)
    slim = keyed.select("doc_id", "text", F.col(f"`{key}`").alias("key"))
    found = jaccard.classes(slim.select("key", "text"), id_col="key", words=WORDS, share=SHARE)
    found = stage(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct())
    # A group of several rows has one that is not named like the group.
    several = found.where("key <> group").select("group").distinct()
    member = stage(slim.select("key", "doc_id").join(found.join(several, "group", "left_semi"), "key").distinct())
    first = member.groupBy("group").agg(
        F.min_by("key", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("named"), F.min(F.when(F.col("doc_id").isNull(), F.col("key"))).alias("unnamed")
    )
    kept = F.when(F.col("doc_id").isNull(), F.col("unnamed")).otherwise(F.col("named"))
    left = _without(keyed, key, stage(member.join(first, "group").where(F.col("key") != kept).select("key")))
    # Rows of the same id and text: one stays.
    repeated = stage(left.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if repeated.isEmpty():
        return left.select(*[f"`{c}`" for c in docs.columns])
    again, place = _free(left, "again key"), _free(left, "a place")
    one = Window.partitionBy(f"`{key}`").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    same = left.join(repeated.toDF(again), F.col(f"`{key}`") == F.col(f"`{again}`"), "left_semi")
    once = same.withColumn(place, F.row_number().over(one)).where(F.col(f"`{place}`") == 1)
    columns = [f"`{c}`" for c in docs.columns]
    return _without(left, key, repeated).select(*columns).unionByName(once.select(*columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, key = _keyed(docs)
    found = decontam.decontaminate(keyed.select(F.col(f"`{key}`").alias("key"), "text"), items, id_col="key")
    gone = stage(found.where("contaminated").select("doc_id").distinct())
    return _without(keyed, key, gone).select(*[f"`{c}`" for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ids.select("doc_id", "lang", "source", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules), ("near_copies", near_copies), ("decontamination", decontamination),
    ("personal_data", personal_data), ("byte_pairs", byte_pairs),
]
# The Jaccard join and the token ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
