"""Connected components of an edge table whose stars may be as large as the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import new_folder, settle

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let batches for Python end at ``most`` bytes, where the session has no bound of its own.

    Spark's bound of 10,000 rows alone would hold gigabytes of long texts or large sets in one batch.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(most))


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there: compressed, and survives lost executors."""
    folder = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star rounds: each hangs neighbours on the smallest node seen,
    so paths halve. A round is grouped minima, summed before the shuffle, and joins that AQE can
    split, so a node with a third of all edges needs no single task. Each round is written to the
    checkpoint folder. Nulls and loops link nothing; an empty table gives an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"), F.col("a") == F.col("b")).toDF("hi", "lo", "loop")
    pairs = settle(pairs.where("hi is not null and lo is not null and not loop").select("hi", "lo").distinct())
    state = None
    while True:
        seen = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.sum(F.xxhash64("lo", "hi") % 1_000_003).alias("s")).first()
        if seen == state or not seen["n"]:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        state = seen
        both = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        lowest = both.groupBy("hi").agg(F.min("lo").alias("low")).select(F.col("hi").alias("hub"), F.least("hi", "low").alias("low"))
        # Larger neighbours of each node move to the smallest node around it.
        large = both.where("lo > hi").join(lowest, F.col("hi") == F.col("hub")).select(F.col("lo").alias("hi"), F.col("low").alias("lo")).distinct()
        # Of each node and its smaller neighbours, all move to the smallest.
        floor = large.groupBy("hi").agg(F.min("lo").alias("low")).withColumnRenamed("hi", "hub")
        small = large.join(floor, F.col("hi") == F.col("hub")).select(F.explode(F.array(F.col("lo"), F.col("hi"))).alias("hi"), F.col("low").alias("lo"))
        pairs = settle(small.where("hi > lo").distinct())
