"""Writing marts, stages and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from cohortloom.session import stored_whole


def write_mart(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("image_date",)) -> None:
    """Replace only the partitions that ``df`` holds and leave the others as they are."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_report(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A CSV report with a header. ``one_file`` is for aggregated reports only."""
    target = df.coalesce(1) if one_file else df
    target.write.mode("overwrite").option("header", True).csv(path)


def write_single(df: DataFrame, path: str) -> None:
    """One parquet file, for small outputs only: a single task writes all rows."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Store and continue from the stored rows, so later steps do not repeat the work."""
    return stage_parts([df], path)


def stage_parts(parts: Iterable[DataFrame], path: str) -> DataFrame:
    """``stage`` for a table that is made part after part; what a part shuffles leaves the disk before the next one.

    There is one part at least, and all have the same columns.
    """
    spark, mode = None, "overwrite"
    for part in parts:
        spark = part.sparkSession
        with stored_whole(spark):
            part.write.mode(mode).option("compression", "zstd").parquet(path)
        mode = "append"
    return spark.read.parquet(path)
