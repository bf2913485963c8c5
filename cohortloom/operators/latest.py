"""First, latest and n-th rows per key.

Each ``row_number() <= k`` filter is planned by Spark with a group limit before the shuffle, so
a key that holds a large share of the rows sends at most k rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, by: Sequence[str], order_by: Sequence[Column], k: int, place: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key in the given order; ``place`` keeps the row number."""
    window = Window.partitionBy(*by).orderBy(*order_by)
    name = place or "_place"
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return kept if place else kept.drop(name)


def first_per_key(df: DataFrame, by: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    return top_per_key(df, by, order_by, 1)


def nth_as_columns(df: DataFrame, by: str, order_by: Sequence[Column], values: Sequence[str], n: int = 2) -> DataFrame:
    """The first ``n`` rows per key side by side: ``<value>_1``, ``<value>_2`` ..."""
    placed = top_per_key(df, [by], order_by, n, "_place").select(by, "_place", *values)
    wide = placed.groupBy(by).pivot("_place", list(range(1, n + 1))).agg(
        *[F.first(c).alias(c) for c in values]
    )
    # With a single value the pivot names its columns by the place alone.
    named = {(i, c): f"{i}_{c}" if len(values) > 1 else f"{i}" for i in range(1, n + 1) for c in values}
    return wide.select(by, *[F.col(f"`{name}`").alias(f"{c}_{i}") for (i, c), name in named.items()])


def top_list_per_key(df: DataFrame, by: str, order_by: Sequence[Column], item: str, k: int, name: str) -> DataFrame:
    """The first ``k`` items per key as a sorted array without duplicates, never more than k long."""
    return (
        top_per_key(df, [by], order_by, k)
        .groupBy(by)
        .agg(F.sort_array(F.collect_set(item)).alias(name))
    )


def latest_value(value: str, *order: str) -> Column:
    """Aggregate: ``value`` of the row that is last by ``order``."""
    return F.max_by(F.col(value), F.struct(*order))


def running_min(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """Smallest ``value`` so far in ``order`` within each key; rows with equal order share it.

    Rows are first reduced to one per key and order value, so the window of a very large key
    holds its distinct dates and not its rows.
    """
    so_far = Window.partitionBy("_by").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = (
        df.groupBy(F.col(by).alias("_by"), F.col(order).alias("_order"))
        .agg(F.min(value).alias("_least"))
        .select("_by", "_order", F.min("_least").over(so_far).alias(name))
    )
    same = df[by].eqNullSafe(steps["_by"]) & df[order].eqNullSafe(steps["_order"])
    return df.join(steps, same, "left").drop("_by", "_order")
