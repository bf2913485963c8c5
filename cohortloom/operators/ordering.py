"""Exact order-based results without pulling all rows into one task.

A window without PARTITION BY sends every row to a single task. Here the rows are range
partitioned on the sort key instead, each partition is numbered on its own, and the partition
totals (one row per partition) are added up to give every partition its starting point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import settle

_PART = "_part"


def running_total(df: DataFrame, order_by: Sequence[Column], weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rows_before`` (weight of all earlier rows) and ``rows_all`` (weight of the group).

    ``order_by`` must identify a row within its group. The range-partitioned rows are settled
    once, because the offsets are only right for the partition a row was counted in.
    """
    by = list(by)
    ranged = df.select("*", weight.cast("long").alias("_weight"))
    ranged = ranged.repartitionByRange(*by, *order_by).withColumn(_PART, F.spark_partition_id())
    ranged = settle(ranged)
    earlier = (Window.unboundedPreceding, -1)
    totals = ranged.groupBy(_PART, *by).agg(F.sum("_weight").alias("_part_rows"))
    # At most one row per partition and group meets in each window partition here.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    offsets = totals.select(
        _PART, *by,
        F.coalesce(F.sum("_part_rows").over(group.orderBy(_PART).rowsBetween(*earlier)), F.lit(0)).alias("_offset"),
        F.sum("_part_rows").over(group).alias("rows_all"),
    )
    local = Window.partitionBy(_PART, *by).orderBy(*order_by).rowsBetween(*earlier)
    numbered = ranged.withColumn("_local", F.coalesce(F.sum("_weight").over(local), F.lit(0)))
    if not by:
        # One row per partition, whatever the number of rows.
        offsets = F.broadcast(offsets)
    keys = [numbered[_PART] == offsets[_PART]] + [numbered[c].eqNullSafe(offsets[c]) for c in by]
    return numbered.join(offsets, keys).select(
        *[numbered[c] for c in df.columns],
        (F.col("_offset") + F.col("_local")).alias("rows_before"),
        "rows_all",
    )


def value_positions(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value (and group) with its count and the rows before it.

    Equal values are counted before the shuffle, so a value that fills a third of the table
    is still one row here.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("rows_equal"))
    return running_total(counted, [F.col(value)], F.col("rows_equal"), by)


def bucket_bounds(df: DataFrame, value: str, key: str, buckets: int) -> list[tuple]:
    """The last ``(value, key)`` of every bucket but the final one, largest value first."""
    order = [F.col(value).desc(), F.col(key)]
    placed = running_total(df.select(value, key), order, F.lit(1))
    position, every = F.col("rows_before") + 1, F.col("rows_all")
    size, longer = F.floor(every / buckets), every % buckets
    edges = [
        F.when(every > F.lit(b), size * b + F.least(longer, F.lit(b))) for b in range(1, buckets)
    ]
    # No more rows than buckets can match.
    bounds = placed.where(position.isin(*edges)).orderBy("rows_before").collect()
    return [(row[value], row[key]) for row in bounds]


def ntile_desc(df: DataFrame, value: str, key: str, buckets: int, name: str = "decile") -> DataFrame:
    """SQL ``ntile(buckets) over (order by value desc, key)`` as a plain column on ``df``.

    Only the value and the key are sorted. The wide rows are never shuffled: each compares
    itself with the bucket bounds. ``df`` must give the same values when read again, so pass a
    stored mart or a rounded measure. ``key`` must be unique and not null.
    """
    v, k = F.col(value), F.col(key)
    bucket = F.lit(1)
    for bound_value, bound_key in bucket_bounds(df, value, key, buckets):
        same = v.eqNullSafe(F.lit(bound_value)) & (k > F.lit(bound_key))
        after = same if bound_value is None else (v < F.lit(bound_value)) | v.isNull() | same
        bucket = bucket + F.when(after, 1).otherwise(0)
    return df.withColumn(name, bucket)


def average_rank_desc(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Rank from the largest value down; ties share their mean rank, cut to a whole number.

    Ranks are looked up by value: ``df`` must give the same values when read again, so pass a
    stored or rounded measure.
    """
    placed = value_positions(df, value)
    first = F.col("rows_all") - F.col("rows_before") - F.col("rows_equal") + 1
    last = F.col("rows_all") - F.col("rows_before")
    ranks = placed.select(F.col(value).alias("_value"), F.floor((first + last) / 2).cast("int").alias(name))
    return df.join(ranks, df[value] == ranks["_value"], "left").drop("_value")


def percentiles(df: DataFrame, values: Sequence[str], points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per metric (and group).

    Columns ``metric`` and ``p25``, ``p50`` ... for the asked points; nulls are left out.
    """
    by = list(by)
    tall = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in values]).unpivot(
        by, list(values), "metric", "metric_value"
    )
    placed = value_positions(tall, "metric_value", [*by, "metric"])
    first, past = F.col("rows_before"), F.col("rows_before") + F.col("rows_equal")
    picks = []
    for point in points:
        at = F.lit(float(point)) * (F.col("rows_all") - 1)
        low, high = F.floor(at), F.ceil(at)
        label = percentile_name(point)
        picks += [
            F.max(F.when((first <= low) & (low < past), F.col("metric_value"))).alias(f"_low_{label}"),
            F.max(F.when((first <= high) & (high < past), F.col("metric_value"))).alias(f"_high_{label}"),
        ]
    found = placed.groupBy(*by, "metric").agg(F.max("rows_all").alias("_n"), *picks)
    results = []
    for point in points:
        label = percentile_name(point)
        at = F.lit(float(point)) * (F.col("_n") - 1)
        low, high = F.col(f"_low_{label}"), F.col(f"_high_{label}")
        results.append((low + (high - low) * (at - F.floor(at))).alias(label))
    return found.select(*by, "metric", *results)


def percentile_name(point: float) -> str:
    return f"p{point * 100:g}".replace(".", "_")
