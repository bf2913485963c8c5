"""Counting reports: waterfalls, frequencies, profiles, summaries, control totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.bands import band, decode
from cohortloom.functions.measures import exact_mean, exact_sum
from cohortloom.operators.latest import top_per_key
from cohortloom.operators.ordering import percentiles


def _survivors(conditions: Sequence[Column]) -> list[Column]:
    """For every step: does a row pass this and all earlier conditions?"""
    passed, steps = F.lit(True), []
    for condition in conditions:
        passed = passed & F.coalesce(condition, F.lit(False))
        steps.append(passed)
    return steps


def _zero_filled(counted: DataFrame, steps: int) -> DataFrame:
    """An empty table gives null sums; the group columns keep their nulls."""
    return counted.fillna(0, subset=[f"_left_{i}" for i in range(steps + 1)])


def _step_rows(counted: DataFrame, steps: int, by: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            (F.col(f"_left_{i - 1}") - F.col(f"_left_{i}")).alias("dropped"),
            F.col(f"_left_{i}").alias("remaining"),
        )
        for i in range(1, steps + 1)
    ]
    return counted.select(*by, F.explode(F.array(*rows)).alias("s")).select(*by, "s.step", "s.dropped", "s.remaining")


def waterfall(df: DataFrame, conditions: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows dropped and left after each condition in turn, in one pass."""
    counts = [F.count(F.lit(1)).alias("_left_0")] + [
        F.sum(F.when(step, 1).otherwise(0)).alias(f"_left_{i}")
        for i, step in enumerate(_survivors(conditions), start=1)
    ]
    counted = _zero_filled(df.groupBy(*by).agg(*counts), len(conditions))
    return _step_rows(counted, len(conditions), by)


def entity_waterfall(df: DataFrame, entity: str, conditions: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Distinct entities dropped and left after each condition in turn.

    The steps are nested, so the furthest step an entity reaches tells all of its counts.
    """
    reached = F.lit(0)
    for step in _survivors(conditions):
        reached = reached + F.when(step, 1).otherwise(0)
    furthest = df.where(F.col(entity).isNotNull()).groupBy(*by, entity).agg(F.max(reached).alias("_reached"))
    counts = [
        F.sum(F.when(F.col("_reached") >= i, 1).otherwise(0)).alias(f"_left_{i}") for i in range(len(conditions) + 1)
    ]
    counted = _zero_filled(furthest.groupBy(*by).agg(*counts), len(conditions))
    return _step_rows(counted, len(conditions), by)


def frequency(df: DataFrame, column: str, keep_null: bool = False, name: str = "rows") -> DataFrame:
    """Rows per value."""
    source = df if keep_null else df.where(F.col(column).isNotNull())
    return source.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def breakdown(df: DataFrame, bands: Sequence[str], entity: str, name: str) -> DataFrame:
    """Distinct entities per combination of bands; combinations with a null band are left out."""
    return df.dropna(subset=list(bands)).groupBy(*bands).agg(F.countDistinct(entity).alias(name)).where(F.col(name) > 0)


def breakdowns(df: DataFrame, reports: Mapping[str, Sequence[str]], entity: str, name: str) -> DataFrame:
    """Several ``breakdown`` reports from one reading: (report, every band column, ``name``).

    ``reports`` maps a report to its bands; bands of other reports are null in its rows. Rows are told once
    for each report and grouped together, by grouping sets. Combinations with a null band of their own report,
    or without any entity, are left out.
    """
    columns = list(dict.fromkeys(c for bands in reports.values() for c in bands))
    # The grouping id has a bit for each column, 1 where the set does not have it.
    number = {report: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in bands) for report, bands in reports.items()}
    if len(set(number.values())) < len(number):
        raise ValueError("two reports have the same bands")
    quoted = {c: F.col(f"`{c}`") for c in columns}
    grouped = df.groupingSets([[quoted[c] for c in bands] for bands in reports.values()], *quoted.values()).agg(
        F.countDistinct(entity).alias(name), F.grouping_id(*quoted.values()).alias("_set")
    )
    whole = F.lit(False)
    for report, bands in reports.items():
        filled = F.lit(True)
        for c in bands:
            filled = filled & quoted[c].isNotNull()
        whole = whole | ((F.col("_set") == number[report]) & filled)
    label = decode(F.col("_set"), {n: report for report, n in number.items()})
    return grouped.where(whole & (F.col(name) > 0)).select(label.alias("report"), *quoted.values(), name)


def profile(df: DataFrame, by: Sequence[str], entity: str, means: Mapping[str, str], count_name: str,
            distinct: bool = False) -> DataFrame:
    """Entities and mean features per group; ``means`` maps a column to its output name."""
    averaged = [exact_mean(F.col(f"`{c}`")).alias(name) for c, name in means.items()]
    if not distinct:
        return df.groupBy(*by).agg(F.count(entity).alias(count_name), *averaged)
    # A distinct count next to means would copy every row; sums per entity need no copies.
    sums = [exact_sum(F.col(f"`{c}`")).alias(f"_sum_{i}") for i, c in enumerate(means)]
    known = [F.count(F.col(f"`{c}`")).alias(f"_known_{i}") for i, c in enumerate(means)]
    per_entity = df.groupBy(*by, entity).agg(*sums, *known)
    return per_entity.groupBy(*by).agg(
        F.count(entity).alias(count_name),
        *[
            F.try_divide(exact_sum(F.col(f"_sum_{i}")), F.sum(f"_known_{i}")).alias(name)
            for i, name in enumerate(means.values())
        ],
    )


def summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, spread and quartiles, one row per metric (and group)."""
    by = list(by)
    quartiles = percentiles(df, columns, [0.25, 0.5, 0.75], by).withColumnsRenamed({"p50": "median"})
    tall = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        by, list(columns), "metric", "metric_value"
    )
    moments = tall.groupBy(*by, "metric").agg(
        F.count("metric_value").alias("count"),
        exact_mean(F.col("metric_value")).alias("mean"),
        F.stddev_samp("metric_value").alias("stddev"),
        F.min("metric_value").alias("min"),
        F.max("metric_value").alias("max"),
    )
    return moments.join(quartiles, [*by, "metric"], "left")


def control_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(c).alias(c) for c in columns])


def control_counts(df: DataFrame, entity: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities"))


def composition(df: DataFrame, edges: Mapping[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """Rows per profiling band of every column, nulls and values outside included, in one pass."""
    banded = [F.struct(
        F.lit(c).alias("metric"), band(F.col(f"`{c}`"), limits, include_lowest=False).alias("band")
    ) for c, limits in edges.items()]
    tall = df.select(*by, F.explode(F.array(*banded)).alias("b")).select(*by, "b.metric", "b.band")
    return tall.groupBy(*by, "metric", "band").agg(F.count(F.lit(1)).alias("rows"))


def small_to_others(df: DataFrame, column: str, at_least: int, other: str = "Others", name: str | None = None) -> DataFrame:
    """Replace categories with fewer than ``at_least`` rows."""
    name = name or f"{column}_grouped"
    kept = (
        df.groupBy(F.col(column).alias("_category")).agg(F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") >= at_least) & F.col("_category").isNotNull())
        .select("_category")
    )
    joined = df.join(kept, df[column] == kept["_category"], "left")
    label = F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.coalesce("_category", F.lit(other)))
    return joined.withColumn(name, label).drop("_category")


def top_categories(df: DataFrame, column: str, n: int) -> list:
    """The ``n`` most frequent values, the lower value first on a tie; n values reach the driver."""
    counts = frequency(df, column, name="_rows")
    return [row[column] for row in counts.orderBy(F.desc("_rows"), column).limit(n).collect()]


def rest_to_other(df: DataFrame, column: str, n: int, other: str = "Other", name: str | None = None) -> DataFrame:
    """Keep the ``n`` most frequent categories and replace the rest."""
    kept = F.col(column).isin(*top_categories(df, column, n))
    return df.withColumn(name or f"{column}_grouped", F.when(kept, F.col(column)).otherwise(F.lit(other)))


def rest_to_other_by(df: DataFrame, by: Sequence[str], column: str, n: int, other: str = "Other", name: str | None = None) -> DataFrame:
    """Keep the ``n`` most frequent categories of every group and replace the rest; a null stays null.

    The lower value is kept on a tie. Null groups are groups like others.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_rows"))
    kept = top_per_key(counts, list(by), [F.desc("_rows"), F.col(column)], n).select(*[F.col(c).alias(f"_key_{c}") for c in [*by, column]])
    same = [df[c].eqNullSafe(kept[f"_key_{c}"]) for c in [*by, column]]
    label = F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.coalesce(f"_key_{column}", F.lit(other)))
    return df.join(kept, same, "left").withColumn(name or f"{column}_grouped", label).drop(*[f"_key_{c}" for c in [*by, column]])
