"""Where queries and their SQL equivalents are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.sources.star_tables import StarTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the star tables under ``name``."""

    def add(build: Callable[[StarTables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(StarTables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def tidy(df: DataFrame, digits: int = 6, cents: tuple[str, ...] = ()) -> DataFrame:
    """Rounded numbers, dates as text and whole numbers as long, so that results compare exactly.

    Amounts that went through a currency rate have no last digit; those in ``cents`` are cut to 2.
    """
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            places = 2 if field.name in cents else digits
            column = F.round(column.cast("double"), places) + F.lit(0.0)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType)):
            column = column.cast("string")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("long")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def tidy_mean(df: DataFrame, digits: int = 6) -> DataFrame:
    """``tidy`` of numbers rounded to five digits more before, as ``sql.cut`` does.

    The last bits of a mean of doubles depend on the order of its rows, and would decide about a five in the first digit to go.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return tidy(df.withColumns({c: F.round(F.col(f"`{c}`"), digits + 5) for c in doubles}), digits)
