"""Results over all coverages that are made slice by slice, so that the disk holds what one slice shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cohortloom.session import new_folder, of_slice, slices
from cohortloom.sources.sinks import stage_parts
from cohortloom.sources.star_tables import StarTables

Cut = Callable[[DataFrame], DataFrame]


def whole(df: DataFrame) -> DataFrame:
    return df


def in_slices(t: StarTables, key: str, make: Callable[[Cut], DataFrame]) -> DataFrame:
    """The rows of ``make`` for every slice of ``key``, stored as one table.

    ``make`` gets a function that keeps the rows of a slice. No row of its result may depend on two keys.
    """
    every = slices(t.spark, f"{t.folder}/lineitem.parquet")
    return stage_parts((make(lambda df, i=i: of_slice(df, key, i, every)) for i in range(every)), new_folder(t.spark))
