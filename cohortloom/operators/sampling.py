"""Repeatable samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def sample_by_key(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows whose key falls into the sampled share of a seeded hash; a null key is never sampled.

    The choice depends on the key and the seed alone, by the first 32 bits of the md5 of ``key:seed``, so any
    engine draws the same rows. ``DataFrame.sample`` depends on the order of rows within partitions, so a
    recomputed partition could return other rows.
    """
    if fraction >= 1:
        return df.where(F.col(key).isNotNull())
    return df.where(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8) < _bound(fraction)).where(F.col(key).isNotNull())


def _bound(fraction: float) -> str:
    """The first value, in eight hexadecimal digits, that is not sampled."""
    return f"{max(int(fraction * 2**32), 0):08x}"


def sample_sql(key: str, fraction: float, seed: int) -> str:
    """The condition of ``sample_by_key`` as plain SQL."""
    return f"({key} is not null and substr(md5(cast({key} as varchar) || ':{seed}'), 1, 8) < '{_bound(fraction)}')"
