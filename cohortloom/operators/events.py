"""Registration and login features from hit logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_and_last_login(hits: DataFrame, user: str, at: str, day: Column) -> DataFrame:
    """First hit (registration) and last later hit per user, of the hits up to the end of ``day``.

    The first hit is never a login. Two hits mean that one of them is a later one, and the largest
    is it. Both come from plain aggregates, so a user with very many hits needs no sort.
    """
    known = hits.where(F.col(user).isNotNull() & (F.col(at) < F.date_add(day, 1)))
    return known.groupBy(user).agg(
        F.min(at).alias("registered_at"),
        F.when(F.count(at) >= 2, F.max(at)).alias("last_login_at"),
        F.count(F.lit(1)).alias("hits"),
    )


def usable_hits(hits: DataFrame, excluded: str, source: str, visitor_parts: Sequence[str],
                bad_sources: Sequence[str]) -> DataFrame:
    """Hits that count: not excluded, from a page, with a known visitor."""
    return hits.where(
        (F.col(excluded) == 0) & ~F.col(source).isin(*bad_sources) & F.concat(*visitor_parts).isNotNull()
    )


def days_since(day: Column, snapshot: Column) -> Column:
    return F.datediff(snapshot, day)
