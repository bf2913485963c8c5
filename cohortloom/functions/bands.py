"""Labels from numbers and conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(value: Column, edges: Sequence[float], labels: Sequence[str] | None = None,
         include_lowest: bool = True) -> Column:
    """Right-closed bands ``(e0, e1], (e1, e2] ...``; null outside the edges.

    Without labels the interval itself is the label.
    """
    if labels is None:
        labels = [f"({low}, {high}]" for low, high in zip(edges, edges[1:])]
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    inside = value >= F.lit(edges[0]) if include_lowest else value > F.lit(edges[0])
    ladder = [(inside & (value <= F.lit(high)), label) for high, label in zip(edges[1:], labels)]
    return first_match(ladder)


def first_match(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first true condition; a null condition counts as false."""
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def decode(code: Column, names: Mapping, default: object = None) -> Column:
    return first_match([(code == F.lit(key), name) for key, name in names.items()], default)


def ordinal(label: Column, ladder: Sequence[str], unknown: int = 0) -> Column:
    """Position on the ladder counted from 1, else ``unknown``."""
    return first_match([(label == step, place) for place, step in enumerate(ladder, start=1)], unknown)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(condition, 1).otherwise(0)


def argmax_label(columns: Sequence[str]) -> Column:
    """Name of the column with the largest value; the first one listed wins a tie, all null gives null."""
    best = F.greatest(*columns)
    return first_match([(F.col(name) == best, name) for name in columns])


def mark(condition: Column) -> Column:
    """A star where the condition holds, else an empty text."""
    return F.when(condition, "*").otherwise("")
