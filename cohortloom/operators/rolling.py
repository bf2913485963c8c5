"""Rolling-period KPIs: every period of every measure from one pass over the mart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PERIODS = "_periods"


@dataclass(frozen=True)
class Measure:
    """An SQL value summed per period over the rows where the SQL condition ``only`` holds.

    ``names`` gives the output column per period; periods without a name are left out.
    """

    value: str
    names: Mapping[str, str]
    only: str = "true"


@dataclass(frozen=True)
class Distinct:
    """Distinct non-null values of an SQL expression per period over the rows where ``only`` holds."""

    entity: str
    names: Mapping[str, str]
    only: str = "true"


def _with_periods(df: DataFrame, when: Mapping[str, Column], used: Sequence[Measure | Distinct]) -> tuple[DataFrame, dict[str, int]]:
    """The periods of a row as the bits of one number, and the bit of each period that is used."""
    needed = [period for period in when if any(period in entry.names for entry in used)]
    bit = {period: 1 << place for place, period in enumerate(needed)}
    mask = F.lit(0)
    for period in needed:
        mask = mask + F.when(when[period], bit[period]).otherwise(0)
    return df.withColumn(_PERIODS, mask), bit


def period_sums(df: DataFrame, by: str, when: Mapping[str, Column], measures: Sequence[Measure]) -> DataFrame:
    """One row per key with one sum per measure and period; nothing to sum gives 0."""
    return period_kpis(df, by, when, measures, [])


def period_distincts(df: DataFrame, by: str, when: Mapping[str, Column], counts: Sequence[Distinct]) -> DataFrame:
    """One row per key with one distinct count per entity and period."""
    return period_kpis(df, by, when, [], counts)


def period_kpis(df: DataFrame, by: str, when: Mapping[str, Column], measures: Sequence[Measure], counts: Sequence[Distinct]) -> DataFrame:
    """One row per key with a sum per measure and period, and a distinct count per entity and period.

    All come from one tree of two aggregations over one reading of ``df``. A row is told as a few records.
    The record of the amounts is grouped by (key, periods of the row): a row's periods are one number with
    few values, so each amount is added once, not once for each period. The records of the entities are
    grouped by (key, entity), and their period bits are or-ed together. Both groupings are the same one,
    before and after the shuffle, and what it leaves is added up per key: sums over the bits of the
    periods, counts over the bits of the entities. Spark's own plan for many conditional distinct counts
    would copy each row once per count; here counts of the same entity share a record.

    Amounts are added as decimals: a stage that is computed again gives the very same sums.
    """
    marked, bit = _with_periods(df, when, [*measures, *counts])
    width = max(len(bit), 1)
    amounts = [f"cast(if({m.only}, {m.value}, null) as decimal(28,8))" for m in measures]
    none = "".join(f", 'v{i}', cast(null as decimal(28,8))" for i in range(len(measures)))
    entries, totals = [], []
    if measures:
        told = "".join(f", 'v{i}', {text}" for i, text in enumerate(amounts))
        entries.append(f"named_struct('slot', 0, 'number', bigint({_PERIODS}), 'text', string(null), 'mask', 0L{told})")
        totals += [
            F.expr(f"coalesce(double(sum(if(slot = 0 and number & {bit[period]} > 0, v{i}, null))), 0.0D)").alias(name)
            for i, m in enumerate(measures) for period, name in m.names.items()
        ]
    for entity, shared in _by_entity(counts, 62 // width):
        masks = []
        for place, count in enumerate(shared):
            wanted = sum(bit[period] for period in count.names)
            masks.append(f"shiftleft(bigint(if({count.only}, {_PERIODS} & {wanted}, 0)), {place * width})")
            totals += [
                F.expr(f"count_if(slot = {len(entries)} and mask & {bit[period] << place * width}L > 0)").alias(name)
                for period, name in count.names.items()
            ]
        whole = isinstance(marked.selectExpr(f"{entity} as e").schema["e"].dataType, T.IntegralType)
        number, text = (f"bigint({entity})", "string(null)") if whole else ("bigint(null)", f"string({entity})")
        entries.append(f"""named_struct('slot', {len(entries)}, 'number', {number}, 'text', {text},
            'mask', if(({entity}) is null, 0L, {" | ".join(masks)}){none})""")
    records = marked.selectExpr(by, f"inline(array({', '.join(entries)}))")
    # An entity outside all periods is like none.
    unused = f"slot >= {1 if measures else 0} and mask = 0"
    seen = (
        records.withColumns({c: F.expr(f"if({unused}, null, {c})") for c in ("number", "text")})
        .groupBy(by, "slot", "number", "text")
        .agg(F.bit_or("mask").alias("mask"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(measures))])
    )
    return seen.groupBy(by).agg(*totals)


def _by_entity(counts: Sequence[Distinct], most: int) -> list[tuple[str, list[Distinct]]]:
    """Counts of the same entity together, as many as fit into the bits of one number."""
    groups: dict[str, list[Distinct]] = {}
    for count in counts:
        groups.setdefault(count.entity, []).append(count)
    return [(entity, shared[i:i + most]) for entity, shared in groups.items() for i in range(0, len(shared), most)]


def same_names(periods: Sequence[str], suffix: str, ytd: str | None = None, total: str | None = None) -> dict[str, str]:
    """``last_3m`` -> ``last_3m_<suffix>``; year-to-date and total carry their own names."""
    names = {period: f"{period}_{suffix}" for period in periods}
    if ytd:
        names["ytd"] = ytd
    if total:
        names["total"] = total
    return names
