"""Month-end calendar: snapshot arithmetic and rolling-period conditions."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions.bands import first_match

DAYS_PER_YEAR = 365.25


@dataclass(frozen=True)
class Snapshot:
    """The month-end a run describes. Every result is a function of this date, never of today."""

    day: date

    @classmethod
    def of(cls, text: str) -> "Snapshot":
        return cls(date.fromisoformat(text))

    @classmethod
    def before(cls, today: date, months_back: int = 0) -> "Snapshot":
        """Last month-end before ``today``, or the one ``months_back`` earlier."""
        return cls(_month_end(today.year * 12 + today.month - 2 - months_back))

    def month_end(self, months_back: int) -> date:
        return _month_end(self.index - 1 - months_back)

    @property
    def index(self) -> int:
        return self.day.year * 12 + self.day.month

    @property
    def year(self) -> int:
        return self.day.year

    @property
    def partition(self) -> str:
        return self.day.strftime("%Y-%m")

    @property
    def compact(self) -> str:
        return self.day.strftime("%Y%m")

    def column(self) -> Column:
        return F.lit(self.day)

    def __str__(self) -> str:
        return self.day.isoformat()


def _month_end(zero_based_month: int) -> date:
    year, month = divmod(zero_based_month, 12)
    return date(year, month + 1, calendar.monthrange(year, month + 1)[1])


def month_end(day: Column, months_back: int = 0) -> Column:
    return F.last_day(F.add_months(day, -months_back))


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def month_offset(day: Column, snapshot: Snapshot) -> Column:
    """-1 for the snapshot month itself, -2 for the month before, and so on."""
    return month_index(day) - F.lit(snapshot.index + 1)


def periods(year: Column, offset: Column, snapshot: Snapshot) -> dict[str, Column]:
    """The eight reporting periods as conditions on a date's year and month offset."""
    rolling = {f"last_{n}m": offset.between(-n, -1) for n in (3, 6, 9, 12)}
    return {
        "last_yr": year == snapshot.year - 1,
        "last_mth": offset == -1,
        **rolling,
        "ytd": (year == snapshot.year) & (offset <= -1),
        "total": offset <= -1,
    }


def fiscal_quarter(day: Column) -> Column:
    """Two calendar quarters back, as ``YYYY Qn`` (a year that starts in July)."""
    quarter, year = F.quarter(day), F.year(day)
    return F.concat(
        F.when(quarter <= 2, year - 1).otherwise(year).cast("string"),
        F.lit(" Q"),
        F.when(quarter <= 2, quarter + 2).otherwise(quarter - 2).cast("string"),
    )


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(DAYS_PER_YEAR)


def whole_years(start: Column, end: Column) -> Column:
    return F.floor(years_between(start, end)).cast("int")


def whole_months(start: Column, end: Column) -> Column:
    """Months from ``start`` to ``end``, cut towards zero."""
    return F.months_between(end, start).cast("int")


def tenure_text(months: Column) -> Column:
    """``27`` becomes ``2y 3m``."""
    return F.concat(
        F.floor(months / 12).cast("string"), F.lit("y "), F.pmod(months, F.lit(12)).cast("string"), F.lit("m")
    )


def previous_due(paid_to: Column, mode: Column) -> Column:
    """The due date one payment period before ``paid_to``; null for an unknown mode."""
    return F.add_months(paid_to, first_match([(mode == f"{step:02d}", -step) for step in (1, 3, 6, 12)]))
