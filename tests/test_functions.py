"""Edge rows of every rule that turns columns into measures and labels."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import bands, codes, measures
from cohortloom.functions.calendar import (
    Snapshot,
    fiscal_quarter,
    month_end,
    month_offset,
    periods,
    previous_due,
    tenure_text,
    whole_months,
    whole_years,
)

SNAP = Snapshot.of("2024-05-31")


def values(spark, schema, rows, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_snapshot_algebra():
    assert Snapshot.before(date(2024, 3, 15)).day == date(2024, 2, 29)
    assert Snapshot.before(date(2024, 1, 1), 2).day == date(2023, 10, 31)
    assert SNAP.month_end(3) == date(2024, 2, 29)
    assert SNAP.month_end(12) == date(2023, 5, 31)
    assert (SNAP.partition, SNAP.compact, SNAP.year) == ("2024-05", "202405", 2024)


def test_month_offset_and_periods(spark):
    days = [date(2024, 5, 31), date(2024, 5, 1), date(2024, 4, 30), date(2023, 6, 1), date(2023, 5, 31), date(2024, 6, 1), date(2023, 1, 1)]
    offset = month_offset(F.col("d"), SNAP)
    got = values(spark, "d date", [(d,) for d in days], offset)
    assert [g[0] for g in got] == [-1, -1, -2, -12, -13, 0, -17]
    conditions = periods(F.year("d"), offset, SNAP)
    rows = values(spark, "d date", [(d,) for d in days], *[c.alias(n) for n, c in conditions.items()])
    table = {n: [r[i] for r in rows] for i, n in enumerate(conditions)}
    assert table["last_mth"] == [True, True, False, False, False, False, False]
    assert table["last_12m"] == [True, True, True, True, False, False, False]
    assert table["last_yr"] == [False, False, False, True, True, False, True]
    assert table["ytd"] == [True, True, True, False, False, False, False]
    assert table["total"] == [True, True, True, True, True, False, True]
    for small, large in (("last_mth", "last_3m"), ("last_3m", "last_6m"), ("last_6m", "last_9m"), ("last_9m", "last_12m")):
        assert all(b or not a for a, b in zip(table[small], table[large]))


def test_dates(spark):
    rows = [(date(2024, 2, 10),), (date(2024, 5, 1),), (date(2024, 9, 30),), (date(2024, 12, 31),), (None,)]
    assert [r[0] for r in values(spark, "d date", rows, fiscal_quarter(F.col("d")))] == ["2023 Q3", "2023 Q4", "2024 Q1", "2024 Q2", None]
    assert [r[0] for r in values(spark, "d date", rows[:2], month_end(F.col("d"), 1))] == [date(2024, 1, 31), date(2024, 4, 30)]
    due = [(date(2024, 3, 31), m) for m in ("01", "03", "06", "12", None, "07")]
    got = values(spark, "d date, m string", due, previous_due(F.col("d"), F.col("m")))
    assert [g[0] for g in got] == [date(2024, 2, 29), date(2023, 12, 31), date(2023, 9, 30), date(2023, 3, 31), None, None]
    spans = [(date(2020, 1, 1), date(2021, 1, 1)), (date(2020, 1, 1), date(2019, 12, 31)), (date(2020, 1, 1), None)]
    got = values(spark, "a date, b date", spans, whole_years(F.col("a"), F.col("b")), whole_months(F.col("a"), F.col("b")))
    assert got == [(1, 12), (-1, 0), (None, None)]
    assert [r[0] for r in values(spark, "m int", [(27,), (0,), (-1,), (None,)], tenure_text(F.col("m")))] == ["2y 3m", "0y 0m", "-1y 11m", None]


@pytest.mark.parametrize("lowest, expected", [(True, ["a", "a", "a", "b", "c", None, None]), (False, [None, "a", "a", "b", "c", None, None])])
def test_band_edges(spark, lowest, expected):
    rows = [(0.0,), (0.5,), (1.0,), (1.5,), (float("inf"),), (-0.1,), (None,)]
    got = values(spark, "x double", rows, bands.band(F.col("x"), [0, 1, 2, codes.INF], ["a", "b", "c"], lowest))
    assert [g[0] for g in got] == expected


def test_band_checks_labels_and_names_intervals(spark):
    with pytest.raises(ValueError):
        bands.band(F.col("x"), [0, 1], ["a", "b"])
    assert values(spark, "x int", [(2,)], bands.band(F.col("x"), [0, 1, 2]))[0][0] == "(1, 2]"


def test_condition_order_and_ties(spark):
    got = values(
        spark, "a double, b double", [(1.0, 1.0), (0.2, 0.5), (None, 0.3), (None, None)],
        bands.argmax_label(["a", "b"]), bands.mark(F.col("a") > 0.1), bands.flag(F.col("a") > F.col("b")),
    )
    assert got == [("a", "*", 0), ("b", "*", 0), ("b", "", 0), (None, "", 0)]
    places = values(spark, "t string", [("Unranked",), ("TOT",), ("FC",), (None,)], bands.ordinal(F.col("t"), codes.TIER_LADDER))
    assert [p[0] for p in places] == [1, 7, 0, 0]


def test_annualised_premium(spark):
    rows = [(100.0, "03", "1"), (100.0, None, "1"), (100.0, "03", "A"), (100.0, "00", "1")]
    got = values(spark, "p double, m string, s string", rows, measures.annualised_premium(F.col("p"), F.col("m"), F.col("s")))
    assert [g[0] for g in got] == [400.0, None, 0.0, None]


def _adjusted(days, mode, single):
    """The rule written out once more, row by row."""
    ape = None if mode is None else 100.0 * 12 / int(mode)
    if single:
        return 0.0 if days is None or days <= 21 else 10.0
    if days is None:
        return ape or 0.0
    if days <= 21:
        return 0.0
    if days >= 365 or mode == "12":
        return ape or 0.0
    step = {"01": 31, "03": 92, "06": 183}.get(mode)
    return 100.0 * (days // step + 1) if step else 0.0


def test_adjusted_premium_grid(spark):
    grid = [(d, m, s) for d in (None, 0, 21, 22, 30, 31, 91, 92, 183, 364, 365, 800) for m in ("01", "03", "06", "12", None) for s in (0, 1)]
    rows = [(d, m, 100.0, None if m is None else 100.0 * 12 / int(m), s) for d, m, s in grid]
    got = values(
        spark, "d int, m string, p double, a double, s int", rows,
        measures.adjusted_premium(F.col("d"), F.col("m"), F.col("p"), F.col("a"), F.col("s")),
    )
    assert [g[0] for g in got] == [_adjusted(*g) for g in grid]


def test_relation_rule(spark):
    cases = {
        (1, 30, "M", "F"): "self", (0, None, "M", "F"): "self", (0, 18, "M", "M"): "child", (0, 40, "M", "M"): "child",
        (0, 41, "M", "M"): "others", (0, -18, "M", "M"): "parent", (0, -17, "M", "F"): "spouse", (0, 17, "M", "M"): "others",
        (0, 0, None, "M"): "spouse", (0, 0, None, None): "others",
    }
    got = values(
        spark, "o int, g int, a string, b string", list(cases), measures.relation(F.col("o"), F.col("g"), F.col("a"), F.col("b"))
    )
    assert [g[0] for g in got] == list(cases.values())


def test_rates_and_vip(spark):
    got = values(spark, "a double, b double", [(1.0, 4.0), (1.0, 0.0), (1.0, None)],
                 measures.ratio_or_one(F.col("a"), F.col("b")), measures.kept_rate(F.col("a"), F.col("b")))
    assert got == [(0.25, 0.75), (1.0, 1.0), (1.0, 1.0)]
    flags = measures.vip_flags(F.col("a"), F.col("n"))
    rows = [(12961.76, 0), (6480.88, 0), (6480.87, 0), (2808.38, 0), (864.12, 1), (864.12, 0), (864.11, 1), (None, 1)]
    got = values(spark, "a double, n int", rows, *flags.values())
    assert got == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_premium_years_and_lapse(spark):
    got = values(
        spark, "s date, d int, l double, p double", [(date(2020, 1, 1), 10, 0.2, 0.5), (date(2000, 1, 1), 10, None, 0.5), (date(2020, 1, 1), 3, None, None)],
        *measures.premium_years(F.col("s"), F.lit(date(2024, 5, 31)), F.col("d")),
        measures.lapse_adjusted(F.lit(100.0), F.col("l"), F.col("p")),
    )
    assert got == [(4, 6, 80.0), (10, 0, 50.0), (3, 0, 100.0)]


def test_channel_margin(spark):
    margins = {f: F.lit(float(i)) for i, f in enumerate(("agency", "direct", "other", "affinity", "banca", "tcb", "sag"), 1)}
    rows = [(None, "01"), (None, "05"), (None, "48"), (None, "10"), (None, "09"), (None, "zz"), ("X", "*"), ("TCB1", "01"), ("SAG1", "10"), ("X", "01")]
    expr = measures.channel_margin(F.col("loc"), F.col("ch"), margins, {"TCB": "tcb", "SAG": "sag"})
    got = [r[0] for r in values(spark, "loc string, ch string", rows, expr)]
    assert got == [1.0, 2.0, 4.0, 5.0, codes.FIXED_MARGIN, 3.0, 1.0, 6.0, 7.0, 3.0]
