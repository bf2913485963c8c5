"""Reports that share one reading, against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortloom.functions.calendar import Snapshot
from cohortloom.operators import reports
from cohortloom.plans import activation


def test_breakdowns_count_entities_of_every_report_exactly(spark):
    chance = random.Random(8)
    rows = [(chance.choice([*range(40), None]), *(chance.choice(["x", "y", None]) for _ in range(3))) for _ in range(600)]
    df = spark.createDataFrame(rows, "e int, a string, `b%` string, c string")
    wanted = {"one": ("a", "b%"), "two": ("c",), "three": ("b%", "c", "a")}
    got = reports.breakdowns(df, wanted, "e", "n").collect()
    at, want = {"a": 1, "b%": 2, "c": 3}, {}
    for report, bands in wanted.items():
        for r in rows:
            key = tuple(r[at[c]] if c in bands else None for c in at)
            if r[0] is not None and all(r[at[c]] is not None for c in bands):
                want.setdefault((report, *key), set()).add(r[0])
    assert {tuple(r)[:4]: r["n"] for r in got} == {k: len(v) for k, v in want.items()}
    for report, bands in wanted.items():
        alone = {tuple(r)[:-1]: r["n"] for r in reports.breakdown(df, [f"{c}" for c in bands], "e", "n").collect()}
        assert sorted(alone.values()) == sorted(r["n"] for r in got if r["report"] == report)
    assert reports.breakdowns(df.limit(0), wanted, "e", "n").count() == 0
    with pytest.raises(ValueError):
        reports.breakdowns(df, {"one": ("a", "c"), "two": ("c", "a")}, "e", "n")


def test_breakdowns_read_the_table_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = reports.breakdowns(df, {"one": ("o_orderstatus",), "two": ("o_orderpriority",)}, "o_custkey", "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1 and "Expand" in plan


def test_rest_to_other_within_groups(spark):
    rows = [(g, c) for g in (1, 2, None) for c, n in (("p", 4), ("q", 3), ("r", 3), ("s", 1), (None, 2)) for _ in range(n if g != 2 else 8 - n)]
    got = reports.rest_to_other_by(spark.createDataFrame(rows, "g int, c string"), ["g"], "c", 2).groupBy("g", "c_grouped").agg(F.count("*").alias("n")).collect()
    assert Counter({(r["g"], r["c_grouped"]): r["n"] for r in got}) == {
        (1, "p"): 4, (1, "q"): 3, (1, "Other"): 4, (1, None): 2, (None, "p"): 4, (None, "q"): 3, (None, "Other"): 4, (None, None): 2,
        (2, "s"): 7, (2, "q"): 5, (2, "Other"): 9, (2, None): 6,
    }


def test_riders_count_up_to_the_snapshot(spark):
    lines = spark.createDataFrame([(1, "R", "2020-01-01"), (1, "R", "2020-03-01"), (1, "B", "2020-01-01"), (2, "R", "2020-01-02"), (2, "R", None), (9, "R", "2020-01-01")], "pol_num int, cvg_typ string, cvg_eff_dt string")
    policies = spark.createDataFrame([(1, 7, "2020-01-01"), (2, 7, "2020-01-01"), (9, 8, "2020-05-01")], "pol_num int, po_num int, pol_eff_dt string")
    lines, policies = lines.withColumn("cvg_eff_dt", F.to_date("cvg_eff_dt")), policies.withColumn("pol_eff_dt", F.to_date("pol_eff_dt"))
    assert [tuple(r) for r in activation.rider_counts(lines, policies, Snapshot.of("2020-02-29")).collect()] == [(7, 2)]
