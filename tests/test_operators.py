"""Operators against brute force on small tables with ties, nulls and one very large key."""

import random
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cleaning, events, latest, lookups, reports, rolling
from cohortloom.operators.ordering import average_rank_desc, ntile_desc, percentiles, running_total
from cohortloom.operators.sampling import sample_by_key


def _sql_ntile(n, buckets):
    size, longer = divmod(n, buckets)
    out = []
    for b in range(buckets):
        out += [b + 1] * (size + (1 if b < longer else 0))
    return out


@pytest.mark.parametrize("n, buckets, distinct", [(0, 10, 5), (3, 10, 5), (10, 10, 1), (997, 10, 4), (500, 7, 400)])
def test_ntile_matches_sql(spark, n, buckets, distinct):
    rng = random.Random(n)
    rows = [(i, None if rng.random() < 0.05 else float(rng.randrange(distinct))) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(6)
    got = {r["k"]: r["decile"] for r in ntile_desc(df, "v", "k", buckets).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: b for r, b in zip(order, _sql_ntile(n, buckets))}


def test_running_total_with_groups(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), i, rng.randrange(1, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k long, w long")
    got = running_total(df, [F.col("k")], F.col("w"), ["g"]).collect()
    seen, totals = defaultdict(int), defaultdict(int)
    for g, _, w in rows:
        totals[g] += w
    expected = {}
    for g, k, w in sorted(rows, key=lambda r: r[1]):
        expected[k] = (seen[g], totals[g])
        seen[g] += w
    assert {r["k"]: (r["rows_before"], r["rows_all"]) for r in got} == expected


def test_average_rank_matches_pandas(spark):
    rng = random.Random(1)
    rows = [(i, 0.0 if i % 3 == 0 else float(rng.randrange(20))) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r["k"]: r["rank"] for r in average_rank_desc(df, "v").collect()}
    series = pd.Series({k: v for k, v in rows}, dtype=float)
    expected = series.rank(ascending=False)
    assert got == {k: (None if np.isnan(r) else int(r)) for k, r in expected.items()}


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.choice(["x", "x", "x", "y"], 501), "a": rng.integers(0, 9, 501).astype(float), "b": rng.normal(size=501)})
    got = percentiles(spark.createDataFrame(frame), ["a", "b"], [0.25, 0.5, 0.75], ["g"]).collect()
    assert len(got) == 4
    for r in got:
        part = frame.loc[frame.g == r["g"], r["metric"]]
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(list(np.quantile(part, [0.25, 0.5, 0.75])))


def test_first_latest_and_nth(spark):
    rows = [(1, date(2020, 1, 1), "b", 1.0), (1, date(2020, 1, 1), "a", 2.0), (1, date(2021, 1, 1), "c", 3.0), (2, date(2020, 5, 5), "d", 4.0)]
    df = spark.createDataFrame(rows, "o long, d date, p string, v double")
    first = latest.first_per_key(df, ["o"], [F.col("d"), F.col("p")]).collect()
    assert {r["o"]: r["p"] for r in first} == {1: "a", 2: "d"}
    wide = {r["o"]: (r["p_1"], r["p_2"]) for r in latest.nth_as_columns(df, "o", [F.col("d"), F.col("p")], ["p"], 2).collect()}
    assert wide == {1: ("a", "b"), 2: ("d", None)}
    last = df.groupBy("o").agg(latest.latest_value("v", "d", "p").alias("v")).collect()
    assert {r["o"]: r["v"] for r in last} == {1: 3.0, 2: 4.0}
    lists = latest.top_list_per_key(df, "o", [F.desc("v")], "p", 2, "l").collect()
    assert {r["o"]: r["l"] for r in lists} == {1: ["a", "c"], 2: ["d"]}


def test_running_min_hot_key_and_nulls(spark):
    rng = random.Random(3)
    rows = [(i, 1 if i % 3 else None, date(2020, 1, 1) + timedelta(days=rng.randrange(40)), float(rng.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, k long, d date, v double")
    got = {r["i"]: r["m"] for r in latest.running_min(df, "k", "d", "v", "m").collect()}
    for i, k, d, _ in rows:
        assert got[i] == min(v for _, k2, d2, v in rows if k2 == k and d2 <= d)


def test_rolling_sums_and_distincts(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else rng.choice("abc"), rng.randrange(6), rng.choice(["p", "q", None]), rng.randrange(-5, 1), float(rng.randrange(100)), rng.choice("XY")) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, e long, t string, o int, v double, s string")
    when = {"near": F.col("o") >= -1, "far": F.col("o") >= -3, "unused": F.col("o") > 5}
    sums = {r["k"]: (r["n"], r["f"]) for r in rolling.period_sums(df, "k", when, [rolling.Measure("v", {"near": "n", "far": "f"}, "s = 'X'")]).collect()}
    counts = rolling.period_distincts(df, "k", when, [
        rolling.Distinct("e", {"near": "en", "far": "ef"}), rolling.Distinct("t", {"far": "tf"}, "s = 'X'"),
    ])
    for r in counts.collect():
        mine = [x for x in rows if x[0] == r["k"]]
        assert r["en"] == len({x[1] for x in mine if x[3] >= -1})
        assert r["ef"] == len({x[1] for x in mine if x[3] >= -3})
        assert r["tf"] == len({x[2] for x in mine if x[3] >= -3 and x[5] == "X" and x[2] is not None})
        assert sums[r["k"]] == (
            sum(x[4] for x in mine if x[3] >= -1 and x[5] == "X"), sum(x[4] for x in mine if x[3] >= -3 and x[5] == "X")
        )
    assert counts.count() == len({x[0] for x in rows})


def _whole_months(late, early):
    months = (late.year - early.year) * 12 + late.month - early.month
    last = lambda d: (d + timedelta(days=1)).month != d.month
    return months - (1 if late.day < early.day and not (last(late) and last(early)) else 0)


def test_range_join_and_latest_rate(spark):
    rng = random.Random(6)
    facts = [(i, rng.choice(["hot", "hot", "p"]), date(2020, 1, 31) + timedelta(days=rng.randrange(200))) for i in range(150)]
    rates = [("hot", date(2020, 1, 31), 0.1), ("hot", date(2020, 2, 29), 0.2), ("hot", date(2020, 4, 15), 0.3), ("p", date(2020, 3, 1), 0.4)]
    f = spark.createDataFrame(facts, "i long, plan string, d date")
    r = spark.createDataFrame(rates, "plan string, since date, rate double")
    expected = defaultdict(list)
    for i, plan, d in facts:
        for p, since, rate in rates:
            if p == plan and 0 <= _whole_months(d, since) <= 2:
                expected[i].append((since, rate))
    got = defaultdict(list)
    for row in lookups.rates_in_range(f, r, "plan", "d", "since", (0, 2)).collect():
        if row["rate"] is not None:
            got[row["i"]].append((row["since"], row["rate"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in expected.items()}
    one = lookups.latest_rate(f, r, "plan", "d", "since", "rate", (0, 2), "m").collect()
    assert len(one) == len(facts)
    assert {x["i"]: x["m"] for x in one} == {i: (max(expected[i])[1] if expected[i] else None) for i, _, _ in facts}


def test_lookups(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i long, k string")
    known = spark.createDataFrame([("a", 7), ("a", 8), (None, 9)], "key string, x long")
    assert [r["i"] for r in lookups.keep_known(facts, known, {"k": "key"}).collect()] == [1]
    assert sorted(r["i"] for r in lookups.keep_unknown(facts, known, {"k": "key"}).collect()) == [2, 3]
    flags = lookups.membership(facts, known, {"k": "key"}, "m").collect()
    assert {r["i"]: r["m"] for r in flags} == {1: 1, 2: 0, 3: 0}
    assert lookups.one_per_key(known, ["key"]).count() == 2
    pairs = spark.createDataFrame([(1, 5, date(2020, 1, 1)), (1, 4, date(2020, 1, 1)), (1, 3, date(2019, 1, 1)), (2, 9, date(2020, 1, 1))], "e long, o long, d date")
    assert {r["e"]: r["o"] for r in lookups.owner_of(pairs, "e", "o", "d").collect()} == {1: 4, 2: 9}


def test_owners_without_facts_stay(spark):
    facts = spark.createDataFrame([(1, "x"), (1, "y"), (7, "z")], "k long, f string")
    owners = spark.createDataFrame([(1, "a"), (2, "b")], "k long, o string")
    got = sorted(((r["k"], r["f"], r["o"]) for r in lookups.with_bare_rows(facts, owners, "k").collect()), key=str)
    assert got == [(1, "x", "a"), (1, "y", "a"), (2, None, "b")]


def test_large_key_is_split_in_joins_and_limited_in_windows(spark):
    """A third of the rows on one key: AQE cuts the join partition, the window sends k rows per task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        facts = spark.range(0, 60000, 1, 8).selectExpr("if(id % 3 = 0, 1, id) as k", "id as v", "repeat(string(id), 3) as pad")
        owners = spark.range(60000).selectExpr("id as k", "id % 5 as g")
        joined = lookups.with_bare_rows(facts, owners, "k")
        summed = joined.groupBy("k", "g").agg(F.count("v").alias("n"), F.max("pad").alias("pad"))
        rows = {r["k"]: r["n"] for r in summed.select("k", "n").collect()}
        assert rows[1] == 20001 and rows[3] == 0 and sum(rows.values()) == 60000
        kept = joined.select("k", "v", "g")
        assert kept.count() == 60000 + sum(1 for n in rows.values() if n == 0)
        plan = summed._jdf.queryExecution()
        summed.collect()
        assert "skewed" in summed._jdf.queryExecution().executedPlan().toString() or "isSkew" in plan.executedPlan().toString()
        top = latest.top_per_key(facts, ["k"], [F.desc("v")], 3)
        assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
        assert top.where("k = 1").count() == 3
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
                    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                    "spark.sql.adaptive.skewJoin.skewedPartitionFactor"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_waterfalls(spark):
    rows = [(1, 1, 1), (1, 1, 0), (1, None, 1), (0, 1, 1), (2, 1, 1)]
    df = spark.createDataFrame(rows, "e long, a int, b int")
    conditions = [F.col("a") == 1, F.col("b") == 1]
    got = sorted(tuple(r) for r in reports.waterfall(df, conditions).collect())
    assert got == [(1, 1, 4), (2, 1, 3)]
    got = sorted(tuple(r) for r in reports.entity_waterfall(df, "e", conditions).collect())
    assert got == [(1, 0, 3), (2, 0, 3)]
    empty = df.where("e > 9")
    assert sorted(tuple(r) for r in reports.waterfall(empty, conditions).collect()) == [(1, 0, 0), (2, 0, 0)]
    grouped = reports.waterfall(df.withColumn("g", F.lit(None).cast("int")), conditions, ["g"]).collect()
    assert {r["g"] for r in grouped} == {None}


def test_categories_and_profiles(spark):
    rows = [("a", 1, 10.0)] * 3 + [("b", 2, 20.0)] * 2 + [("c", 3, None)] + [(None, 4, 5.0)]
    df = spark.createDataFrame(rows, "c string, e long, v double")
    small = reports.small_to_others(df, "c", 2).groupBy("c_grouped").count().collect()
    assert {r[0]: r[1] for r in small} == {"a": 3, "b": 2, "Others": 1, None: 1}
    top = reports.rest_to_other(df, "c", 1, name="t").groupBy("t").count().collect()
    assert {r[0]: r[1] for r in top} == {"a": 3, "Other": 4}
    assert {r[0]: r[1] for r in reports.frequency(df, "c", keep_null=True).collect()} == {"a": 3, "b": 2, "c": 1, None: 1}
    assert len(reports.frequency(df, "c").collect()) == 3
    shape = {r["c"]: (r["n"], r["m"]) for r in reports.profile(df, ["c"], "e", {"v": "m"}, "n", distinct=True).collect()}
    assert shape == {"a": (1, 10.0), "b": (1, 20.0), "c": (1, None), None: (1, 5.0)}
    bands = reports.composition(df, {"v": [0, 10, 20]}).collect()
    assert {r["band"]: r["rows"] for r in bands} == {"(0, 10]": 4, "(10, 20]": 2, None: 1}
    assert reports.breakdown(df, ["c"], "e", "n").count() == 3


def test_cleaning(spark):
    df = spark.sql("select cast(null as int) as n, cast(null as string) as s, cast(1.25 as decimal(9,2)) as d, '7x' as bad, '7' as good")
    filled = cleaning.fill_by_type(df, 0, "N/A").first()
    assert (filled["n"], filled["s"]) == (0, "N/A")
    assert cleaning.decimals_to_double(df).schema["d"].dataType.simpleString() == "double"
    typed = cleaning.numbers_from_text(df, ["bad", "good"]).first()
    assert (typed["bad"], typed["good"]) == (None, 7)
    assert cleaning.strip_names(df.selectExpr("n as pre_A_POST"), "pre_", "_POST").columns == ["A"]
    assert cleaning.lower_names(df.selectExpr("n as ABC")).columns == ["abc"]


def test_logins(spark):
    rows = [("u", "01-01 08:00"), ("u", "01-05 09:00"), ("u", "03-01 00:00"), ("v", "01-02 00:00"), ("w", "02-01 00:00"), (None, "01-01 00:00"), ("x", "01-31 23:59"), ("x", "01-31 23:59")]
    df = spark.createDataFrame([(u, f"2024-{t}:00") for u, t in rows], "u string, t string").selectExpr("u", "timestamp(t) as t")
    seen = events.first_and_last_login(df, "u", "t", F.lit("2024-01-31").cast("date")).selectExpr("u", "date_format(registered_at, 'MM-dd') as r", "date_format(last_login_at, 'MM-dd') as l", "hits")
    # The snapshot day counts to its end, what comes later is not known yet.
    assert {r["u"]: (r["r"], r["l"], r["hits"]) for r in seen.collect()} == {"u": ("01-01", "01-05", 2), "v": ("01-02", None, 1), "x": ("01-31", "01-31", 2)}
    hits = spark.createDataFrame([(0, "1", "a", "b"), (1, "1", "a", "b"), (0, "5", "a", "b"), (0, "1", None, "b")], "x int, s string, p string, q string")
    assert events.usable_hits(hits, "x", "s", ["p", "q"], ["5", "7"]).count() == 1


def test_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    one = {r["k"] for r in sample_by_key(df.repartition(3), "k", 0.3, 123).collect()}
    two = {r["k"] for r in sample_by_key(df.repartition(7), "k", 0.3, 123).collect()}
    assert one == two and 0.28 < len(one) / 20000 < 0.32
    assert one != {r["k"] for r in sample_by_key(df, "k", 0.3, 124).collect()}


def test_owner_codes_may_be_text(spark):
    rows = [("p", "A12", "2024-01-01"), ("p", "B01", "2024-03-01"), ("p", "A99", "2024-03-01"), ("q", "A1", None), ("q", "Z", "2020-01-01"), (None, "A", "2024-01-01")]
    df = spark.createDataFrame(rows, "pol string, agt string, d string").withColumn("d", F.to_date("d"))
    assert {r["pol"]: r["agt"] for r in lookups.owner_of(df, "pol", "agt", "d").collect()} == {"p": "A99", "q": "Z"}


def test_sums_and_ranks_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [(k % 40, round(rng.uniform(0, 9e8), 2)) for k in range(4000)]
    seen = []
    for parts in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v double").repartition(parts)
        sums = rolling.period_sums(df, "k", {"all": F.lit(True)}, [rolling.Measure("v", {"all": "total"})])
        ranked = average_rank_desc(sums, "total", "place").collect()
        assert all(r["place"] is not None and r["total"] > 1e9 for r in ranked)
        seen.append({r["k"]: (r["total"], r["place"]) for r in ranked})
    assert seen[0] == seen[1]


def test_sums_and_counts_from_one_tree(spark):
    import random
    from decimal import Decimal

    chance = random.Random(5)
    rows = [
        (chance.choice(["a", "b", None]), chance.choice([1, 2, 3, None]), chance.choice(["x", "y", None]), chance.choice([0.1, 0.2, None, -3.0]), chance.randrange(4))
        for _ in range(500)
    ]
    df = spark.createDataFrame(rows, "k string, e int, t string, v double, m int")
    when = {"near": F.col("m") == 0, "far": F.col("m") <= 2, "unused": F.lit(True)}
    measures = [rolling.Measure("v", {"near": "near_v", "far": "far_v"}), rolling.Measure("v * 2", {"far": "far_w"}, "t = 'x'")]
    counts = [rolling.Distinct("e", {"near": "near_e", "far": "far_e"}), rolling.Distinct("t", {"far": "far_t"}, "e > 1")]
    got = {r["k"]: r.asDict() for r in rolling.period_kpis(df, "k", when, measures, counts).collect()}
    for key in ("a", "b", None):
        mine = [r for r in rows if r[0] == key]
        near, far = [r for r in mine if r[4] == 0], [r for r in mine if r[4] <= 2]
        total = lambda rows, f=1: float(sum(Decimal(str(r[3])) * f for r in rows if r[3] is not None))
        assert got[key] == {
            "k": key, "near_v": total(near), "far_v": total(far), "far_w": total([r for r in far if r[2] == "x"], 2),
            "near_e": len({r[1] for r in near} - {None}), "far_e": len({r[1] for r in far} - {None}),
            "far_t": len({r[2] for r in far if r[1] is not None and r[1] > 1} - {None}),
        }


def test_owners_of_decides_each_kind_on_its_own(spark):
    rows = [(1, 4, "p", "2020-01-02"), (1, 3, "q", "2020-01-02"), (1, 9, None, "2021-01-01"), (2, None, "z", "2020-01-01"), (None, 1, "n", "2020-01-01")]
    pairs = spark.createDataFrame(rows, "e int, a int, p string, d string")
    both = {r["e"]: (r["a"], r["p"]) for r in lookups.owners_of(pairs, "e", ["a", "p"], "d").collect()}
    assert both == {1: (9, "p"), 2: (None, "z")}
    for place, name in enumerate(("a", "p")):
        alone = {r["e"]: r[name] for r in lookups.owner_of(pairs, "e", name, "d").collect()}
        assert alone == {e: v[place] for e, v in both.items() if v[place] is not None}


def test_the_kpi_block_reads_its_facts_once(spark):
    from cohortloom.catalog import QUERIES

    plan = QUERIES["agent_kpi_block"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert sum("hashpartitioning(wa_code#" in line and "slot#" not in line for line in plan.split("\n") if "Exchange" in line) == 1
