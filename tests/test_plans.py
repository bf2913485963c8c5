"""Marts and studies on hand-made rows, storage, clusters, and plan shape."""

import random
import re
import subprocess
import sys
import time
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions.calendar import Snapshot
from cohortloom.operators import clustering
from cohortloom.plans import activation, agent_mart, client_mart, slicers
from cohortloom.session import new_folder, settle
from cohortloom.sources import schemas, sinks, tables
from cohortloom.sources.star_tables import StarTables

SNAP = Snapshot.of("2024-05-31")
SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_agent_master_filters_and_tiers(spark):
    agents = spark.createDataFrame([
        (1, "Agency", "1", None, "01", "S", date(2020, 5, 31)), (2, "Agency", "1", None, "98", None, date(2023, 6, 30)),
        (3, "Bank", "1", None, "01", None, date(2020, 1, 1)), (4, "Agency", "9", None, "01", None, date(2020, 1, 1)),
        (5, "Agency", "1", date(2024, 1, 1), "01", None, date(2020, 1, 1)), (6, "Agency", "1", None, "77", None, date(2020, 1, 1)),
        (7, "Agency", "1", None, "01", "G", date(2020, 1, 1)),
    ], "agt_code long, channel string, agt_stat_code string, agt_term_dt date, comp_prvd_num string, title string, agt_join_dt date")
    listed = spark.createDataFrame([(7, "MDRT"), (7, "MDRT")], "agt_code long, ranking string")
    courses = spark.createDataFrame([(1, "01", "01", "x", None), (2, "98", "01", None, None), (7, "01", "02", "x", "x")], "agt_code long, compro string, stat_cd string, a string, b string")
    counts = agent_mart.training_counts(courses, ["a", "b"], ("01", "98"))
    assert [tuple(r) for r in counts.collect()] == [(1, 1)]
    got = {r["agt_code"]: (r["tier"], r["tenure_mth"], r["no_sbw_completed"]) for r in agent_mart.agent_master(agents, listed, counts, SNAP).collect()}
    assert got == {1: ("Silver", 48, 1), 2: ("Unranked", 11, 0), 7: ("MDRT", 52, 0)}


def test_next_tier(spark):
    rows = [("Unranked", 1000.0), ("Silver", 400000.0), ("TOT", None), ("Odd", 1.0)]
    got = agent_mart.with_next_tier(spark.createDataFrame(rows, "tier string, ape_ytd double")).collect()
    assert [(r["next_tier"], r["gap_to_next_tier"]) for r in got] == [("Silver", 59000.0), ("Gold", 0.0), ("TOT", 4329759.6), (None, None)]


def test_quality_rates_stay_between_zero_and_one(spark):
    names = {f"{p}_{s}": i % 4 for p in agent_mart.ROLLING for i, s in enumerate(("pol", "NT", "rej", "lap"))}
    names |= {"lap_14m_pol": 1, "lap_20m_pol": 2, "lap_26m_pol": 2, "all_pol_cnt": 4}
    df = spark.createDataFrame([tuple(names.values())], list(names))
    row = agent_mart.with_quality_rates(df).first()
    assert row["14m_per"] == 0.75 and row["26m_per"] == 0.5
    assert row["last_mth_lap_per"] == 1.0
    assert row["last_3m_NT_per"] == 0.0 and row["12M_NT_rate"] == 0.0


def test_claims_count_once(spark):
    claims = spark.createDataFrame([
        ("c1", 1, date(2024, 1, 1), "A", 10.0, 9.0), ("c1", 1, date(2024, 1, 1), "A", 5.0, 5.0), ("c2", 1, date(2020, 1, 1), "A", 7.0, 7.0),
        ("c3", 2, date(2024, 5, 1), "I", 3.0, None), ("c4", 2, date(2024, 6, 1), "A", 1.0, 1.0), ("c5", 9, date(2024, 5, 1), "A", 1.0, 1.0),
    ], "clm_id string, pol_num long, clm_recv_dt date, clm_stat_code string, clm_prvd_amt double, clm_aprov_amt double")
    owners = spark.createDataFrame([(1, "x"), (2, "y")], "pol_num long, agt_cd string")
    got = {r["agt_cd"]: tuple(r)[1:] for r in agent_mart.claim_kpis(claims, owners, SNAP).collect()}
    assert got == {"x": (1, 15.0, 1, 14.0, 0, 1.0), "y": (1, 3.0, 0, 0.0, 1, 0.0)}


def test_product_marks(spark):
    df = spark.createDataFrame([(1, "APPROVED", 0.5, 0.5, 0.05, 0.2), (2, "APPROVED", 0.1, 0.7, 0.1, 0.1), (3, "REJECTED", 1.0, 0.0, 0.0, 0.0)],
                               "po_num long, DEPLOYMENT_APPROVAL_STATUS string, rep_purchase_comb_health_base_PREDICTION double, rep_purchase_comb_inv_base_PREDICTION double, rep_purchase_comb_health_rider_PREDICTION double, rep_purchase_comb_riders_PREDICTION double")
    got = {r["po_num"]: (r["which_prd"], r["health_base"], r["inv_base"], r["health_rider"], r["riders"]) for r in agent_mart.approved_products(df).collect()}
    assert got == {1: ("health_base", "*", "", "", "*"), 2: ("inv_base", "", "*", "", "")}


def test_activation_rules(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, 2, 3), (2, 0, 0, 0, 0, 1), (3, None, None, None, None, None)],
                               "agt_code long, last_mth_pol int, last_3m_pol int, last_6m_pol int, last_9m_pol int, last_12m_pol int")
    got = [(r["manager_0_active"], r["f_agt_inactive"], r["last_pol_cat"]) for r in activation.activity(df).orderBy("agt_code").collect()]
    assert got == [("Active", 0, "6mA"), ("Inactive", 1, "12mA"), ("Inactive", 1, "12m-Inactive")]
    agents = spark.createDataFrame([(13, 6000.0, 3, 0.8), (12, 6000.0, 3, 0.8), (13, None, 3, 0.8)], "agt_tenure_mths int, last_12m_ape double, cus_existing int, `14m_per` double")
    flags = activation.with_target(activation.with_bands(agents, codes.AGENT_BANDS)).collect()
    assert [r["f_target_agent"] for r in flags] == [1, 0, 0]
    levels = spark.createDataFrame([(None, "b", "c"), (None, None, None)], "m0 string, m1 string, m2 string")
    assert [r["first_sm_name"] for r in activation.first_manager(levels, ["m0", "m1", "m2"]).collect()] == ["b", None]


def test_performance_segments(spark):
    df = spark.createDataFrame([(i, i, 0) for i in range(1, 9)] + [(9, None, 0)], "agt_cd long, po_num_count int, all_pol_cnt int")
    only = activation.performance_segments(df, ["po_num_count"], ("po_num_count",))
    got = {r["agt_cd"]: r["segment"] for r in only.collect()}
    assert [got[i] for i in (1, 2, 3, 6, 7, 8, 9)] == [
        "The Slackers", "The Slackers", "High Performers", "High Performers", "Top Performers", "Top Performers", "The Slackers"]
    ranked = [r["segment"] for r in activation.ranked_agents(only, ["agt_cd"]).collect()]
    assert ranked == sorted(ranked, key=codes.PERFORMANCE_LABELS.index)


def test_family_groups(spark):
    rows = [(1, 0, "3+"), (1, 1, "0"), (0, 1, "2"), (0, 0, "1"), (0, 0, "0"), (0, 0, None)]
    df = spark.createDataFrame([(a, b, c, 0, 0, 0, 1) for a, b, c in rows], "dpnd_child_ind int, dpnd_spouse_ind int, no_dpnd_cat string, f_vip_elite int, f_vip_plat int, f_vip_gold int, f_vip_silver int")
    got = [(r["group"][:1], r["cus_vip_cat"]) for r in slicers.with_family_groups(df).collect()]
    assert got == [(g, "4. Silver") for g in "241345"]


def test_claims_of_six_months(spark):
    claims = spark.createDataFrame([
        ("a", 1, date(2023, 11, 30), "A", 3, 1.0), ("b", 1, date(2023, 12, 1), "A", 3, 2.0), ("c", 1, date(2024, 5, 31), "A", 7, 4.0),
        ("d", 2, date(2024, 5, 1), "A", 7, 8.0), ("e", 2, date(2024, 5, 1), "I", 7, 16.0), ("f", 2, date(2024, 5, 1), "A", 8, 32.0), ("g", 3, date(2024, 5, 1), "A", 7, 64.0),
    ], "clm_id string, pol_num long, clm_aprov_dt date, clm_stat_code string, clm_code int, clm_aprov_amt double")
    policies = spark.createDataFrame([(1, 10, "1"), (2, 10, "1"), (3, 11, "A")], "pol_num long, po_num long, pol_stat_cd string")
    got = slicers.claims_last_6m(claims, policies, SNAP).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["po_num"], row["clm_6m_cnt"], row["clm_lst_dt"], row["clm_lst_amt"]) == (10, 3, date(2024, 5, 31), 4.0)
    assert row["clm_6m_amt"] == pytest.approx(14.0 / codes.FX_RATE)


def test_ltv_parts_add_up(spark):
    from cohortloom.catalog.clients import policy_values

    values = policy_values(StarTables(spark, SMALL)).where("pol_ltv is not null")
    row = values.select(F.max(F.abs(F.col("pol_ltv") - F.col("pol_ltv_pre") - F.col("pol_ltv_post"))).alias("gap"), F.count("*").alias("n")).first()
    assert row["n"] > 0
    # Shortest term and shortest paid time may come from different coverages, so only one-coverage policies must add up.
    single = values.where("years = years_paid + years_left")
    assert single.where(F.abs(F.col("pol_ltv") - F.col("pol_ltv_pre") - F.col("pol_ltv_post")) > 1e-6).count() == 0


def test_propensity_takes_the_smallest_number(spark):
    existing = spark.createDataFrame([("a", 10, 2, None, 9, 9, 9), ("b", None, None, None, None, None, None)], schemas.EXISTING_SCORES)
    new = spark.createDataFrame([("a", 1, 5, 5), ("c", 9, 10, 9)], schemas.NEW_SCORES)
    got = {r["po_num"]: r["min_decile"] for r in client_mart.best_propensity(existing, new).collect()}
    assert got == {"a": 1, "b": None, "c": 9}


def test_partition_overwrite_keeps_other_months(spark):
    path = new_folder(spark)
    df = spark.createDataFrame([(1, "2024-04-30"), (2, "2024-05-31")], "v long, image_date string")
    sinks.write_partitions(df, path)
    sinks.write_partitions(df.where("v = 2").withColumn("v", F.lit(20).cast("long")), path)
    stored = tables.parquet_table(spark, path)
    assert sorted(r["v"] for r in stored.collect()) == [1, 20]
    assert [r["v"] for r in tables.snapshot_folder(spark, path, SNAP).collect()] == [20]
    kept = tables.at_snapshot(stored, SNAP)
    assert "PartitionFilters: [isnotnull(image_date" in plan_of(kept)
    monthly = df.select("v", F.substring("image_date", 1, 7).alias("monthend_dt"))
    other = new_folder(spark)
    sinks.write_partitions(monthly, other, ["monthend_dt"])
    assert [r["v"] for r in tables.snapshot_folder(spark, other, SNAP, "monthend_dt").collect()] == [2]


def test_readers(spark):
    path = new_folder(spark)
    sinks.write_report(spark.createDataFrame([("a", 3, 0.5)], schemas.LAPSE_SCORES), path, one_file=True)
    assert tables.csv_table(spark, path).first()["decile"] == "3"
    assert tables.csv_table(spark, path, schemas.LAPSE_SCORES).first()["lapse_score"] == 0.5
    assert tables.empty_table(spark, schemas.CLUSTERS).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.load_tables(spark, [SMALL], ["no_such_table"])
    assert list(tables.load_tables(spark, ["/nowhere", SMALL], ["nation.parquet/"])) == ["NATION.PARQUET"]


def test_settled_rows_have_no_lineage(spark):
    assert "Range" not in plan_of(settle(spark.range(10)))


def test_clusters(spark):
    rng = random.Random(7)
    rows = [(i, (i % 3) * 10 + rng.random(), None if i % 50 == 0 else float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    pipeline = clustering.feature_pipeline(["x", "y"], weights={"x": 10.0})
    model = clustering.fit_clusters(df, pipeline, 3, 123)
    path = new_folder(spark)
    clustering.save_model(model, path)
    scored = clustering.assign_clusters(df, clustering.load_model(path))
    assert scored.columns == ["k", "x", "y", "clusters"] and scored.count() == 300
    assert scored.groupBy((F.col("k") % 3).alias("g")).agg(F.countDistinct("clusters").alias("n")).where("n > 1").count() == 0
    costs = [r["inertia"] for r in clustering.elbow_table(df, pipeline, 5, 123).orderBy("k").collect()]
    assert len(costs) == 5 and all(b <= a + 1e-6 for a, b in zip(costs, costs[1:]))
    # Standardised columns have variance one, so one cluster costs (n - 1) times the squared weights.
    assert costs[0] == pytest.approx(299 * (100 + 1), rel=1e-6)


def test_scans_are_pruned_and_limited_before_the_shuffle(spark):
    from cohortloom.catalog import QUERIES

    flagship = plan_of(QUERIES["rolling_sum_ape"](spark, SMALL))
    assert "l_comment" not in flagship and "l_tax" not in flagship and "PushedFilters: [IsNotNull(l_shipdate), LessThan" in flagship
    assert "WindowGroupLimit" in plan_of(QUERIES["latest_per_key"](spark, SMALL))
    for name in ("rolling_distinct_policy", "wide_feature_mart", "policy_base_star", "range_margin_join"):
        shape = plan_of(QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in shape and "NestedLoop" not in shape and "PythonUDF" not in shape


def test_nothing_after_the_snapshot_reaches_the_client_side(spark):
    from cohortloom.catalog import windows
    from cohortloom.sources.star_tables import HIT_SNAPSHOT, SNAPSHOT

    t = StarTables(spark, SMALL)
    late = t.coverage_lines().where(F.col("cvg_eff_dt") > SNAPSHOT.column())
    assert late.count() > 0
    base = client_mart.policy_base(t.coverage_lines(), t.policies(), SNAPSHOT)
    assert base.where((F.col("prem_dur_pre") < 0) | (F.col("prem_dur_post") > F.col("prem_dur")) | (F.col("inforce_yr") < 0)).count() == 0
    assert base.where(F.col("cvg_eff_dt") > SNAPSHOT.column()).count() == 0
    pairs = client_mart.first_two_policies(t.policies(), windows.policy_types(t), SNAPSHOT)
    assert pairs.where((F.col("pol_eff_dt_1") > SNAPSHOT.column()) | (F.col("pol_eff_dt_2") > SNAPSHOT.column())).count() == 0
    assert windows.logins(t).where(F.datediff(HIT_SNAPSHOT.column(), "registered_at") < 0).count() == 0


def test_agent_premium_counts_a_policy_once(spark):
    from cohortloom.catalog import agents
    from cohortloom.sources.star_tables import SNAPSHOT

    t = StarTables(spark, SMALL)
    sold = t.policies().join(agent_mart.policy_agents(agents.mart(t, [])).withColumnRenamed("agt_cd", "wa_code"), "pol_num")
    total = slicers.agent_premium(sold, SNAPSHOT).agg(F.sum("agt_total_ape")).first()[0]
    every = sold.where(~F.col("pol_stat_cd").isin(*codes.VOID_CODES)).dropDuplicates(["pol_num"]).agg(F.sum(F.col("tot_ape") / codes.FX_RATE)).first()[0]
    assert total == pytest.approx(every)


def test_a_month_of_dated_rows_is_a_range_on_the_scan(spark):
    from cohortloom.catalog import QUERIES

    shape = plan_of(QUERIES["snapshot_scan_filter"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in shape and "LessThan" in shape


def test_stages_end_with_the_application():
    code = """
from cohortloom.session import local_session, new_folder
spark = local_session(1, "stages", "1g")
path = new_folder(spark)
spark.range(5).write.parquet(path)
assert spark.read.parquet(path).count() == 5
print("FOLDER", path)
"""
    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120, capture_output=True, text=True).stdout
    folder = Path(re.search("FOLDER (.*)", said)[1].removeprefix("file:"))
    assert folder.name == "data"
    for _ in range(50):  # the driver's JVM ends after its Python
        if not folder.parent.exists():
            return
        time.sleep(0.2)
    raise AssertionError(f"{folder.parent} is still there")


def test_change_flags_count_months_back_from_the_snapshot(spark):
    rows = [
        (1, "addr", date(2024, 5, 1)), (1, "addr", date(2024, 6, 1)), (1, "occp", date(2023, 5, 31)), (2, "addr", date(2024, 4, 30)), (2, "addr", date(2024, 4, 29)),
        (3, "occp", date(2024, 5, 31)), (4, "addr", date(2024, 6, 2)), (5, "name", date(2024, 5, 5)), (6, "addr", None),
    ]
    got = client_mart.change_flags(spark.createDataFrame(rows, "cli_num int, kind string, change_dt date"), SNAP)
    assert got.columns == ["po_num", *(f"f_{k}chg_{n}m" for k in ("addr", "occp") for n in (1, 3, 6, 12))]
    assert {r["po_num"]: tuple(r)[1:] for r in got.collect()} == {
        1: (1, 1, 1, 1, 0, 0, 0, 0), 2: (0, 1, 1, 1, 0, 0, 0, 0), 3: (0, 0, 0, 0, 1, 1, 1, 1), 5: (0,) * 8,
    }
