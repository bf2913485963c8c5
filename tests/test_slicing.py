"""Results made in slices, stages that leave no shuffle files, and lookups that come before the policies."""

import time
from collections import Counter
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortloom import session
from cohortloom.catalog import agents as agent_queries
from cohortloom.catalog import clients as client_queries
from cohortloom.catalog import clusters, studies
from cohortloom.catalog.registry import tidy_mean
from cohortloom.catalog.slicing import in_slices
from cohortloom.functions.calendar import Snapshot
from cohortloom.operators import clustering
from cohortloom.plans import client_mart
from cohortloom.sources import sinks
from cohortloom.sources.star_tables import StarTables

SNAP = Snapshot.of("2024-05-31")
SMALL = "/root/testdata/sf0.001"


def _rows(df):
    names = sorted(df.columns)
    return Counter(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in (r[c] for c in names)) for r in df.collect())


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for f in folders for p in Path(f.toString()).rglob("shuffle_*")}


def _same_files(spark, before):
    for _ in range(100):  # files go after the write has ended
        if _shuffle_files(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def test_a_stage_leaves_no_shuffle_files_and_no_settings_behind(spark):
    kept = {k: spark.conf.get(k, None) for k in session.STORING}
    before = _shuffle_files(spark)
    counted = spark.range(0, 50000, 1, 4).groupBy((F.col("id") % 5000).alias("k")).count()
    stored = sinks.stage(counted, session.new_folder(spark))
    assert _same_files(spark, before)
    assert stored.count() == 5000 and {k: spark.conf.get(k, None) for k in session.STORING} == kept


def test_a_failed_write_puts_the_settings_back(spark):
    kept = {k: spark.conf.get(k, None) for k in session.STORING}
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.stage(broken, session.new_folder(spark))
    assert {k: spark.conf.get(k, None) for k in session.STORING} == kept


def test_every_row_is_in_one_slice(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([1, 1, 2, None, None, 3, -4, 5, 6, 7, 2**40])], "k long, i int")
    parts = [_rows(session.of_slice(df, "k", n, 3)) for n in range(3)]
    assert sum(parts, Counter()) == _rows(df)
    homes = [{row[1] for row in part} for part in parts]
    assert all(not a & b for i, a in enumerate(homes) for b in homes[i + 1:])


def test_slices_are_bounded(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    spark.range(20000).write.parquet(path)
    assert session.slices(spark, path) == 1
    monkeypatch.setattr(session, "MOST_PER_SLICE", 1)
    assert session.slices(spark, path) == session.MOST_SLICES


def test_results_in_slices_are_those_of_one(spark, monkeypatch):
    t = StarTables(spark, SMALL)
    summary, mart = _rows(client_queries.summary(t)), _rows(agent_queries.stored_mart(t))
    monkeypatch.setattr(session, "MOST_PER_SLICE", 1)
    taken = []
    in_slices(t, "k", lambda of_slice: taken.append(of_slice) or spark.range(1))
    assert len(taken) == session.MOST_SLICES
    assert _rows(client_queries.stored_summary(t)) == summary and _rows(agent_queries.stored_mart(t)) == mart


def test_lookups_before_the_policies_give_the_rows_of_lookups_after_them(spark):
    """Repeated and missing keys in every table, a policy without coverage and one without a number."""
    day = date(2024, 1, 1)
    lines = spark.createDataFrame([
        (1, 10, 100, day, 50.0, 5), (1, 11, 101, day, 70.5, 9), (1, 11, None, date(2023, 2, 1), 1.0, 2), (2, None, 100, day, 8.0, 1), (2, 12, 999, day, 9.0, None),
        (4, 10, 100, date(2025, 1, 1), 5.0, 5), (None, 10, 100, day, 5.0, 5), (77, 10, 100, day, 5.0, 5), (5, 10, 101, None, 5.0, 5),
    ], "pol_num long, plan_code long, wa_code long, cvg_eff_dt date, cvg_prem double, prem_dur int")
    policies = spark.createDataFrame([
        (p, o, "1", "12", chnl, loc, loc, day, None) for p, o, chnl, loc in
        [(1, 7, "01", None), (1, 7, "01", "TCB1"), (2, 8, "10", "SAG"), (3, 9, "48", None), (4, 7, "05", "X"), (None, 7, "01", None), (5, None, "09", None)]
    ], "pol_num long, po_num long, pol_stat_cd string, pmt_mode string, dist_chnl_cd string, loc_cd string, office_cd string, pol_eff_dt date, pol_trmn_dt date")
    plans = spark.createDataFrame([(10, "A"), (11, "B"), (11, "B"), (None, "C")], "plan_code long, type string")
    clients = spark.createDataFrame([(7, "m", None, "S"), (7, None, "t", "S"), (8, "m", "t", "S"), (None, "m", "t", "S")], "cli_num long, email_addr string, mobl_phon_num string, customer_segment string")
    sellers = spark.createDataFrame([(100, day, None, "01"), (100, date(2020, 1, 1), None, "01"), (101, day, None, "98"), (None, day, None, "01")], "agt_code long, agt_join_dt date, agt_term_dt date, comp_prvd_num string")
    flags = spark.createDataFrame([(100, 1), (101, 0), (101, 1), (None, 1)], "agt_code long, mdrt_flag int")
    margins = spark.createDataFrame([(p, *(f and f + i / 100 for i in range(7))) for p, f in [(10, 0.1), (11, None), (11, 0.3)]], "plan_code long, " + ", ".join(f"{f} double" for f in client_mart.FAMILIES))
    quarters = spark.createDataFrame([(10, "2024 Q1", 0.5), (11, "2024 Q1", 0.6), (11, "2024 Q1", 0.7), (12, None, 0.8)], "plan_code long, effective_qtr string, quarter_margin double")

    at_once = client_mart.with_value(client_mart.policy_base(lines, policies, SNAP, plans, clients, sellers, flags, (margins, quarters)))
    plain = client_mart.policy_base(lines, policies, SNAP)
    own = spark.createDataFrame([(7, 2), (8, 1)], "_n long, times int")  # clients by number
    after = plain.join(plans, "plan_code", "left").join(flags.withColumnRenamed("agt_code", "wa_code"), "wa_code", "left")
    after = after.join(sellers.select(F.col("agt_code").alias("wa_code"), "agt_join_dt"), "wa_code", "left").drop("agt_join_dt")
    after = client_mart.with_margins(after, margins, quarters)
    narrow = ["po_num", "pol_num", "wa_code", "plan_code", "type", "mdrt_flag", "cvg_eff_dt", "cvg_prem", "coverage_ape", "plan_nbv", "sales_channel", "inforce_yr", "prem_dur_pre", "f_inforce_ind"]
    times = after.join(own, after["po_num"] == own["_n"], "left").select(*narrow, F.coalesce("times", F.lit(1)).alias("times"))
    repeated = times.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*narrow)
    assert _rows(at_once.select(*narrow)) == _rows(repeated) and sum(_rows(repeated).values()) > 15


def test_coverages_are_dealt_three_times_for_the_summary(spark):
    """By agent, by plan and by policy, not once for every lookup table."""
    threshold = {k: spark.conf.get(k, None) for k in (session.STATIC_BROADCAST, "spark.sql.adaptive.enabled")}
    t = StarTables(spark, SMALL)
    try:
        for k in threshold:
            spark.conf.set(k, "-1" if k == session.STATIC_BROADCAST else "false")
        with session.stored_whole(spark):
            summary = client_queries.summary(t, client_queries.ANY_FLAGS, client_queries.SUM_FLAGS)
            shape = summary._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in threshold.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    wide = [line for line in shape.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("hashpartitioning(wa_code" in line for line in wide) == 1
    assert sum("hashpartitioning(plan_code" in line and "effective_qtr" not in line for line in wide) <= 4 and not any("effective_qtr" in line for line in wide)


def test_agents_of_the_study_in_slices_are_those_of_one(spark, monkeypatch):
    t = StarTables(spark, SMALL)
    agents = _rows(studies._agents(t))
    monkeypatch.setattr(session, "MOST_PER_SLICE", 1)
    assert _rows(studies._agents(t, in_slices(t, "wa_code", lambda of_slice: studies._agent_kpis(t, of_slice)))) == agents and agents


def test_the_campaign_base_leaves_only_its_last_shuffles(spark, monkeypatch):
    """What is made of coverages and claims is stored before the customers are joined, whatever the number of slices."""
    t, asked = StarTables(spark, SMALL), []
    stage_parts = sinks.stage_parts

    def counted(parts, path):
        asked.append(path)
        return stage_parts(parts, path)

    monkeypatch.setattr(sinks, "stage_parts", counted)
    shape = studies._campaign(t)._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) >= 3 and "l_extendedprice" not in shape and "l_suppkey" not in shape


def test_the_elbow_table_counts_every_client(spark):
    t = StarTables(spark, SMALL)
    features = clusters._features(t, sampled=False)
    fitted = clusters._pipeline().fit(features)
    every = clustering.inertia_of_one(fitted.transform(features).select(clustering.FEATURES))
    table = {r["k"]: r["inertia"] for r in clusters.elbow_table(t).collect()}
    assert sorted(table) == list(range(1, 10)) and table[1] == pytest.approx(every, rel=1e-9)


def test_the_last_bits_of_a_mean_do_not_decide_its_rounding(spark):
    df = spark.createDataFrame([("a", 2088.1364999999996), ("b", 2088.1365), ("c", 2088.13649), ("d", None), ("e", -0.0004999999999999999)], "k string, mean double")
    assert {r["k"]: r["mean"] for r in tidy_mean(df, 3).collect()} == {"a": 2088.137, "b": 2088.137, "c": 2088.136, "d": None, "e": -0.001}
