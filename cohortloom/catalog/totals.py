"""Plain aggregates, profiles and reports."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query, tidy
from cohortloom.catalog.sql import DAY, cut, with_parts, mean_sql
from cohortloom.functions import codes
from cohortloom.functions.measures import exact_mean
from cohortloom.functions.bands import flag
from cohortloom.operators import reports
from cohortloom.operators.ordering import percentiles
from cohortloom.plans import agent_mart, slicers
from cohortloom.sources.star_tables import SNAPSHOT


@query("group_totals", with_parts(f"""
select pol_stat_cd, pmt_mode, count(*) as policies, round(sum(tot_ape), 4) as total, min(tot_ape) as least, max(tot_ape) as most,
  {cut(mean_sql("tot_ape"), 2)} as average, count(distinct po_num) as owners from policy group by 1, 2""", "policy"))
def group_totals(t):
    return tidy(t.policies().groupBy("pol_stat_cd", "pmt_mode").agg(
        F.count(F.lit(1)).alias("policies"), F.round(F.sum("tot_ape"), 4).alias("total"), F.min("tot_ape").alias("least"),
        F.max("tot_ape").alias("most"), exact_mean(F.col("tot_ape")).alias("average"), F.countDistinct("po_num").alias("owners"),
    ), 4, cents=("average",))


@query("ratio_of_sums", with_parts("""
select wa_code, round(sum(cvg_prem * (prem_dur / 100)) / nullif(sum(cvg_prem), 0), 6) as margin from line group by 1""", "line"))
def ratio_of_sums(t):
    weighted = F.col("cvg_prem") * (F.col("prem_dur") / 100)
    return tidy(t.coverage_lines().groupBy("wa_code").agg(F.try_divide(F.sum(weighted), F.sum("cvg_prem")).alias("margin")))


@query("any_flag", with_parts("""
select po_num, cast(max(case when cvg_typ = 'R' then 1 else 0 end) as bigint) as f_rider,
  cast(max(case when pmt_mode = '12' then 1 else 0 end) as bigint) as annual_flag from cov group by 1""", "cov"))
def any_flag(t):
    return tidy(t.coverages().groupBy("po_num").agg(
        F.max(flag(F.col("cvg_typ") == codes.RIDER_CODE)).alias("f_rider"),
        F.max(flag(F.col("pmt_mode") == "12")).alias("annual_flag"),
    ))


@query("control_totals", with_parts("""
select round(sum(tot_ape), 4) as tot_ape, cast(sum(pol_num) as double) as pol_num from policy""", "policy"))
def control_totals(t):
    source = t.policies().withColumn("pol_num", F.col("pol_num").cast("double"))
    return tidy(reports.control_totals(source, ["tot_ape", "pol_num"]), 4)


@query("row_counts", with_parts("select count(*) as rows, count(distinct po_num) as entities from cov", "cov"))
def row_counts(t):
    return reports.control_counts(t.coverages(), "po_num")


@query("frequency_table", with_parts("select pmt_mode, count(*) as policies from policy group by 1", "policy"))
def frequency_table(t):
    return reports.frequency(t.policies(), "pmt_mode", keep_null=True, name="policies")


@query("frequency_known", with_parts("select pmt_mode, count(*) as policies from policy where pmt_mode is not null group by 1", "policy"))
def frequency_known(t):
    return reports.frequency(t.policies(), "pmt_mode", name="policies")


@query("mixed_profile", with_parts(f"""
select customer_segment, count(distinct po_num) as customers, {cut(mean_sql("cur_age"))} as cur_age, {cut(mean_sql("no_dpnd"))} as no_dpnd,
  {cut(mean_sql("tot_ape"), 2)} as total_ape from policy join client on cli_num = po_num group by 1""", "policy", "client"))
def mixed_profile(t):
    rows = t.policies().join(t.clients(), F.col("po_num") == F.col("cli_num"))
    means = {"cur_age": "cur_age", "no_dpnd": "no_dpnd", "tot_ape": "total_ape"}
    return tidy(reports.profile(rows, ["customer_segment"], "po_num", means, "customers", distinct=True), cents=("total_ape",))


_STATS = ["cur_age", "mthly_incm", "no_dpnd"]
def stats_sql(group, metric, source):
    """Count, mean, spread and quartiles of one metric per group."""
    columns = {
        "mean": mean_sql(metric), "stddev": f"stddev_samp({metric})", "min": f"cast(min({metric}) as double)",
        "max": f"cast(max({metric}) as double)", "p25": f"quantile_cont({metric}, 0.25)", "median": f"quantile_cont({metric}, 0.5)",
        "p75": f"quantile_cont({metric}, 0.75)",
    }
    cuts = ", ".join(f'{cut(text, 4)} as "{name}"' for name, text in columns.items())
    return f"select {group}, '{metric}' as metric, count({metric}) as count, {cuts} from {source} group by 1"


@query("summary_stats", with_parts(" union all ".join(stats_sql("customer_segment", c, "client") for c in _STATS), "client"))
def summary_stats(t):
    return tidy(reports.summary(t.clients(), _STATS, ["customer_segment"]), 4)


@query("percentile_thresholds", with_parts(" union all ".join(
    f"select '{c}' as metric, {cut(f'quantile_cont({c}, 0.75)', 4)} as p75, {cut(f'quantile_cont({c}, 0.25)', 4)} as p25 from line"
    for c in ("cvg_prem", "prem_dur")), "line"))
def percentile_thresholds(t):
    return tidy(percentiles(t.coverage_lines(), ["cvg_prem", "prem_dur"], [0.75, 0.25]), 4)


@query("latest_claim", with_parts(f"""
select po_num, cast(sum(cnt) as bigint) as clm_6m_cnt, round(sum(amt) / {codes.FX_RATE}, 2) as clm_6m_amt, cast(max(lst_dt) as varchar) as clm_lst_dt,
  arg_max(lst_amt, (lst_dt, pol_num)) as clm_lst_amt
from (select pol_num, count(*) as cnt, sum(clm_aprov_amt) as amt, max(clm_aprov_dt) as lst_dt, arg_max(clm_aprov_amt, (clm_aprov_dt, clm_id)) as lst_amt
  from claim where clm_aprov_dt > date '2000-12-30' and clm_aprov_dt <= {DAY} and clm_stat_code = 'A'
    and clm_code in ({", ".join(map(str, codes.CLAIM_CODES))}) group by 1) c
join (select pol_num, po_num from policy where pol_stat_cd not in ('A', 'N', 'R')) p using (pol_num) group by 1""", "claim", "policy"))
def latest_claim(t):
    return tidy(slicers.claims_last_6m(t.claims(), t.policies(), SNAPSHOT), cents=("clm_6m_amt",))


@query("latest_claim_older_codes", with_parts(f"""
select po_num, cast(sum(cnt) as bigint) as clm_6m_cnt, round(sum(amt) / {codes.FX_RATE}, 2) as clm_6m_amt
from (select pol_num, count(*) as cnt, sum(clm_aprov_amt) as amt
  from claim where clm_aprov_dt > date '2000-12-30' and clm_aprov_dt <= {DAY} and clm_stat_code = 'A'
    and clm_code in ({", ".join(map(str, codes.CLAIM_CODES_OLDER))}) group by 1) c
join (select pol_num, po_num from policy where pol_stat_cd not in ('A', 'N', 'R')) p using (pol_num) group by 1""", "claim", "policy"))
def latest_claim_older_codes(t):
    found = slicers.claims_last_6m(t.claims(), t.policies(), SNAPSHOT, codes.CLAIM_CODES_OLDER)
    return tidy(found.select("po_num", "clm_6m_cnt", "clm_6m_amt"), cents=("clm_6m_amt",))


@query("agent_premium", with_parts(f"""
select wa_code, round(sum(case when pol_eff_dt <= {DAY} then tot_ape / {codes.FX_RATE} end), 2) as agt_total_ape
from policy join (select pol_num, agt_cd as wa_code from policy_agent) using (pol_num) where pol_stat_cd not in ('A', 'N', 'R') group by 1""",
                                  "policy", "policy_agent"))
def agent_premium(t):
    """Each policy counts for its one responsible agent."""
    from cohortloom.catalog.agents import mart

    sold = t.policies().join(agent_mart.policy_agents(mart(t, [])).withColumnRenamed("agt_cd", "wa_code"), "pol_num")
    return tidy(slicers.agent_premium(sold, SNAPSHOT), 2)


@query("sort_limit", with_parts("select pol_num, po_num, tot_ape from policy order by tot_ape desc, pol_num limit 10", "policy"))
def sort_limit(t):
    return t.policies().select("pol_num", "po_num", "tot_ape").orderBy(F.desc("tot_ape"), "pol_num").limit(10)
