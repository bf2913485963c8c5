"""The agent mart, its rolling KPIs and the agent scorecard."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query, tidy
from cohortloom.catalog.slicing import in_slices, whole
from cohortloom.catalog.sql import BLOCKS, DAY, SUM_BLOCKS, cut, kpi_select, cut_all, rate_columns, size_columns, with_parts
from cohortloom.functions import codes
from cohortloom.operators.ordering import average_rank_desc
from cohortloom.plans import agent_mart
from cohortloom.session import new_folder
from cohortloom.sources.sinks import stage
from cohortloom.sources.star_tables import SNAPSHOT

COURSES = [f"sbw{i:02d}" for i in range(1, 13)]


def master(t):
    training = agent_mart.training_counts(t.training(), COURSES, ("01", "98"))
    return agent_mart.agent_master(t.agents(), t.tier_list(), training, SNAPSHOT)


def mart(t, parts=agent_mart.PARTS, of_slice=whole):
    return agent_mart.coverage_mart(
        of_slice(t.coverages()), t.policies(), master(t), t.clients(), t.plans(), t.dated_margins(), SNAPSHOT, parts
    )


KPI_PARTS = ["sale_order", "premium", "value", "relation"]


def stored_mart(t, parts=KPI_PARTS):
    """The KPI columns of the mart written once, for results that read them several times; each row depends on its own policy."""
    def columns_of(made):
        return made.select(*(c for c in agent_mart.KPI_COLUMNS if c in made.columns))

    return in_slices(t, "pol_num", lambda of_slice: columns_of(mart(t, parts, of_slice)))


@query("agent_master", with_parts("""
select agt_code, agt_nm, tier, mpro_title, tenure_mth, no_sbw_completed from master""", "master"))
def agent_master_query(t):
    return tidy(master(t).select("agt_code", "agt_nm", "tier", "mpro_title", "tenure_mth", "no_sbw_completed"))


@query("scorecard_flags", """
select s_suppkey as agt_code, cast(case when s_suppkey % 11 = 0 then 1 else 0 end as bigint) as mdrt_flag,
  cast(case when s_suppkey % 33 = 0 then 1 else 0 end as bigint) as mdrt_tot_flag,
  cast(case when s_suppkey % 33 = 11 then 1 else 0 end as bigint) as mdrt_cot_flag,
  cast(case when s_suppkey % 5 = 0 then 1 else 0 end as bigint) as fc_flag,
  cast(case when s_suppkey % 5 = 1 then 1 else 0 end as bigint) as mba_flag,
  cast(case when s_suppkey % 5 = 2 then 1 else 0 end as bigint) as active_1m_flag,
  cast(case when s_suppkey % 5 = 3 then 1 else 0 end as bigint) as active_3m_flag from supplier""")
def scorecard_flags(t):
    return tidy(agent_mart.scorecard_flags(t.scorecards(), t.tier_list()).drop("agent_group", "agent_tier"))


@query("persistency_balance", with_parts("""
select agt_code as wa_code, s_acctbal as m19_per from master join supplier on s_suppkey = agt_code""", "master"))
def persistency_balance(t):
    return tidy(agent_mart.persistency_balance(t.balances(), master(t), SNAPSHOT))


@query("having_count", with_parts("select agt_code, no_sbw_completed from training", "training"))
def having_count(t):
    return tidy(agent_mart.training_counts(t.training(), COURSES, ("01", "98")))


@query("agent_coverage_mart", with_parts("""
select pol_num, plan_code, wa_code, cast(cvg_eff_dt as varchar) as cvg_eff_dt, round(adjust_ape, 6) as adjust_ape,
  round(nbv, 6) as nbv, po_ins_rela, cast(repeated_sales as bigint) as repeated_sales, cast(last_n_month_eff_cvg as bigint) as last_n_month_eff_cvg,
  year_month, tier, cast(min(cvg_eff_dt) over (partition by insrd_num) as varchar) as frst_pol_dt from mart""", "mart"))
def agent_coverage_mart(t):
    return tidy(mart(t).select(
        "pol_num", "plan_code", "wa_code", "cvg_eff_dt", "adjust_ape", "nbv", "po_ins_rela", "repeated_sales",
        "last_n_month_eff_cvg", "year_month", "tier", "frst_pol_dt",
    ))


def _register_kpi(name, blocks, parts):
    def build(t):
        kind = agent_mart.kpi_sums if blocks[0] in SUM_BLOCKS else agent_mart.kpi_counts
        return tidy(kind(mart(t, parts), SNAPSHOT, *blocks))

    query(name, with_parts(kpi_select(*blocks), "mart"))(build)


_register_kpi("rolling_sum_ape", ["ape"], ["premium"])
_register_kpi("rolling_sum_nbv", ["nbv"], ["premium", "value"])
_register_kpi("rolling_distinct_owner", ["owner", "insured"], [])
_register_kpi("rolling_distinct_policy", ["policy"], [])
_register_kpi("rolling_distinct_product", ["product", "family"], ["premium", "relation"])
_register_kpi("rolling_status_counts", ["not_taken", "rejected"], [])
_register_kpi("rolling_rider", ["rider"], ["premium"])
_register_kpi("rolling_repeat", ["repeat_ape", "repeat_nbv"], ["sale_order", "premium", "value"])
_register_kpi("persistency_counts", ["lapsed"], [])

_SIZES, _RATES = list(size_columns()), list(rate_columns())


def _rounded(names):
    return cut_all(*names)


@query("ticket_size", with_parts(f"select wa_code, {_rounded(_SIZES)} from rates", "rates"))
def ticket_size(t):
    kpis = agent_mart.kpi_block(mart(t, ["premium"]), SNAPSHOT, ["ape"], ["policy", "owner"])
    return tidy(agent_mart.with_ticket_sizes(kpis).select("wa_code", *_SIZES))


@query("quality_rates", with_parts(f"select wa_code, {_rounded(_RATES)} from rates", "rates"))
def quality_rates(t):
    counts = agent_mart.kpi_counts(mart(t, []), SNAPSHOT, "policy", "not_taken", "rejected", "lapsed")
    return tidy(agent_mart.with_quality_rates(counts).select("wa_code", *[f"`{c}`" for c in _RATES]))


_ALL_SUMS = [n for b in SUM_BLOCKS for n in BLOCKS[b]]
_ALL_COUNTS = [n for b in BLOCKS if b not in SUM_BLOCKS for n in BLOCKS[b]]


@query("agent_kpi_block", with_parts(
    f"select wa_code, {_rounded(_ALL_SUMS)}, " + ", ".join(f'"{n}"' for n in _ALL_COUNTS) + f", {_rounded(_SIZES + _RATES)} from rates",
    "rates"))
def agent_kpi_block(t):
    return tidy(agent_mart.agent_kpis(mart(t, KPI_PARTS), SNAPSHOT))


_CLAIM_SQL = f"""
select agt_cd, cast(count(distinct case when recent then clm_id end) as bigint) as claim_cnt_last_3_yr,
  round(cast(sum(case when recent then cast(clm_prvd_amt as decimal(28, 8)) else 0 end) as double), 6) as claim_amt_last_3_yr,
  cast(count(distinct case when recent and clm_stat_code = 'A' then clm_id end) as bigint) as claim_appr_cnt_last_3_yr,
  round(cast(sum(case when recent and clm_stat_code = 'A' then cast(clm_aprov_amt as decimal(28, 8)) else 0 end) as double), 6) as claim_appr_amt_last_3_yr,
  cast(count(distinct case when clm_recv_dt >= date '2000-06-30' and clm_stat_code = 'I' then clm_id end) as bigint) as claim_wip_last_1_yr,
  round(count(distinct case when recent and clm_stat_code = 'A' then clm_id end) / nullif(count(distinct case when recent then clm_id end), 0), 6)
    as claim_appr_rate_last_3_yr
from (select c.*, agt_cd, clm_recv_dt >= date '1998-06-30' as recent from claim c join policy_agent a on a.pol_num = c.pol_num
  where clm_recv_dt <= {DAY}) group by 1
having count(distinct case when recent then clm_id end) > 0
  or count(distinct case when clm_recv_dt >= date '2000-06-30' and clm_stat_code = 'I' then clm_id end) > 0"""


@query("claim_kpis", with_parts(_CLAIM_SQL, "claim", "policy_agent"))
def claim_kpis(t):
    return tidy(agent_mart.claim_kpis(t.claims(), agent_mart.policy_agents(mart(t, [])), SNAPSHOT))


_RISK_SQL = """select agt_cd, string_agg(cast(pol_num as varchar), ',' order by pol_num) as lps_pol_list
from (select agt_cd, s.pol_num, row_number() over (partition by agt_cd order by lapse_score desc, s.pol_num) as rn
  from lapse_score s join policy_agent a on a.pol_num = s.pol_num where lapse_score >= 0.05) where rn <= 3 group by 1"""


@query("topk_list_per_agent", with_parts(_RISK_SQL, "lapse_score", "policy_agent"))
def topk_list_per_agent(t):
    return tidy(agent_mart.risk_lists(t.lapse_scores(), agent_mart.policy_agents(mart(t, []))))


def _top_leads(t, m):
    return agent_mart.top_leads(t.leads(), agent_mart.approved_products(t.product_scores()), agent_mart.lead_owners(m))


@query("topk_per_agent", with_parts("""
select agt_cd, po_num, pol_num, health_base, inv_base, health_rider, riders, round(p_1, 6) as p_1 from top_lead""", "top_lead"))
def topk_per_agent(t):
    top = _top_leads(t, mart(t, []))
    return tidy(top.select("agt_cd", "po_num", "pol_num", "health_base", "inv_base", "health_rider", "riders", "p_1"))


_LEAD_SQL = """select agt_cd, string_agg(cast(pol_num as varchar), ',' order by pol_num) as cpm_pol_list
from (select distinct agt_cd, pol_num from top_lead where rn2 <= 3) group by 1"""


@query("lead_list_per_agent", with_parts(_LEAD_SQL, "top_lead"))
def lead_list_per_agent(t):
    return tidy(agent_mart.lead_lists(_top_leads(t, mart(t, []))))


_RANK = "cast(floor(rank() over (order by last_mth_ape desc) + (count(*) over (partition by last_mth_ape) - 1) / 2) as bigint)"
_KPI_RANK = f"select wa_code, round(last_mth_ape, 6) as last_mth_ape, {_RANK} as rank_of_last_mth_ape from kpi"


def _ranked(t):
    kpis = agent_mart.kpi_sums(mart(t, ["premium"]), SNAPSHOT, "ape").select("wa_code", F.round("last_mth_ape", 6).alias("last_mth_ape"))
    # Stored once: the ranks are looked up by value.
    return average_rank_desc(stage(kpis, new_folder(t.spark)), "last_mth_ape", "rank_of_last_mth_ape")


@query("avg_rank_floor", with_parts(_KPI_RANK, "kpi"))
def avg_rank_floor(t):
    return tidy(_ranked(t))


@query("leaderboard", with_parts(f"select * from ({_KPI_RANK}) where rank_of_last_mth_ape <= 10 and last_mth_ape <> 0", "kpi"))
def leaderboard(t):
    return tidy(agent_mart.leaderboard(_ranked(t).withColumnRenamed("wa_code", "agt_cd")).withColumnRenamed("agt_cd", "wa_code"))


_NEXT = " ".join(f"when '{a}' then '{b}'" for a, b in zip(codes.TIER_LADDER, (*codes.TIER_LADDER[1:], "TOT")))
_BENCH = " ".join(f"when '{a}' then {b}" for a, b in codes.TIER_BENCHMARKS.items())
GAP_SQL = f"""select agt_code, tier, next_tier, cast(bench as double) as next_tier_benchmark,
  {cut("case when bench - coalesce(ape_ytd, 0) < 0 then 0 else bench - coalesce(ape_ytd, 0) end")} as gap_to_next_tier
from (select *, case next_tier {_BENCH} end as bench from (select agt_code, tier, case tier {_NEXT} end as next_tier from master)) m
left join kpi k on k.wa_code = m.agt_code"""


@query("next_tier_gap", with_parts(GAP_SQL, "master", "kpi"))
def next_tier_gap(t):
    year = agent_mart.kpi_sums(mart(t, ["premium"]), SNAPSHOT, "ape").select(F.col("wa_code").alias("agt_code"), "ape_ytd")
    joined = agent_mart.with_next_tier(master(t).join(year, "agt_code", "left"))
    return tidy(joined.select("agt_code", "tier", "next_tier", "next_tier_benchmark", "gap_to_next_tier"))


@query("two_level_avg", with_parts("""
select date, cast(sum(s) // (count(*) * 100000000) as bigint) as avg_ape_tier from (
  select year_month as date, wa_code, cast(sum(cast(adjust_ape as decimal(28, 8))) * 100000000 as hugeint) as s from mart
  where last_n_month_eff_cvg between -12 and -1 and pol_stat_cd not in ('A', 'N', 'R') group by 1, 2) group by 1""", "mart"))
def two_level_avg(t):
    return tidy(agent_mart.average_sales(mart(t, ["premium"])))


@query("agent_month_sales", with_parts("""
select wa_code as agt_cd, year_month as date, round(cast(sum(cast(adjust_ape as decimal(28, 8))) as double), 6) as avg_ape_agt from mart
where last_n_month_eff_cvg between -12 and -1 and pol_stat_cd not in ('A', 'N', 'R') group by 1, 2""", "mart"))
def agent_month_sales(t):
    return tidy(agent_mart.monthly_sales(mart(t, ["premium"])))


@query("product_sales", with_parts("""
select type as prd_type, cast(trunc(sum(cast(adjust_ape as decimal(28, 8)))) as bigint) as sum_ape_tier from mart
where last_n_month_eff_cvg between -12 and -1 and pol_stat_cd not in ('A', 'N', 'R') group by 1""", "mart"))
def product_sales(t):
    return tidy(agent_mart.product_sales(mart(t, ["premium"])))


@query("agent_product_sales", with_parts("""
select wa_code as agt_cd, type as prd_type, round(cast(sum(cast(adjust_ape as decimal(28, 8))) as double), 6) as sum_ape_agt from mart
where last_n_month_eff_cvg between -12 and -1 and pol_stat_cd not in ('A', 'N', 'R') group by 1, 2""", "mart"))
def agent_product_sales(t):
    return tidy(agent_mart.product_sales(mart(t, ["premium"]), by_agent=True))


_CARD = ["last_yr_ape", "last_mth_ape", "last_12m_ape", "ape_ytd", "total_ape"]


def scorecard(t):
    stored = stored_mart(t)
    kpis = in_slices(t, "wa_code", lambda of_slice: agent_mart.agent_kpis(of_slice(stored), SNAPSHOT))
    return agent_mart.agent_scorecard(
        master(t), stored, t.claims(), t.lapse_scores(), t.leads(), t.product_scores(), SNAPSHOT, kpis
    )


@query("agent_scorecard", with_parts(f"""
select m.agt_code as agt_cd, m.agt_nm, m.tier, m.tenure_mth, m.no_sbw_completed, {_rounded(_CARD)}, "all_pol_cnt", "last_12m_prd",
  {cut_all('14m_per')}, claim_cnt_last_3_yr, claim_wip_last_1_yr, lps_pol_list, cpm_pol_list, next_tier, gap_to_next_tier,
  cast(floor(m.tenure_mth / 12) as integer) || 'y ' || (m.tenure_mth % 12) || 'm' as tenure_ym, '2001-06-30' as image_date
from master m join rates r on r.wa_code = m.agt_code left join ({_CLAIM_SQL}) c on c.agt_cd = m.agt_code
left join ({_RISK_SQL}) k on k.agt_cd = m.agt_code left join ({_LEAD_SQL}) l on l.agt_cd = m.agt_code
left join ({GAP_SQL}) g on g.agt_code = m.agt_code""", "master", "rates", "claim", "policy_agent", "lapse_score", "top_lead"))
def agent_scorecard(t):
    return tidy(scorecard(t).select(
        "agt_cd", "agt_nm", "tier", "tenure_mth", "no_sbw_completed", *_CARD, "all_pol_cnt", "last_12m_prd", "`14m_per`",
        "claim_cnt_last_3_yr", "claim_wip_last_1_yr", "lps_pol_list", "cpm_pol_list", "next_tier", "gap_to_next_tier",
        "tenure_ym", "image_date",
    ))
