"""The activation study and the customer slicers, end to end."""

from pyspark.sql import functions as F

from cohortloom.catalog import agents as agent_queries
from cohortloom.catalog import clients as client_queries
from cohortloom.catalog.registry import query, tidy
from cohortloom.catalog.slicing import in_slices, whole
from cohortloom.catalog.selection import _BANDED_SQL, _MARITAL_SQL, _banded_clients
from cohortloom.catalog.sql import TYPES, band_sql, cut, with_parts, mean_sql
from cohortloom.catalog.totals import stats_sql
from cohortloom.functions import codes
from cohortloom.operators import reports
from cohortloom.operators.lookups import membership
from cohortloom.plans import activation, agent_mart, client_mart, slicers
from cohortloom.session import new_folder
from cohortloom.sources.sinks import stage
from cohortloom.sources.star_tables import SNAPSHOT, STUDY_CUSTOMERS, STUDY_MONTHS, STUDY_SCALE, study_units


def _stored(t, df):
    return stage(df, new_folder(t.spark))


def _agent_kpis(t, of_slice=whole):
    mart = agent_queries.mart(t, ["premium"], of_slice)
    return agent_mart.kpi_block(mart, SNAPSHOT, ["ape"], ["policy", "owner", "insured", "product", "lapsed", "not_taken", "rejected"])


def _agents(t, kpis=None):
    """Serving agents with KPIs, bands, activity and the target flag; ``kpis`` where they are stored already."""
    kpis = _agent_kpis(t) if kpis is None else kpis
    wide = agent_queries.master(t).join(
        agent_mart.with_quality_rates(kpis).withColumnRenamed("wa_code", "agt_code"), "agt_code"
    )
    return activation.with_target(activation.activity(activation.with_bands(study_units(wide), codes.AGENT_BANDS)))


_CASES = {
    "agt_tenure_mths": f"(tenure_mth - {STUDY_MONTHS})", "14m_per": '"14m_per"', "last_12m_prd": "last_12m_prd",
    "last_12m_ape": f"(last_12m_ape / {STUDY_SCALE})", "cus_existing": f"(total_cus % {STUDY_CUSTOMERS})", "no_sbw_completed": "no_sbw_completed",
}
_AGENT_SQL = "select m.*, r.* exclude (wa_code), " + ", ".join(
    f'{band_sql(value, *codes.AGENT_BANDS[c])} as "{c}_cat"' for c, value in _CASES.items()
) + """, case when last_9m_pol > 0 then 0 else 1 end as f_agt_inactive, case when last_mth_pol > 0 then '1mA' when last_3m_pol > 0 then '3mA'
  when last_6m_pol > 0 then '6mA' when last_9m_pol > 0 then '9mA' when last_12m_pol > 0 then '12mA' else '12m-Inactive' end as last_pol_cat
from master m join rates r on r.wa_code = m.agt_code"""
_STEPS = [
    "agt_tenure_mths_cat = '>1 year'", "last_12m_ape_cat in ('5-7k', '7-10k', '10k+')",
    "cus_existing_cat = '>2 customers'", "\"14m_per_cat\" = '70%+'",
]


def _passed(upto):
    return " and ".join(f"coalesce({s}, false)" for s in _STEPS[:upto]) or "true"


@query("target_flag", with_parts(f"""
select agt_code, agt_tenure_mths_cat, last_12m_ape_cat, cus_existing_cat, "14m_per_cat", last_12m_prd_cat, no_sbw_completed_cat,
  cast(case when {_passed(4)} then 1 else 0 end as bigint) as f_target_agent from ({_AGENT_SQL})""", "master", "rates"))
def target_flag(t):
    return tidy(_agents(t).select(
        "agt_code", "agt_tenure_mths_cat", "last_12m_ape_cat", "cus_existing_cat", "`14m_per_cat`", "last_12m_prd_cat",
        "no_sbw_completed_cat", "f_target_agent",
    ))


@query("activity_flag", with_parts(f"""
select agt_code, cast(f_agt_inactive as bigint) as f_agt_inactive, case when f_agt_inactive = 0 then 'Active' else 'Inactive' end as manager_0_active,
  last_pol_cat from ({_AGENT_SQL})""", "master", "rates"))
def activity_flag(t):
    return tidy(_agents(t).select("agt_code", "f_agt_inactive", "manager_0_active", "last_pol_cat"))


def _waterfall_sql(count, source, by):
    rows = []
    for i in range(1, len(_STEPS) + 1):
        before, after = count(_passed(i - 1)), count(_passed(i))
        rows.append(f"select {by}, cast({i} as bigint) as step, {before} - {after} as dropped, {after} as remaining from s group by {by}")
    return f"with s as ({source}) " + " union all ".join(rows)


@query("waterfall_rows", with_parts(
    "select * from (" + _waterfall_sql(
        lambda c: f"count(case when {c} then 1 end)", _AGENT_SQL, "f_agt_inactive"
    ).replace("select f_agt_inactive,", "select cast(f_agt_inactive as bigint) as f_agt_inactive,") + ")", "master", "rates"))
def waterfall_rows(t):
    return tidy(reports.waterfall(_agents(t), activation.target_conditions(), ["f_agt_inactive"]))


def _customers(t):
    """Clients next to the agent that serves them."""
    sold = t.sold_coverages(SNAPSHOT).withColumnRenamed("wa_code", "sa_code")
    people = t.clients().withColumnRenamed("cli_num", "po_num")
    return activation.customers_with_agents(people, activation.latest_servicing_agent(sold, people), _agents(t))


_SERVING = """select po_num, wa_code as sa_code from (select po_num, wa_code,
  row_number() over (partition by po_num order by pol_eff_dt desc, pol_num desc, wa_code) as rn from cov_then) where rn = 1"""
_CUSTOMER_SQL = f"""select c.cli_num as po_num, c.cur_age, c.no_dpnd, c.mthly_incm, s.sa_code, a.* exclude (agt_code)
from client c left join ({_SERVING}) s on s.po_num = c.cli_num left join ({_AGENT_SQL}) a on a.agt_code = s.sa_code"""


@query("waterfall_entities", with_parts(
    "select * from (" + _waterfall_sql(
        lambda c: f"count(distinct case when {c} then po_num end)", _CUSTOMER_SQL, "f_agt_inactive"
    ).replace("select f_agt_inactive,", "select cast(f_agt_inactive as bigint) as f_agt_inactive,") + ")",
    "client", "cov_then", "master", "rates"))
def waterfall_entities(t):
    return tidy(reports.entity_waterfall(_customers(t), "po_num", activation.target_conditions(), ["f_agt_inactive"]))


@query("in_scope_agents", with_parts(f"""
select a.agt_code, count(distinct s.po_num) as po_num_count, cast(1 as bigint) as in_scope
from master a join ({_SERVING}) s on s.sa_code = a.agt_code group by 1""", "master", "cov_then"))
def in_scope_agents(t):
    sold = t.sold_coverages(SNAPSHOT).withColumnRenamed("wa_code", "sa_code")
    people = t.clients().withColumnRenamed("cli_num", "po_num")
    scoped = activation.in_scope_agents(agent_queries.master(t), activation.latest_servicing_agent(sold, people))
    return tidy(scoped.select("agt_code", "po_num_count", "in_scope"))


@query("activation_profile", with_parts(f"""
select cast(f_agt_inactive as bigint) as f_agt_inactive, count(distinct po_num) as customers, {cut(mean_sql("no_dpnd"))} as no_dpnd,
  {cut(mean_sql("cur_age"))} as cur_age, {cut(mean_sql("mthly_incm"), 2)} as mthly_incm from ({_CUSTOMER_SQL}) group by 1""", "client", "cov_then", "master", "rates"))
def activation_profile(t):
    means = {"no_dpnd": "no_dpnd", "cur_age": "cur_age", "mthly_incm": "mthly_incm"}
    return tidy(reports.profile(_customers(t), ["f_agt_inactive"], "po_num", means, "customers", distinct=True), cents=("mthly_incm",))


@query("band_breakdown", with_parts(f"""
select agt_tenure_mths_cat, last_pol_cat, last_12m_ape_cat, cus_existing_cat, "14m_per_cat", count(distinct agt_code) as agents
from ({_AGENT_SQL}) where agt_tenure_mths_cat is not null and last_12m_ape_cat is not null and cus_existing_cat is not null
  and "14m_per_cat" is not null group by 1, 2, 3, 4, 5""", "master", "rates"))
def band_breakdown(t):
    bands = ["agt_tenure_mths_cat", "last_pol_cat", "last_12m_ape_cat", "cus_existing_cat", "14m_per_cat"]
    return tidy(reports.breakdown(_agents(t), bands, "agt_code", "agents"))


_METRICS = ["total_ape", "tenure_mth", "14m_per", "last_12m_prd", "last_12m_ape", "total_po", "all_pol_cnt"]


@query("percentile_segments", with_parts("""
select agt_code, case when total_po >= p.po75 or all_pol_cnt >= p.pol75 then 'Top Performers'
  when total_po >= p.po25 or all_pol_cnt >= p.pol25 then 'High Performers' else 'The Slackers' end as segment
from master m join rates r on r.wa_code = m.agt_code, (select quantile_cont(total_po, 0.75) as po75, quantile_cont(total_po, 0.25) as po25,
  quantile_cont(all_pol_cnt, 0.75) as pol75, quantile_cont(all_pol_cnt, 0.25) as pol25 from rates) p""", "master", "rates"))
def percentile_segments(t):
    # One row per agent, stored once for the thresholds and for the labels.
    agents = stage(_agents(t).select("agt_code", *[f"`{c}`" for c in _METRICS]), new_folder(t.spark))
    placed = activation.performance_segments(agents, _METRICS, ("total_po", "all_pol_cnt"))
    return placed.select("agt_code", "segment")


_SEGMENT_PARTS = """p as (select quantile_cont(total_po, 0.75) as po75, quantile_cont(total_po, 0.25) as po25,
  quantile_cont(all_pol_cnt, 0.75) as pol75, quantile_cont(all_pol_cnt, 0.25) as pol25 from rates),
s as (select agt_code, tenure_mth, total_po, all_pol_cnt, total_ape, case when total_po >= po75 or all_pol_cnt >= pol75 then 'Top Performers'
  when total_po >= po25 or all_pol_cnt >= pol25 then 'High Performers' else 'The Slackers' end as segment
  from master m join rates r on r.wa_code = m.agt_code, p)"""


@query("segment_summary", with_parts(
    f"select * from (with {_SEGMENT_PARTS} {' union all '.join(stats_sql('segment', c, 's') for c in ('tenure_mth', 'total_po', 'all_pol_cnt', 'total_ape'))})",
    "master", "rates"))
def segment_summary(t):
    agents = stage(_agents(t).select("agt_code", *[f"`{c}`" for c in _METRICS]), new_folder(t.spark))
    placed = activation.performance_segments(agents, _METRICS, ("total_po", "all_pol_cnt"))
    return tidy(reports.summary(placed, ["tenure_mth", "total_po", "all_pol_cnt", "total_ape"], ["segment"]), 4)


@query("ranked_agents", with_parts(f"select * from (with {_SEGMENT_PARTS} select distinct segment, agt_code as agt_cd, total_po, all_pol_cnt from s)",
                                   "master", "rates"))
def ranked_agents(t):
    agents = stage(_agents(t).select(F.col("agt_code").alias("agt_cd"), "total_po", "all_pol_cnt"), new_folder(t.spark))
    placed = activation.performance_segments(agents, ["total_po", "all_pol_cnt"], ("total_po", "all_pol_cnt"))
    return activation.ranked_agents(placed, ["agt_cd", "total_po", "all_pol_cnt"])


_COMPOSED = {"no_dpnd": "no_dpnd", "cur_age": "cur_age", "adj_mthly_incm": "mthly_incm"}
_COMPOSITION_SQL = " union all ".join(
    f"select f_agt_inactive, '{c}' as metric, {band_sql(source, codes.PROFILE_EDGES[c], include_lowest=False)} as band from ({_CUSTOMER_SQL})"
    for c, source in _COMPOSED.items()
)


@query("composition_by_activity", with_parts(f"""
select cast(f_agt_inactive as bigint) as f_agt_inactive, metric, band, count(*) as rows from ({_COMPOSITION_SQL}) group by 1, 2, 3""",
                                             "client", "cov_then", "master", "rates"))
def composition_by_activity(t):
    customers = _customers(t).withColumnRenamed("mthly_incm", "adj_mthly_incm")
    return tidy(reports.composition(customers, {c: codes.PROFILE_EDGES[c] for c in _COMPOSED}, ["f_agt_inactive"]))


_CAMPAIGN_BANDS = {
    "total_ape": "total_ape", "adj_mthly_incm": "mthly_incm", "no_dpnd": "no_dpnd", "clm_6m_cnt": "clm_6m_cnt",
    "ins_typ_count": "ins_typ_count", "cur_age": "cur_age", "gap_to_next_tier": "gap_to_next_tier",
}


_CAMPAIGN_SQL = f"""(
select *, case when mar_stat_cat in ('2. Married', '3. Unknown') and no_dpnd_cat in ('2', '3+') then '1. Family Guardians'
    when mar_stat_cat = '1. Married w/ kids' and no_dpnd_cat in ('1', '2', '3+') then '2. Mature Couples'
    when mar_stat_cat in ('2. Married', '3. Unknown') and no_dpnd_cat = '1' then '3. Younger Couples'
    when no_dpnd_cat = '0' then '4. Personal Protection Seekers' else '5. Unknown' end as "group",
  {band_sql("clm_6m_ratio", *codes.CUSTOMER_BANDS["clm_6m_ratio"])} as clm_6m_ratio_cat
from (select *, {_MARITAL_SQL} as mar_stat_cat, case when f_vip_elite = 1 then '1. Elite Platinum' when f_vip_plat = 1 then '2. Platinum'
    when f_vip_gold = 1 then '3. Gold' when f_vip_silver = 1 then '4. Silver' else '5. Unknown' end as cus_vip_cat,
    clm_6m_amt / round(total_ape, 4) as clm_6m_ratio,
    {", ".join(f"{band_sql(source, *codes.CUSTOMER_BANDS[c])} as {c}_cat" for c, source in _CAMPAIGN_BANDS.items())}
  from (select h.po_num, sa_code, which_prd, coalesce(clm_6m_cnt, 0) as clm_6m_cnt, coalesce(clm_6m_amt, 0) as clm_6m_amt, next_tier,
      coalesce(gap_to_next_tier, 0) as gap_to_next_tier, coalesce(all_pol_cnt, 0) as all_pol_cnt, total_ape, mthly_incm, no_dpnd,
      ins_typ_count, cur_age, dpnd_child_ind, dpnd_spouse_ind, f_vip_elite, f_vip_plat, f_vip_gold, f_vip_silver,
      segmentation_rules, coalesce("protection_income%", 0) as "protection_income%", client_tenure
    from holding h join client c on c.cli_num = h.po_num left join ({_SERVING}) s on s.po_num = h.po_num
    left join product p on p.po_num = h.po_num
    left join (select po_num, cast(sum(cnt) as bigint) as clm_6m_cnt, cast(sum(amt) as double) / {codes.FX_RATE} as clm_6m_amt from (
        select pol_num, cast(count(*) as bigint) as cnt, sum(cast(clm_aprov_amt as decimal(28, 8))) as amt from claim where clm_aprov_dt > date '2000-12-30'
          and clm_aprov_dt <= date '2001-06-30' and clm_stat_code = 'A' and clm_code in ({", ".join(map(str, codes.CLAIM_CODES))}) group by 1)
      join (select pol_num, po_num from policy where pol_stat_cd not in ('A', 'N', 'R')) using (pol_num) group by 1) k on k.po_num = h.po_num
    left join ({agent_queries.GAP_SQL}) g on g.agt_code = s.sa_code left join (select wa_code, all_pol_cnt from kpi) r on r.wa_code = s.sa_code
    where total_ape > 0 and h.po_num not in (select s_suppkey * 13 from supplier))))"""
_CAMPAIGN_PARTS = ("holding", "client", "cov_then", "product", "claim", "policy", "master", "kpi")


def _campaign(t):
    """Customers with premium who are no agents, with every slicer."""
    sold = t.sold_coverages(SNAPSHOT).withColumnRenamed("wa_code", "sa_code")
    people = t.clients().withColumnsRenamed({"cli_num": "po_num", "mthly_incm": "adj_mthly_incm"})
    held = client_mart.client_holdings(client_queries.stored_summary(t), SNAPSHOT, TYPES)
    customers = membership(held.join(people, "po_num"), t.agents(), {"po_num": "own_cli_num"}, "f_owner_is_agent")
    customers = customers.join(_stored(t, activation.latest_servicing_agent(sold, people)), "po_num", "left")
    mart = agent_queries.stored_mart(t, ["premium"])
    kpis = in_slices(t, "wa_code", lambda of_slice: agent_mart.kpi_block(of_slice(mart), SNAPSHOT, ["ape"], ["policy"]))
    tiers = agent_queries.master(t).select(F.col("agt_code").alias("agt_cd"), "tier").join(
        kpis.select(F.col("wa_code").alias("agt_cd"), "ape_ytd", "all_pol_cnt"), "agt_cd", "left"
    )
    agents = agent_mart.with_next_tier(tiers).select("agt_cd", "next_tier", "gap_to_next_tier", "all_pol_cnt")
    agent_of_policy = t.policies().join(agent_mart.policy_agents(mart).withColumnRenamed("agt_cd", "wa_code"), "pol_num")
    return slicers.campaign_base(
        customers, agent_mart.approved_products(t.product_scores()), _stored(t, slicers.claims_last_6m(t.claims(), t.policies(), SNAPSHOT)),
        agents, _stored(t, slicers.agent_premium(agent_of_policy, SNAPSHOT)),
    )


@query("campaign_base", with_parts(f"""
select po_num, sa_code, which_prd, clm_6m_cnt, round(clm_6m_amt, 2) as clm_6m_amt, round(clm_6m_ratio, 6) as clm_6m_ratio, next_tier,
  {cut("gap_to_next_tier")} as gap_to_next_tier, all_pol_cnt, mar_stat_cat, cus_vip_cat, "group",
  {", ".join(f"{c}_cat" for c in _CAMPAIGN_BANDS)} from {_CAMPAIGN_SQL}""", *_CAMPAIGN_PARTS))
def campaign_base(t):
    shown = _campaign(t).select(
        "po_num", "sa_code", "which_prd", "clm_6m_cnt", "clm_6m_amt", "clm_6m_ratio", "next_tier", "gap_to_next_tier", "all_pol_cnt",
        "mar_stat_cat", "cus_vip_cat", "group", *[f"{c}_cat" for c in _CAMPAIGN_BANDS],
    )
    return tidy(shown, cents=("clm_6m_amt",))


_REPORT_COLUMNS = list(dict.fromkeys(c for bands in slicers.BREAKDOWNS.values() for c in bands))
_REPORT_SQL = f"""(select *, {band_sql("cur_age", codes.PROFILE_EDGES["cur_age"], include_lowest=False)} as age_grp,
  {band_sql("client_tenure", codes.PROFILE_EDGES["client_tenure"], include_lowest=False)} as tenure_grp,
  case when "protection_income%" <= 50 then 'protected' when "protection_income%" > 50 then 'gap' end as protection_income_grp,
  {band_sql('"protection_income%"', *codes.PROTECTION_BANDS["protection_income%"])} as "protection_income%_cat" from {_CAMPAIGN_SQL})"""


def _report_sql(report):
    bands = slicers.BREAKDOWNS[report]
    shown = ", ".join(f'"{c}"' if c in bands else f'cast(null as varchar) as "{c}"' for c in _REPORT_COLUMNS)
    filled = " and ".join(f'"{c}" is not null' for c in bands)
    grouped = ", ".join(f'"{c}"' for c in bands)
    return f"select '{report}' as report, {shown}, count(distinct po_num) as customers from s where {filled} group by {grouped}"


@query("slicer_reports", with_parts(
    f"select * from (with s as {_REPORT_SQL} {' union all '.join(_report_sql(r) for r in slicers.BREAKDOWNS)})", *_CAMPAIGN_PARTS))
def slicer_reports(t):
    """Customers by six, ten and four bands, counted from one reading of the campaign base."""
    return reports.breakdowns(slicers.with_report_bands(_campaign(t)), slicers.BREAKDOWNS, "po_num", "customers")


@query("family_groups", with_parts(f"""
select mar_stat_cat, cus_vip_cat, "group", count(*) as clients from (
  select *, case when mar_stat_cat in ('2. Married', '3. Unknown') and no_dpnd_cat in ('2', '3+') then '1. Family Guardians'
    when mar_stat_cat = '1. Married w/ kids' and no_dpnd_cat in ('1', '2', '3+') then '2. Mature Couples'
    when mar_stat_cat in ('2. Married', '3. Unknown') and no_dpnd_cat = '1' then '3. Younger Couples'
    when no_dpnd_cat = '0' then '4. Personal Protection Seekers' else '5. Unknown' end as "group",
    case when f_vip_elite = 1 then '1. Elite Platinum' when f_vip_plat = 1 then '2. Platinum' when f_vip_gold = 1 then '3. Gold'
      when f_vip_silver = 1 then '4. Silver' else '5. Unknown' end as cus_vip_cat
  from (select *, {_MARITAL_SQL} as mar_stat_cat from ({_BANDED_SQL}))) group by 1, 2, 3""", "client", "holding"))
def family_groups(t):
    banded = _banded_clients(t)
    grouped = slicers.with_family_groups(banded)
    return grouped.groupBy("mar_stat_cat", "cus_vip_cat", "group").agg(F.count(F.lit(1)).alias("clients"))


_GROUP = """case when dpnd_child_ind = 0 and no_dpnd in (2, 3) then '1. Family Guardians'
  when dpnd_child_ind = 1 and no_dpnd in (1, 2, 3) then '2. Mature Couples'
  when dpnd_child_ind = 0 and no_dpnd = 1 then '3. Younger Couples'
  when no_dpnd = 0 then '4. Personal Protection Seekers' else '5. Unknown' end"""


_GROUPED = f"""(select *, {_GROUP} as "group" from client)"""


@query("family_group_summary", with_parts(
    " union all ".join(stats_sql('"group"', c, _GROUPED) for c in ("cur_age", "mthly_incm")), "client"))
def family_group_summary(t):
    grouped = slicers.with_family_groups(_banded_clients(t))
    return tidy(reports.summary(grouped, ["cur_age", "mthly_incm"], ["group"]), 4)


@query("slicer_breakdown", with_parts(f"""
select mar_stat_cat, no_dpnd_cat, adj_mthly_incm_cat, cur_age_cat, count(distinct cli_num) as customers
from (select *, {_MARITAL_SQL} as mar_stat_cat from ({_BANDED_SQL}))
where no_dpnd_cat is not null and adj_mthly_incm_cat is not null and cur_age_cat is not null group by 1, 2, 3, 4""", "client", "holding"))
def slicer_breakdown(t):
    grouped = slicers.with_family_groups(_banded_clients(t))
    return reports.breakdown(grouped, ["mar_stat_cat", "no_dpnd_cat", "adj_mthly_incm_cat", "cur_age_cat"], "cli_num", "customers")


# The study of target agents: profiles and compositions of the customers that they serve.
_MEANS = {
    "no_dpnd": "no_dpnd", "cur_age": "cur_age", "adj_mthly_incm": "adj_mthly_incm", "client_tenure": "client_tenure",
    "inforce_pol": "inforce_pol", "total_ape": "total_ape", "rider_cnt": "rider_cnt",
}
_STUDY_SQL = f"""(select h.po_num, h.client_tenure, h.inforce_pol, h.total_ape, coalesce(d.rider_cnt, 0) as rider_cnt, c.no_dpnd, c.cur_age,
  c.mthly_incm as adj_mthly_incm, n.n_name as city, s.sa_code, a.f_agt_inactive, case when {_passed(4)} then 1 else 0 end as f_target
from holding h join client c on c.cli_num = h.po_num left join nation n on n.n_nationkey = c.city_key
left join (select po_num, count(*) as rider_cnt from cov_then where cvg_typ = 'R' group by 1) d on d.po_num = h.po_num
join ({_SERVING}) s on s.po_num = h.po_num join ({_AGENT_SQL}) a on a.agt_code = s.sa_code)"""
_STUDY_PARTS = ("holding", "client", "cov_then", "master", "rates")


def _study_customers(t):
    """Customers of the agents in the study with holdings, riders, city and the agents' flags."""
    held = client_mart.client_holdings(client_queries.stored_summary(t), SNAPSHOT, TYPES).select("po_num", "client_tenure", "inforce_pol", "total_ape")
    cities = t.branches().select(F.col("br_code").alias("city_key"), F.col("br_nm").alias("city"))
    people = t.clients().join(cities, "city_key", "left").select(F.col("cli_num").alias("po_num"), "no_dpnd", "cur_age", F.col("mthly_incm").alias("adj_mthly_incm"), "city")
    riders = _stored(t, activation.rider_counts(t.coverage_lines(), t.policies(), SNAPSHOT))
    customers = _stored(t, held.join(people, "po_num").join(riders, "po_num", "left").fillna(0, subset=["rider_cnt"]))
    sold = t.sold_coverages(SNAPSHOT).withColumnRenamed("wa_code", "sa_code")
    servicing = _stored(t, activation.latest_servicing_agent(sold, customers))
    agents = _agents(t, in_slices(t, "wa_code", lambda of_slice: _agent_kpis(t, of_slice))).select("agt_code", "f_agt_inactive", "f_target_agent")
    served = activation.customers_with_agents(customers, servicing, agents)
    return _stored(t, served.where("f_target_agent is not null"))


def _mean_columns():
    return ", ".join(f"{cut(mean_sql(c), 2)} as {c}" for c in _MEANS)


@query("target_profile", with_parts(f"""
select * from (with s as {_STUDY_SQL}
select 'target' as scope, cast(1 as bigint) as f_target_agent, cast(null as bigint) as f_agt_inactive, count(distinct po_num) as customers, {_mean_columns()}
  from s where f_target = 1 having count(*) > 0
union all select 'all', null, cast(f_agt_inactive as bigint), count(distinct po_num), {_mean_columns()} from s group by f_agt_inactive
union all select 'both', cast(f_target as bigint), cast(f_agt_inactive as bigint), count(distinct po_num), {_mean_columns()} from s group by f_target, f_agt_inactive)""",
                                       *_STUDY_PARTS))
def target_profile(t):
    """Seven means of the customers of target agents, of all agents by activity, and by both flags."""
    customers = _study_customers(t)
    scopes = {"target": (customers.where("f_target_agent = 1"), ["f_target_agent"]), "all": (customers, ["f_agt_inactive"]), "both": (customers, ["f_target_agent", "f_agt_inactive"])}
    parts = [
        reports.profile(df, by, "po_num", _MEANS, "customers", distinct=True).select(
            F.lit(scope).alias("scope"), *[(F.col(c) if c in by else F.lit(None).cast("int")).alias(c) for c in ("f_target_agent", "f_agt_inactive")], "customers", *_MEANS,
        ) for scope, (df, by) in scopes.items()
    ]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]), 2)


_STUDY_BANDS = " union all ".join(
    f"select f_target, f_agt_inactive, '{c}' as metric, {band_sql(c, codes.PROFILE_EDGES[c], include_lowest=False)} as band from s" for c in codes.PROFILE_EDGES
)


@query("target_compositions", with_parts(f"""
select cast(f_target as bigint) as f_target_agent, cast(f_agt_inactive as bigint) as f_agt_inactive, metric, band, count(*) as rows
from (with s as {_STUDY_SQL} {_STUDY_BANDS}) group by all""", *_STUDY_PARTS))
def target_compositions(t):
    """Seven compositions of customers by both flags of their agent, from one reading."""
    return tidy(reports.composition(_study_customers(t), codes.PROFILE_EDGES, ["f_target_agent", "f_agt_inactive"]))


@query("top_cities_by_activity", with_parts(f"""
select * from (with s as {_STUDY_SQL},
r as (select f_target, f_agt_inactive, city, row_number() over (partition by f_target, f_agt_inactive order by count(*) desc, city) as place
  from s where city is not null group by 1, 2, 3)
select cast(s.f_target as bigint) as f_target_agent, cast(s.f_agt_inactive as bigint) as f_agt_inactive,
  case when s.city is null then null when r.city is null then 'Other' else s.city end as city_grouped, count(*) as customers
from s left join r on r.place <= 15 and r.city = s.city and r.f_target = s.f_target and r.f_agt_inactive = s.f_agt_inactive group by all)""", *_STUDY_PARTS))
def top_cities_by_activity(t):
    """The 15 most frequent cities of each kind of agents, the others together."""
    by = ["f_target_agent", "f_agt_inactive"]
    named = reports.rest_to_other_by(_study_customers(t), by, "city", 15)
    return tidy(named.groupBy(*by, "city_grouped").agg(F.count(F.lit(1)).alias("customers")))


_BANDED_AGENTS = {"1yr_agent_activeness": '"1yr_agent_activeness"', "po_num_count": "po_num_count", "all_pol_cnt": "all_pol_cnt"}


@query("banded_agents", with_parts(f"""
select agt_code as agt_cd, segment, po_num_count, all_pol_cnt, {", ".join(f'{band_sql(v, *codes.SEGMENT_BANDS[c])} as "{c}_cat"' for c, v in _BANDED_AGENTS.items())}
from (select *, case when po_num_count >= po75 or all_pol_cnt >= pol75 then 'Top Performers'
    when po_num_count >= po25 or all_pol_cnt >= pol25 then 'High Performers' else 'The Slackers' end as segment
  from a, (select quantile_cont(po_num_count, 0.75) as po75, quantile_cont(po_num_count, 0.25) as po25,
    quantile_cont(all_pol_cnt, 0.75) as pol75, quantile_cont(all_pol_cnt, 0.25) as pol25 from a))""".replace("from a,", "from served a,").replace("from a)", "from served)"),
    "served"))
def banded_agents(t):
    """Agents in scope with their segment and the bands of the agent report."""
    sold = t.sold_coverages(SNAPSHOT).withColumnRenamed("wa_code", "sa_code")
    people = t.clients().withColumnRenamed("cli_num", "po_num")
    counts = agent_mart.kpi_counts(agent_queries.mart(t, []), SNAPSHOT, "policy").select(F.col("wa_code").alias("agt_code"), "all_pol_cnt")
    scoped = activation.in_scope_agents(agent_queries.master(t), activation.latest_servicing_agent(sold, people))
    agents = stage(
        scoped.join(counts, "agt_code").join(t.activeness(), "agt_code").select(F.col("agt_code").alias("agt_cd"), "po_num_count", "all_pol_cnt", "1yr_agent_activeness"),
        new_folder(t.spark),
    )
    placed = activation.with_bands(activation.performance_segments(agents, ["po_num_count", "all_pol_cnt"]), codes.SEGMENT_BANDS)
    shown = activation.ranked_agents(placed, ["agt_cd", "po_num_count", "all_pol_cnt", *[f"`{c}_cat`" for c in codes.SEGMENT_BANDS]])
    return tidy(shown)
