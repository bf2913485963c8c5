"""Lookups, stars, range joins, unions."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query, tidy
from cohortloom.catalog.sql import DAY, MARGIN, QUARTER, months_between, with_parts
from cohortloom.catalog.windows import policy_types
from cohortloom.functions import codes, measures
from cohortloom.functions.calendar import fiscal_quarter
from cohortloom.operators import lookups
from cohortloom.plans import activation, agent_mart, client_mart
from cohortloom.sources.star_tables import SNAPSHOT


@query("policy_base_star", with_parts("""
select pol_num, po_num, plan_code, wa_code, cast(cvg_eff_dt as varchar) as cvg_eff_dt, type, customer_segment,
  round(agt_tenure_yrs, 6) as agt_tenure_yrs, cast(prem_dur_pre as bigint) as prem_dur_pre, cast(prem_dur_post as bigint) as prem_dur_post,
  cast(inforce_yr as bigint) as inforce_yr, cast(f_inforce_ind as bigint) as f_inforce_ind from base""", "base"))
def policy_base_star(t):
    base = client_mart.policy_base(t.coverage_lines(), t.policies(), SNAPSHOT, t.plans(), t.clients(), t.agents())
    return tidy(base.select(
        "pol_num", "po_num", "plan_code", "wa_code", "cvg_eff_dt", "type", "customer_segment", "agt_tenure_yrs",
        "prem_dur_pre", "prem_dur_post", "inforce_yr", "f_inforce_ind",
    ))


_TEXTS = {"ins_typ": ("INS_TYP", "ins_typ_desc"), "pmt_mode": ("PMT_MODE", "pmt_mode_desc"), "pol_stat_cd": ("POL_STAT", "pol_stat_desc")}


@query("base_star_texts", with_parts("""
select p.pol_num, case when p.pol_num % 20 <> 0 then p.po_num end as po_num, case when p.pol_num % 20 <> 0 then c.email_addr end as cli_email,
  case when a.agt_code is not null then 'L' || (a.agt_code % 10) end as loc_cd,
  case when a.agt_code % 10 in (0, 3, 6) then 'office ' || (a.agt_code % 10) end as office_cd,
  case when ins_typ is not null then 'Type ' || lower(ins_typ) end as ins_typ_desc,
  case pmt_mode when '12' then '1-urgent' when '06' then '2-high' when '03' then '3-medium' when '01' then '4-not specified' end as pmt_mode_desc,
  case when pol_stat_cd <> 'B' then 'Status ' || pol_stat_cd end as pol_stat_desc
from policy p left join policy_type y on y.pol_num = p.pol_num left join client c on c.cli_num = p.po_num left join agent a on a.agt_code = p.sell_code""",
                                      "policy", "policy_type", "client", "agent"))
def base_star_texts(t):
    """Policies with owner link, office and the texts of three codes from one table."""
    policies = t.policies().withColumnRenamed("sell_code", "agt_code").join(policy_types(t), "pol_num", "left")
    star = client_mart.base_star(policies, t.owner_links(), t.clients(), t.agents(), t.locations(), t.code_table(), _TEXTS)
    return tidy(star.select("pol_num", "po_num", "cli_email", "loc_cd", "office_cd", *[name for _, name in _TEXTS.values()]))


@query("composite_key_margin", with_parts(f"""
select l.qtr as effective_qtr, count(*) as coverages, count(quarter_margin) as priced, round(sum(cvg_prem * quarter_margin), 4) as value
from (select *, {QUARTER} as qtr from line) l
left join quarter_margin q on q.plan_code = l.plan_code and q.effective_qtr = l.qtr group by 1""", "line", "quarter_margin"))
def composite_key_margin(t):
    dated = t.coverage_lines().withColumn("effective_qtr", fiscal_quarter(F.col("cvg_eff_dt")))
    priced = dated.join(t.quarter_margins(), ["plan_code", "effective_qtr"], "left")
    return tidy(priced.groupBy("effective_qtr").agg(
        F.count(F.lit(1)).alias("coverages"), F.count("quarter_margin").alias("priced"),
        F.sum(F.col("cvg_prem") * F.col("quarter_margin")).alias("value"),
    ), 4)


_AGE = f"floor({months_between('l.cvg_eff_dt', 'm.effective_date')})"


@query("range_margin_join", with_parts(f"""
select l.pol_num, l.plan_code, l.wa_code, cast(l.cvg_eff_dt as varchar) as cvg_eff_dt, cast(m.effective_date as varchar) as effective_date,
  round(m.nbv_margin, 6) as nbv_margin
from line l join margin m on m.plan_code = l.plan_code and {_AGE} between 0 and 2""", "line", "margin"))
def range_margin_join(t):
    matched = lookups.rates_in_range(
        t.coverage_lines(), t.dated_margins(), "plan_code", "cvg_eff_dt", "effective_date", (0, 2), "inner"
    )
    return tidy(matched.select("pol_num", "plan_code", "wa_code", "cvg_eff_dt", "effective_date", "nbv_margin"))


@query("fallback_margin", with_parts("""
select l.pol_num, l.plan_code, l.wa_code, cast(l.cvg_eff_dt as varchar) as cvg_eff_dt, round(coalesce(dated_margin, plan_margin), 6) as nbv_margin
from line l left join plan p on p.plan_code = l.plan_code
left join dated d on d.plan_code = l.plan_code and d.cvg_eff_dt = l.cvg_eff_dt""", "line", "plan", "dated"))
def fallback_margin(t):
    dated = lookups.latest_rate(
        t.coverage_lines(), t.dated_margins(), "plan_code", "cvg_eff_dt", "effective_date", "nbv_margin", (0, 2), "dated"
    )
    priced = dated.join(t.plans(), "plan_code", "left").withColumn("nbv_margin", F.coalesce("dated", "plan_margin"))
    return tidy(priced.select("pol_num", "plan_code", "wa_code", "cvg_eff_dt", "nbv_margin"))


@query("channel_margin", with_parts(f"""
select dist_chnl_cd, office_cd, count(*) as coverages, round(avg(m), 6) as margin
from (select dist_chnl_cd, office_cd, {MARGIN} as m from (select *, {QUARTER} as qtr from cov) c
  left join plan_margin pm on pm.plan_code = c.plan_code
  left join quarter_margin q on q.plan_code = c.plan_code and q.effective_qtr = c.qtr) group by 1, 2""",
                                   "cov", "plan_margin", "quarter_margin"))
def channel_margin(t):
    joined = (
        t.coverages().withColumn("effective_qtr", fiscal_quarter(F.col("cvg_eff_dt")))
        .join(t.plan_margins(), "plan_code", "left").join(t.quarter_margins(), ["plan_code", "effective_qtr"], "left")
    )
    options = {f: F.coalesce(F.col(f), F.col("quarter_margin")) for f in client_mart.FAMILIES}
    margin = measures.channel_margin(F.col("loc_cd"), F.col("dist_chnl_cd"), options, client_mart.LOCATION_FAMILIES)
    return tidy(joined.withColumn("m", margin).groupBy("dist_chnl_cd", "office_cd").agg(
        F.count(F.lit(1)).alias("coverages"), F.mean("m").alias("margin")
    ))


@query("dual_role_dim", with_parts("""
select p.pol_num, o.cur_age as po_age, o.sex_code as po_gender, i.cur_age as in_age, i.sex_code as in_gender
from policy p left join client o on o.cli_num = p.po_num left join client i on i.cli_num = p.insrd_num""", "policy", "client"))
def dual_role_dim(t):
    joined = agent_mart.with_relation(t.policies(), t.clients())
    return tidy(joined.select("pol_num", "po_age", "po_gender", "in_age", "in_gender"))


@query("owner_lookup", with_parts("""
select po_num, wa_code from (select po_num, wa_code, row_number() over (partition by po_num order by cvg_eff_dt desc, wa_code) as rn
  from cov) where rn = 1""", "cov"))
def owner_lookup(t):
    return lookups.owner_of(t.coverages(), "po_num", "wa_code", "cvg_eff_dt")


@query("membership_flag", with_parts("""
select agt_code, cast(case when agt_code in (select wa_code from line where cvg_typ = 'R' and cvg_prem > 100000) then 1 else 0 end as bigint) as in_scope
from agent""", "agent", "line"))
def membership_flag(t):
    big = t.coverage_lines().where((F.col("cvg_typ") == "R") & (F.col("cvg_prem") > 100000))
    flagged = lookups.membership(t.agents(), big, {"agt_code": "wa_code"}, "in_scope")
    return tidy(flagged.select("agt_code", "in_scope"))


@query("renamed_key_join", """
select s_suppkey as agt_code, s_name as agt_nm, n_name as br_nm, r_name as rh_name
from supplier join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey""")
def renamed_key_join(t):
    named = lookups.attach(t.agents(), t.branches().withColumnRenamed("br_code", "BR_CODE_KEY"), {"br_code": "BR_CODE_KEY"}, "inner")
    return named.join(t.region_heads(), "rh_key", "left").select("agt_code", "agt_nm", "br_nm", "rh_name")


@query("manager_coalesce", """
select s_suppkey as agt_code, coalesce(case when s_suppkey % 2 = 0 then s_name end, case when s_suppkey % 3 = 0 then n_name end, r_name) as first_sm_name
from supplier left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey""")
def manager_coalesce(t):
    named = t.agents().join(t.branches(), "br_code", "left").join(t.region_heads(), "rh_key", "left")
    levels = named.select(
        "agt_code", F.when(F.col("agt_code") % 2 == 0, F.col("agt_nm")).alias("manager_name_0"),
        F.when(F.col("agt_code") % 3 == 0, F.col("br_nm")).alias("manager_name_1"), F.col("rh_name").alias("manager_name_2"),
    )
    return activation.first_manager(levels, ["manager_name_0", "manager_name_1", "manager_name_2"]).select("agt_code", "first_sm_name")


@query("union_scores", with_parts("select po_num, cast(min_decile as bigint) as min_decile from propensity", "propensity"))
def union_scores(t):
    return tidy(client_mart.best_propensity(t.existing_scores(), t.new_scores()))


_MONEY = "cast(sum(cast({} as decimal(18, 2))) as double)"


@query("stacked_aggregates", with_parts(f"""
select wa_code, riders_3y, rider_prem_3y, claims_3y, paid_1y, open_amt_1y
from (select wa_code, count(*) as riders_3y, {_MONEY.format("cvg_prem")} as rider_prem_3y from line
  where cvg_typ = 'R' and cvg_eff_dt <= {DAY} and cvg_eff_dt > date '1998-06-30' group by 1)
full join (select wa_code, count(*) as claims_3y from claim where clm_recv_dt <= {DAY} and clm_recv_dt > date '1998-06-30' group by 1) using (wa_code)
full join (select wa_code, {_MONEY.format("clm_aprov_amt")} as paid_1y from claim
  where clm_stat_code = 'A' and clm_recv_dt <= {DAY} and clm_recv_dt > date '2000-06-30' group by 1) using (wa_code)
full join (select wa_code, {_MONEY.format("clm_prvd_amt")} as open_amt_1y from claim
  where clm_stat_code = 'I' and clm_recv_dt <= {DAY} and clm_recv_dt > date '2000-06-30' group by 1) using (wa_code)""", "line", "claim"))
def stacked_aggregates(t):
    """Five aggregates of three and one years side by side; an agent may have any of them.

    Both kinds of facts go through one aggregation, so nothing is joined."""
    day, three, one = SNAPSHOT.column(), F.add_months(SNAPSHOT.column(), -36), F.add_months(SNAPSHOT.column(), -12)
    riders = t.coverage_lines().where((F.col("cvg_typ") == codes.RIDER_CODE) & (F.col("cvg_eff_dt") <= day) & (F.col("cvg_eff_dt") > three))
    claims = t.claims().where((F.col("clm_recv_dt") <= day) & (F.col("clm_recv_dt") > three))
    recent = F.col("clm_recv_dt") > one
    facts = riders.select("wa_code", F.lit(1).alias("rider"), F.col("cvg_prem").cast("decimal(18,2)").alias("prem")).unionByName(claims.select(
        "wa_code", F.lit(1).alias("claim"),
        F.when(recent & (F.col("clm_stat_code") == "A"), F.col("clm_aprov_amt")).cast("decimal(18,2)").alias("paid"),
        F.when(recent & (F.col("clm_stat_code") == "I"), F.col("clm_prvd_amt")).cast("decimal(18,2)").alias("unpaid"),
    ), allowMissingColumns=True)
    return tidy(facts.groupBy("wa_code").agg(
        F.sum("rider").alias("riders_3y"), F.sum("prem").cast("double").alias("rider_prem_3y"), F.sum("claim").alias("claims_3y"),
        F.sum("paid").cast("double").alias("paid_1y"), F.sum("unpaid").cast("double").alias("open_amt_1y"),
    ))


@query("policy_agent_pairs", with_parts("select pol_num, agt_cd from policy_agent", "policy_agent"))
def policy_agent_pairs(t):
    from cohortloom.catalog.agents import mart

    return agent_mart.policy_agents(mart(t, []))
