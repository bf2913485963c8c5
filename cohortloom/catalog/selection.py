"""Scans, filters, flags, bands and fills."""

from pyspark.sql import functions as F

from cohortloom.catalog import clients as client_queries
from cohortloom.catalog.registry import query, tidy
from cohortloom.catalog.sql import ADJUSTED, DAY, QUARTER, TYPES, band_sql, months_between, quoted, with_parts
from cohortloom.functions import codes, measures
from cohortloom.functions.bands import argmax_label, band, decode, first_match, flag
from cohortloom.functions.calendar import (
    fiscal_quarter,
    month_end,
    month_offset,
    previous_due,
    tenure_text,
    whole_months,
    whole_years,
)
from cohortloom.operators import cleaning, lookups, reports
from cohortloom.plans import activation, agent_mart, client_mart, slicers
from cohortloom.sources.star_tables import SNAPSHOT
from cohortloom.sources.tables import in_snapshot_month


@query("snapshot_scan_filter", with_parts(f"""
select pol_num, po_num, tot_ape, '2001-06-30' as image_date from policy
where last_day(pol_eff_dt) = {DAY}""", "policy"))
def snapshot_scan_filter(t):
    # Dated rows without a partition column: the month is a range of days, which reaches the scan.
    kept = in_snapshot_month(t.policies(), SNAPSHOT, "pol_eff_dt").withColumn("image_date", month_end(F.col("pol_eff_dt")))
    return tidy(kept.select("pol_num", "po_num", "tot_ape", "image_date"))


@query("distinct_dedupe", with_parts("select distinct po_num, pmt_mode, pol_stat_cd from policy", "policy"))
def distinct_dedupe(t):
    return t.policies().select("po_num", "pmt_mode", "pol_stat_cd").distinct()


@query("semi_filter", with_parts("""
select pol_num, plan_code, cvg_prem from line where plan_code in (select plan_code from plan where sp_ind = 1)""",
                                 "line", "plan"))
def semi_filter(t):
    single = t.plans().where(F.col("sp_ind") == 1)
    return lookups.keep_known(t.coverage_lines(), single, {"plan_code": "plan_code"}).select("pol_num", "plan_code", "cvg_prem")


@query("anti_filter", with_parts("""
select pol_num, po_num from policy where pol_num not in (select pol_num from line)""", "policy", "line"))
def anti_filter(t):
    return lookups.keep_unknown(t.policies(), t.coverage_lines(), {"pol_num": "pol_num"}).select("pol_num", "po_num")


@query("status_flags", with_parts("select pol_num, " + ", ".join(
    f"cast(case when pol_stat_cd in ({quoted(m)}) then 1 else 0 end as bigint) as f_{n}_ind"
    for n, m in codes.STATUS_CODES.items()) + " from policy", "policy"))
def status_flags(t):
    flags = measures.status_flags(F.col("pol_stat_cd"))
    return tidy(t.policies().select("pol_num", *[c.alias(n) for n, c in flags.items()]))


@query("case_decode", with_parts("""
select pol_num, case cast(pmt_mode as integer) when 1 then 'monthly' when 3 then 'quarterly' when 6 then 'half-yearly'
  when 12 then 'yearly' end as pmt_mode_desc from policy""", "policy"))
def case_decode(t):
    return t.policies().select("pol_num", decode(F.col("pmt_mode").cast("int"), codes.PAYMENT_MODES).alias("pmt_mode_desc"))


@query("pattern_flags", with_parts("""
select pol_num, cast(case when loc_cd like 'TCB%' then 1 else 0 end as bigint) as f_tcb,
  cast(case when loc_cd like '%03' then 1 else 0 end as bigint) as f_oth, cast(case when loc_cd is null or loc_cd = '' then 1 else 0 end as bigint) as f_none
from policy""", "policy"))
def pattern_flags(t):
    place = F.col("loc_cd")
    return tidy(t.policies().select(
        "pol_num", flag(place.startswith("TCB")).alias("f_tcb"), flag(place.like("%03")).alias("f_oth"),
        flag(place.isNull() | (place == "")).alias("f_none"),
    ))


@query("date_range_filter", with_parts(f"""
select pol_num, cast(pol_eff_dt as varchar) as pol_eff_dt from policy
where pol_eff_dt > date '2001-03-31' and pol_eff_dt <= {DAY}""", "policy"))
def date_range_filter(t):
    day = F.col("pol_eff_dt")
    kept = t.policies().where((day > F.lit(SNAPSHOT.month_end(3))) & (day <= SNAPSHOT.column()))
    return tidy(kept.select("pol_num", "pol_eff_dt"))


@query("equality_flags", """
select c_custkey as cli_num, cast(case when n_name = 'NATION_0' then 1 else 0 end as bigint) as f_first,
  cast(case when n_name = 'NATION_1' then 1 else 0 end as bigint) as f_second,
  cast(case when n_name not in ('NATION_0', 'NATION_1') then 1 else 0 end as bigint) as f_oth_city
from customer left join nation on n_nationkey = c_nationkey""")
def equality_flags(t):
    cities = client_mart.city_flags(F.col("br_nm"), {"f_first": "NATION_0", "f_second": "NATION_1"})
    joined = lookups.attach(t.clients(), t.branches().select("br_code", "br_nm"), {"city_key": "br_code"})
    return tidy(joined.select("cli_num", *[c.alias(n) for n, c in cities.items()]))


@query("column_compare_flag", with_parts("""
select pol_num, cast(case when po_num = insrd_num then 1 else 0 end as bigint) as po_is_cli from policy""", "policy"))
def column_compare_flag(t):
    return tidy(t.policies().select("pol_num", flag(F.col("po_num") == F.col("insrd_num")).alias("po_is_cli")))


def _banded_clients(t):
    """Clients with the bands of their age, income, dependants and holdings at the snapshot."""
    vip = ["f_vip_elite", "f_vip_plat", "f_vip_gold", "f_vip_silver"]
    held = client_mart.client_holdings(client_queries.summary(t), SNAPSHOT, TYPES).select("po_num", "total_ape", "ins_typ_count", *vip)
    people = lookups.attach(t.clients().withColumn("adj_mthly_incm", F.col("mthly_incm")), held, {"cli_num": "po_num"})
    return activation.with_bands(people, codes.CUSTOMER_BANDS)


_BANDED = {
    "total_ape": "total_ape", "adj_mthly_incm": "mthly_incm", "no_dpnd": "no_dpnd",
    "ins_typ_count": "ins_typ_count", "cur_age": "cur_age",
}
_BANDED_SQL = "select cli_num, dpnd_child_ind, dpnd_spouse_ind, total_ape, ins_typ_count, f_vip_elite, f_vip_plat, f_vip_gold, f_vip_silver, " + ", ".join(
    f'{band_sql(source, *codes.CUSTOMER_BANDS[c])} as "{c}_cat"' for c, source in _BANDED.items()
) + " from client left join holding on po_num = cli_num"
_BAND_COLUMNS = [f"{c}_cat" for c in _BANDED]


@query("band_labels", with_parts(f"select cli_num, {', '.join(_BAND_COLUMNS)} from ({_BANDED_SQL})", "client", "holding"))
def band_labels(t):
    return _banded_clients(t).select("cli_num", *_BAND_COLUMNS)


_MARITAL_SQL = """case when dpnd_child_ind = 1 then '1. Married w/ kids' when dpnd_spouse_ind = 1 then '2. Married' else '3. Unknown' end"""


@query("condition_chain", with_parts(f"select cli_num, {_MARITAL_SQL} as mar_stat_cat from client", "client"))
def condition_chain(t):
    cases = [(F.col("dpnd_child_ind") == 1, codes.MARITAL_LABELS[0]), (F.col("dpnd_spouse_ind") == 1, codes.MARITAL_LABELS[1])]
    return t.clients().select("cli_num", first_match(cases, codes.MARITAL_LABELS[2]).alias("mar_stat_cat"))


_VIP_TOTAL = f"select po_num, sum(tot_ape) / {codes.FX_RATE} / 20 as total_ape, sum(case when pol_eff_dt < date '1996-01-01' then 1 else 0 end) as old from policy group by 1"
_B = codes.VIP_BOUNDS


@query("vip_tiers", with_parts(f"""
select po_num, cast(case when total_ape >= {_B['elite']} then 1 else 0 end as bigint) as f_vip_elite,
  cast(case when total_ape >= {_B['plat']} and total_ape < {_B['elite']} then 1 else 0 end as bigint) as f_vip_plat,
  cast(case when total_ape >= {_B['gold']} and total_ape < {_B['plat']} then 1 else 0 end as bigint) as f_vip_gold,
  cast(case when total_ape >= {_B['silver']} and total_ape < {_B['gold']} and old >= 1 then 1 else 0 end as bigint) as f_vip_silver
from ({_VIP_TOTAL})""", "policy"))
def vip_tiers(t):
    totals = t.policies().groupBy("po_num").agg(
        (F.sum("tot_ape") / codes.FX_RATE / 20).alias("total_ape"),
        F.sum(flag(F.col("pol_eff_dt") < "1996-01-01")).alias("old"),
    )
    flags = measures.vip_flags(F.col("total_ape"), F.col("old"))
    return tidy(totals.select("po_num", *[c.alias(n) for n, c in flags.items()]))


@query("recency_label", with_parts("""
select wa_code, case when last_mth_pol > 0 then '1mA' when last_3m_pol > 0 then '3mA' when last_6m_pol > 0 then '6mA'
  when last_9m_pol > 0 then '9mA' when last_12m_pol > 0 then '12mA' else '12m-Inactive' end as last_pol_cat from kpi""", "kpi"))
def recency_label(t):
    from cohortloom.catalog.agents import mart

    counts = agent_mart.kpi_counts(mart(t, []), SNAPSHOT, "policy")
    return counts.select("wa_code", activation.recency().alias("last_pol_cat"))


@query("ordinal_tier", with_parts("select agt_code, tier, cast(case tier " + " ".join(
    f"when '{name}' then {place}" for place, name in enumerate(codes.TIER_LADDER, 1)
) + " else 0 end as bigint) as f_current_tier from master", "master"))
def ordinal_tier(t):
    from cohortloom.catalog.agents import master

    return tidy(master(t).select("agt_code", "tier", activation.tier_place().alias("f_current_tier")))


@query("small_category_others", """
select case when k >= 60 then n_name else 'Others' end as br_grouped, cast(sum(k) as bigint) as agents
from (select n_name, count(*) as k from customer join nation on n_nationkey = c_nationkey group by 1) group by 1""")
def small_category_others(t):
    named = lookups.attach(t.clients(), t.branches().select("br_code", "br_nm"), {"city_key": "br_code"}, "inner")
    grouped = reports.small_to_others(named, "br_nm", 60, name="br_grouped")
    return reports.frequency(grouped, "br_grouped", name="agents")


@query("top_category_other", """
with counts as (select n_name, count(*) as k from customer join nation on n_nationkey = c_nationkey group by 1),
ranked as (select *, row_number() over (order by k desc, n_name) as rn from counts)
select case when rn <= 15 then n_name else 'Other' end as city_grouped, cast(sum(k) as bigint) as clients from ranked group by 1""")
def top_category_other(t):
    named = lookups.attach(t.clients(), t.branches().select("br_code", "br_nm"), {"city_key": "br_code"}, "inner")
    grouped = reports.rest_to_other(named, "br_nm", 15, name="city_grouped")
    return reports.frequency(grouped, "city_grouped", name="clients")


@query("typed_fill", with_parts("""
select p.pol_num, coalesce(n, 0) as lines, coalesce(prem, 0.0) as premium, coalesce(kind, 'N/A') as kind
from policy p left join (select pol_num, count(*) as n, round(sum(cvg_prem), 6) as prem, max(cvg_typ) as kind from line group by 1) l
on l.pol_num = p.pol_num""", "policy", "line"))
def typed_fill(t):
    lines = t.coverage_lines().groupBy("pol_num").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("cvg_prem").alias("premium"), F.max("cvg_typ").alias("kind")
    )
    joined = t.policies().select("pol_num").join(lines, "pol_num", "left")
    return tidy(cleaning.fill_by_type(joined, 0, "N/A", skip=["pol_num"]))


@query("decimal_cast", with_parts("""
select pol_num, round(tot_ape, 2) as tot_ape, round(tot_ape * 12, 2) as yearly from policy""", "policy"))
def decimal_cast(t):
    exact = t.policies().select(
        "pol_num", F.col("tot_ape").cast("decimal(18,2)").alias("tot_ape"),
        (F.col("tot_ape") * 12).cast("decimal(18,2)").alias("yearly"),
    )
    return tidy(cleaning.decimals_to_double(exact), 2)


@query("sentinel_fill", with_parts("""
select o_orderkey as pol_num, coalesce(lapse_score, 99.0) as lapse_score, cast(coalesce(decile, 99) as bigint) as decile
from orders left join lapse_score on pol_num = o_orderkey""", "lapse_score"))
def sentinel_fill(t):
    joined = t.policies().select("pol_num").join(t.lapse_scores(), "pol_num", "left")
    return tidy(cleaning.fill_values(joined, {"lapse_score": 99.0, "decile": 99}))


@query("numbers_from_text", with_parts("""
select pol_num, try_cast(pol_stat_cd as bigint) as code, try_cast(pmt_mode as bigint) as months from policy""", "policy"))
def numbers_from_text(t):
    typed = cleaning.numbers_from_text(t.policies().select("pol_num", "pol_stat_cd", "pmt_mode"), ["pol_stat_cd", "pmt_mode"])
    return tidy(typed.withColumnsRenamed({"pol_stat_cd": "code", "pmt_mode": "months"}))


# Derived measures.

@query("adjusted_ape", with_parts(f"""
select pol_num, plan_code, wa_code, cast(cvg_eff_dt as varchar) as cvg_eff_dt, round(cvg_prem, 6) as cvg_prem, round(ape, 6) as ape,
  round({ADJUSTED}, 6) as adjust_ape from prem""", "prem"))
def adjusted_ape(t):
    priced = agent_mart.with_premium(t.coverages(), t.plans())
    return tidy(priced.select("pol_num", "plan_code", "wa_code", "cvg_eff_dt", "cvg_prem", "ape", "adjust_ape"))


@query("prev_due_date", with_parts("""
select pol_num, cast(cast(case pmt_mode when '12' then pd_to_dt - interval 12 month when '06' then pd_to_dt - interval 6 month
  when '03' then pd_to_dt - interval 3 month when '01' then pd_to_dt - interval 1 month end as date) as varchar) as prev_due
from policy""", "policy"))
def prev_due_date(t):
    return tidy(t.policies().select("pol_num", previous_due(F.col("pd_to_dt"), F.col("pmt_mode")).alias("prev_due")))


@query("premium_years", with_parts(f"""
select pol_num, plan_code, cast(least(y, prem_dur) as bigint) as prem_dur_pre, cast(prem_dur - least(y, prem_dur) as bigint) as prem_dur_post
from (select *, cast(floor(date_diff('day', cvg_eff_dt, {DAY}) / 365.25) as integer) as y from line)""", "line"))
def premium_years(t):
    paid, left = measures.premium_years(F.col("cvg_eff_dt"), SNAPSHOT.column(), F.col("prem_dur"))
    return tidy(t.coverage_lines().select("pol_num", "plan_code", paid.alias("prem_dur_pre"), left.alias("prem_dur_post")))


@query("years_in_force", with_parts(f"""
select pol_num, cast(floor(date_diff('day', pol_eff_dt, coalesce(pol_trmn_dt, {DAY})) / 365.25) as bigint) as inforce_yr
from policy""", "policy"))
def years_in_force(t):
    years = whole_years(F.col("pol_eff_dt"), F.coalesce("pol_trmn_dt", SNAPSHOT.column()))
    return tidy(t.policies().select("pol_num", years.alias("inforce_yr")))


@query("relation_rule", with_parts("""
select pol_num, po_num, insrd_num, case when po_num = insrd_num or gap is null then 'self' when gap between 18 and 40 then 'child'
  when gap > 40 then 'others' when gap < -17 then 'parent' when g1 is distinct from g2 then 'spouse' else 'others' end as po_ins_rela
from (select p.*, case when p.po_num <> p.insrd_num then o.cur_age - i.cur_age end as gap, o.sex_code as g1, i.sex_code as g2
  from policy p left join client o on o.cli_num = p.po_num left join client i on i.cli_num = p.insrd_num)""", "policy", "client"))
def relation_rule(t):
    return agent_mart.with_relation(t.policies(), t.clients()).select("pol_num", "po_num", "insrd_num", "po_ins_rela")


@query("beneficiary_names", with_parts("""
select pol_num, plan_code, cast(prem_dur as bigint) as prem_dur, case prem_dur when 0 then 'Others' when 1 then 'Self' when 2 then 'Spouse' when 3 then 'Child'
  when 4 then 'Others' when 5 then 'Others' when 10 then 'Others' when 31 then 'Others' end as insrd,
  cast(case prem_dur when 1 then 1 when 0 then 0 when 2 then 0 when 3 then 0 when 4 then 0 when 5 then 0 when 10 then 0 when 31 then 0 end as bigint) as be_is_cli
from line""", "line"))
def beneficiary_names(t):
    named = agent_mart.beneficiary_flags(t.coverage_lines(), "prem_dur")
    return tidy(named.select("pol_num", "plan_code", "prem_dur", "insrd", "be_is_cli"))


@query("repeat_sale_flag", with_parts("""
select p.pol_num, cast(case when frst_pol_num is not null then 1 else 0 end as bigint) as if_first_pol,
  cast(case when pol_stat_cd not in ('A', 'N', 'R') and frst_pol_num is null then 1 else 0 end as bigint) as repeated_sales
from policy p left join first_policy on frst_pol_num = pol_num""", "policy", "first_policy"))
def repeat_sale_flag(t):
    flagged = agent_mart.with_sale_order(t.policies(), t.policies())
    return tidy(flagged.select("pol_num", "if_first_pol", "repeated_sales"))


@query("product_mix_key", with_parts("""
select concat_ws('_', type, po_ins_rela) as prd_cus_mix, count(*) as coverages from mart group by 1""", "mart"))
def product_mix_key(t):
    from cohortloom.catalog.agents import mart

    return reports.frequency(mart(t, ["premium", "relation"]), "prd_cus_mix", name="coverages")


@query("row_argmax", """
select c_custkey as po_num, case greatest(a, b, c, d) when a then 'health_base' when b then 'inv_base' when c then 'health_rider'
  else 'riders' end as which_prd
from (select c_custkey, c_custkey * 3 % 10 / 20 as a, c_custkey * 7 % 11 / 20 as b, c_custkey * 5 % 12 / 20 as c, c_custkey % 7 / 20 as d
  from customer)""")
def row_argmax(t):
    renamed = cleaning.strip_names(t.product_scores(), "rep_purchase_comb_", "_PREDICTION")
    return renamed.select("po_num", argmax_label(["health_base", "inv_base", "health_rider", "riders"]).alias("which_prd"))


@query("approved_score_filter", with_parts("select po_num, which_prd, health_base, inv_base, health_rider, riders from product", "product"))
def approved_score_filter(t):
    return agent_mart.approved_products(t.product_scores()).select(
        "po_num", "which_prd", "health_base", "inv_base", "health_rider", "riders"
    )


@query("tenure_text", with_parts(f"""
select agt_code, m as tenure_mth, cast(floor(m / 12) as integer) || 'y ' || (((m % 12) + 12) % 12) || 'm' as tenure_ym
from (select agt_code, cast(trunc({months_between(DAY, 'agt_join_dt')}) as bigint) as m from agent)""", "agent"))
def tenure_text_query(t):
    months = whole_months(F.col("agt_join_dt"), SNAPSHOT.column())
    return tidy(t.agents().select("agt_code", months.alias("tenure_mth"), tenure_text(months).alias("tenure_ym")))


@query("agent_tenure", with_parts(f"""
select agt_code, round(case when comp_prvd_num not in ({quoted(codes.PARTNER_CODES)}) then
  date_diff('day', agt_join_dt, coalesce(agt_term_dt, {DAY})) / 365.25 end, 6) as agt_tenure_yrs from agent""", "agent"))
def agent_tenure(t):
    years = F.datediff(F.coalesce("agt_term_dt", SNAPSHOT.column()), "agt_join_dt") / 365.25
    return tidy(t.agents().select(
        "agt_code", F.when(~F.col("comp_prvd_num").isin(*codes.PARTNER_CODES), years).alias("agt_tenure_yrs")
    ))


@query("fiscal_quarter_label", with_parts(f"""
select {QUARTER} as effective_qtr, (year(cvg_eff_dt) * 12 + month(cvg_eff_dt)) - 24019 as month_offset, count(*) as coverages
from line group by 1, 2""", "line"))
def fiscal_quarter_label(t):
    day = F.col("cvg_eff_dt")
    labelled = t.coverage_lines().select(
        fiscal_quarter(day).alias("effective_qtr"), month_offset(day, SNAPSHOT).cast("long").alias("month_offset")
    )
    return labelled.groupBy("effective_qtr", "month_offset").agg(F.count(F.lit(1)).alias("coverages"))


@query("rename_project", """
select s_suppkey as agt_code, s_name as agt_name, s_acctbal as health_base from supplier""")
def rename_project(t):
    raw = t.raw("supplier").select(
        F.col("s_suppkey").alias("AGT_CODE"), F.col("s_name").alias("AGT_NAME"),
        F.col("s_acctbal").alias("rep_HEALTH_BASE_PREDICTION"), "s_nationkey",
    ).drop("s_nationkey")
    return cleaning.lower_names(cleaning.strip_names(raw, "rep_", "_PREDICTION"))


@query("claim_ratio", with_parts(f"""
select c.po_num, round(claims / round(total_ape, 4), 6) as clm_6m_ratio
from (select po_num, sum(tot_ape) / {codes.FX_RATE} as total_ape from policy group by 1) c
join (select po_num, sum(clm_prvd_amt) / {codes.FX_RATE} as claims from claim join policy using (pol_num) group by 1) k on k.po_num = c.po_num""",
                                  "policy", "claim"))
def claim_ratio(t):
    totals = t.policies().groupBy("po_num").agg((F.sum("tot_ape") / codes.FX_RATE).alias("total_ape"))
    paid = t.claims().groupBy("pol_num").agg(F.sum("clm_prvd_amt").alias("amount"))
    claimed = t.policies().join(paid, "pol_num").groupBy("po_num").agg((F.sum("amount") / codes.FX_RATE).alias("clm_6m_amt"))
    return tidy(slicers.with_claim_ratio(totals.join(claimed, "po_num")).select("po_num", "clm_6m_ratio"))


@query("profile_bands", "select " + band_sql("c_custkey % 4", codes.PROFILE_EDGES["no_dpnd"], include_lowest=False)
       + " as no_dpnd_band, count(*) as clients from customer group by 1")
def profile_bands(t):
    edges = codes.PROFILE_EDGES["no_dpnd"]
    banded = t.clients().select(band(F.col("no_dpnd"), edges, include_lowest=False).alias("no_dpnd_band"))
    return reports.frequency(banded, "no_dpnd_band", keep_null=True, name="clients")
