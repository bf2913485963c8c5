"""SQL equivalents of the entity views and marts, put together as common table expressions."""

from __future__ import annotations

from collections.abc import Iterable

from cohortloom.functions import codes

DAY = "date '2001-06-30'"
MONTH = 2001 * 12 + 6


def months_between(late: str, early: str) -> str:
    whole = f"((year({late}) - year({early})) * 12 + month({late}) - month({early}))"
    return (
        f"(case when day({late}) = day({early}) or (last_day({late}) = {late} and last_day({early}) = {early}) "
        f"then cast({whole} as double) else {whole} + (day({late}) - day({early})) / 31.0 end)"
    )


def band_sql(value: str, edges, labels=None, include_lowest: bool = True) -> str:
    labels = labels or [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    low = f"{value} {'>=' if include_lowest else '>'} {edges[0]}"

    def upto(edge):
        return "true" if edge == codes.INF else f"{value} <= {edge}"

    quoted = [label.replace("'", "''") for label in labels]
    cases = " ".join(f"when {low} and {upto(high)} then '{label}'" for high, label in zip(edges[1:], quoted))
    return f"(case {cases} end)"


def quoted(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def exact_sum(text: str) -> str:
    """A sum of amounts that does not depend on the order of the rows."""
    return f"cast(sum(cast({text} as decimal(28, 8))) as double)"


def mean_sql(text: str) -> str:
    return f"{exact_sum(text)} / count({text})"


def cut(text: str, digits: int = 6) -> str:
    """Rounded half up on the decimal digits of the number, as ``tidy`` does."""
    return f"cast(round(cast({text} as decimal(38, {digits + 5})), {digits}) as double)"


_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def _part(name: str, text: str, *needs: str) -> None:
    _PARTS[name] = (needs, text)


def with_parts(body: str, *names: str) -> str:
    """``body`` after the named parts and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        needs, _ = _PARTS[name]
        for need in needs:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{name} as ({_PARTS[name][1]})" for name in order)
    return f"with {parts}\n{body}" if parts else body


_part("policy", """
select o_orderkey as pol_num, o_custkey as po_num,
  case when o_orderkey % 3 = 0 then o_custkey else o_custkey + o_orderkey % 97 end as insrd_num,
  case when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then '4'
       when o_orderstatus = 'O' then '1'
       when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'E'
       when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' then 'F'
       when o_orderstatus = 'F' then 'B'
       when o_orderpriority = '5-LOW' then 'R'
       when o_orderpriority = '4-NOT SPECIFIED' then 'N' else 'A' end as pol_stat_cd,
  case o_orderpriority when '1-URGENT' then '12' when '2-HIGH' then '06' when '3-MEDIUM' then '03'
       when '4-NOT SPECIFIED' then '01' end as pmt_mode,
  case o_orderpriority when '1-URGENT' then '01' when '2-HIGH' then '10' when '3-MEDIUM' then '48'
       when '4-NOT SPECIFIED' then '05' when '5-LOW' then '09' end as dist_chnl_cd,
  case o_custkey % 4 when 1 then 'TCB01' when 2 then 'SAG02' when 3 then 'OTH03' end as loc_cd,
  case o_custkey % 4 when 1 then 'TCB' when 2 then 'SAG' when 3 then 'OTH' end as office_cd,
  cast(o_orderdate as date) as pol_eff_dt,
  case when o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 1200 as integer) end as pol_trmn_dt,
  cast(o_orderdate as date) + cast(o_orderkey % 365 as integer) as pd_to_dt,
  o_totalprice as tot_ape, o_orderkey % 10 as sell_code,
  case o_orderkey % 3 when 0 then 'cash' when 1 then 'cheque' else 'transfer' end as lst_pmt_mthd
from orders""")
_part("line", """
select l_orderkey as pol_num, l_partkey as plan_code, l_suppkey as wa_code, cast(l_shipdate as date) as cvg_eff_dt,
  l_extendedprice as cvg_prem, case when l_returnflag = 'R' then 'R' else 'B' end as cvg_typ,
  cast(l_quantity as integer) as prem_dur
from lineitem""")
_part("cov", "select * from line join policy using (pol_num)", "line", "policy")
# What is known at the snapshot.
_part("line_then", f"select * from line where cvg_eff_dt <= {DAY}", "line")
_part("policy_then", f"select * from policy where pol_eff_dt <= {DAY}", "policy")
_part("cov_then", "select * from line_then join policy_then using (pol_num)", "line_then", "policy_then")
_part("client", """
select c_custkey as cli_num, case when c_custkey % 2 = 0 then 'M' else 'F' end as sex_code,
  20 + c_custkey % 50 as cur_age, c_custkey % 4 as no_dpnd,
  case when c_custkey % 3 = 0 then 1 else 0 end as dpnd_child_ind,
  case when c_custkey % 5 in (0, 1) then 1 else 0 end as dpnd_spouse_ind,
  c_acctbal as mthly_incm, c_nationkey as city_key, c_mktsegment as customer_segment,
  case when c_custkey % 7 <> 0 then 'c' || c_custkey || '@x.example' end as email_addr,
  case when c_custkey % 6 <> 0 then '+84' || (900000000 + c_custkey) end as mobl_phon_num, 18 + c_custkey % 45 as frst_iss_age, 'rule ' || (c_custkey % 4) as segmentation_rules,
  case when c_custkey % 11 <> 10 then cast(c_custkey * 17 % 101 as double) end as "protection_income%"
from customer""")
_part("agent", """
select s_suppkey as agt_code, s_name as agt_nm, s_nationkey as br_code,
  date '1994-01-01' + cast(s_suppkey * 37 % 2500 as integer) as agt_join_dt,
  case when s_suppkey % 10 <> 9 then 'Agency' else 'Partner' end as channel,
  case when s_suppkey % 13 = 12 then '9' else '1' end as agt_stat_code,
  case when s_suppkey % 17 = 16 then date '2001-01-31' end as agt_term_dt,
  case when s_suppkey % 3 = 2 then '98' else '01' end as comp_prvd_num,
  case s_suppkey % 4 when 1 then 'S' when 2 then 'G' when 3 then 'P' end as title
from supplier""")
_part("tier_list", """
select s_suppkey as agt_code, case s_suppkey % 33 when 0 then 'TOT' when 11 then 'COT' when 22 then 'MDRT' end as ranking
from supplier where s_suppkey % 11 = 0""")
_FINISHED = " + ".join(f"case when (s_suppkey + {i}) % 5 = 0 then 1 else 0 end" for i in range(1, 13))
_part("training", f"""
select s_suppkey as agt_code, cast(sum({_FINISHED}) as bigint) as no_sbw_completed
from supplier where s_suppkey % 3 in (1, 2) and s_suppkey % 8 <> 7
group by 1 having sum({_FINISHED}) > 0""")
_part("master", f"""
select a.agt_code, agt_nm, br_code, agt_join_dt, comp_prvd_num,
  case title when 'S' then 'Silver' when 'G' then 'Gold' when 'P' then 'Platinum' end as mpro_title,
  coalesce(ranking, case title when 'S' then 'Silver' when 'G' then 'Gold' when 'P' then 'Platinum' end, 'Unranked') as tier,
  cast(trunc({months_between(DAY, 'agt_join_dt')}) as bigint) as tenure_mth,
  coalesce(no_sbw_completed, 0) as no_sbw_completed
from agent a left join tier_list t on t.agt_code = a.agt_code left join training s on s.agt_code = a.agt_code
where channel = 'Agency' and agt_stat_code = '1' and agt_term_dt is null and comp_prvd_num in ('01', '98')""",
      "agent", "tier_list", "training")
_part("plan", """
select p_partkey as plan_code, p_type as type, case when p_size <= 5 then 1 else 0 end as sp_ind,
  (p_partkey % 20) / 100 as plan_margin from part""")
_part("margin", """
select p_partkey as plan_code, cast(date '1995-01-01' + to_months(cast(p_partkey * 7 % 80 as integer)) as date) as effective_date,
  p_size / 100 as nbv_margin from part
union all
select p_partkey, cast(date '1995-01-01' + to_months(cast(p_partkey * 7 % 80 as integer) + 1) as date) + 14, p_size / 200 from part""")
_AGE = f"floor({months_between('d.cvg_eff_dt', 'm.effective_date')})"
_part("dated", f"""
select d.plan_code, d.cvg_eff_dt, arg_max(m.nbv_margin, m.effective_date) as dated_margin
from (select distinct plan_code, cvg_eff_dt from line) d join margin m on m.plan_code = d.plan_code and {_AGE} between 0 and 2
group by 1, 2""", "line", "margin")
_part("first_policy", """
select po_num, pol_num as frst_pol_num from (
  select po_num, pol_num, row_number() over (partition by po_num order by pol_eff_dt, pol_num) as rn
  from policy where pol_stat_cd not in ('A', 'N', 'R')) where rn = 1""", "policy")
_part("prem", """
select c.*, p.type, p.sp_ind, p.plan_margin, date_diff('day', pol_eff_dt, pol_trmn_dt) as pol_eff_days,
  case when pol_stat_cd in ('A', 'N', 'R') then 0.0 else cvg_prem * 12 / cast(pmt_mode as integer) end as ape
from cov c left join plan p on p.plan_code = c.plan_code""", "cov", "plan")
ADJUSTED = """coalesce(case when sp_ind = 1 then case when pol_eff_days is null or pol_eff_days <= 21 then 0 else cvg_prem * 0.1 end
  when pol_eff_days is null then ape when pol_eff_days <= 21 then 0
  when pol_eff_days >= 365 or pmt_mode = '12' then ape
  when pmt_mode = '01' then cvg_prem * (floor(pol_eff_days / 31) + 1)
  when pmt_mode = '03' then cvg_prem * (floor(pol_eff_days / 92) + 1)
  when pmt_mode = '06' then cvg_prem * (floor(pol_eff_days / 183) + 1)
  else 0 end, 0)"""
_part("adj", f"select *, {ADJUSTED} as adjust_ape from prem", "prem")
RELATION = """case when po_is_cli = 1 or gap is null then 'self' when gap between 18 and 40 then 'child'
  when gap > 40 then 'others' when gap < -17 then 'parent'
  when po_gender is distinct from in_gender then 'spouse' else 'others' end"""
_part("mart", f"""
select *, {RELATION} as po_ins_rela, adjust_ape * nbv_margin as nbv,
  (year(cvg_eff_dt) * 12 + month(cvg_eff_dt)) - {MONTH + 1} as last_n_month_eff_cvg,
  strftime(cvg_eff_dt, '%Y-%m') as year_month
from (
  select a.*, m.tier, m.agt_join_dt,
    case when f.frst_pol_num is not null then 1 else 0 end as if_first_pol,
    case when pol_stat_cd not in ('A', 'N', 'R') and f.frst_pol_num is null then 1 else 0 end as repeated_sales,
    coalesce(d.dated_margin, a.plan_margin) as nbv_margin,
    case when a.po_num = a.insrd_num then 1 else 0 end as po_is_cli,
    case when a.po_num <> a.insrd_num then o.cur_age - i.cur_age end as gap,
    o.sex_code as po_gender, i.sex_code as in_gender
  from adj a join master m on m.agt_code = a.wa_code
  left join first_policy f on f.frst_pol_num = a.pol_num
  left join dated d on d.plan_code = a.plan_code and d.cvg_eff_dt = a.cvg_eff_dt
  left join client o on o.cli_num = a.po_num left join client i on i.cli_num = a.insrd_num
  where a.cvg_eff_dt <= {DAY} and a.pol_eff_dt <= {DAY})""",
      "adj", "master", "first_policy", "dated", "client")

# Rolling KPIs: period conditions and the columns they make.
_OFF = "last_n_month_eff_cvg"
PERIODS = {
    "last_yr": "year(cvg_eff_dt) = 2000",
    "last_mth": f"{_OFF} = -1",
    "last_12m": f"{_OFF} between -12 and -1",
    "last_3m": f"{_OFF} between -3 and -1",
    "last_6m": f"{_OFF} between -6 and -1",
    "last_9m": f"{_OFF} between -9 and -1",
    "ytd": f"year(cvg_eff_dt) = 2001 and {_OFF} <= -1",
    "total": f"{_OFF} <= -1",
}
ROLLING = ("last_mth", "last_12m", "last_3m", "last_6m", "last_9m")
WITH_YEAR = ("last_yr", *ROLLING)
TAKEN = "pol_stat_cd not in ('A', 'N', 'R')"


def _name(period: str, suffix: str, tail: str) -> str:
    if period in ("ytd", "total"):
        return f"{tail}_ytd" if period == "ytd" else f"total_{tail}"
    return f"{period}_{suffix}"


def sum_columns(value: str, suffix: str, tail: str, only: str = TAKEN) -> dict[str, str]:
    return {
        _name(p, suffix, tail): f"coalesce(cast(sum(case when {c} and {only} then cast({value} as decimal(28, 8)) end) as double), 0)" for p, c in PERIODS.items()
    }


def count_columns(entity: str, suffix: str, only: str = TAKEN, periods=tuple(PERIODS)) -> dict[str, str]:
    return {
        _name(p, suffix, suffix): f"count(distinct case when {PERIODS[p]} and {only} then {entity} end)" for p in periods
    }


def early_lapse_columns() -> dict[str, str]:
    kept = months_between("pol_trmn_dt", "pol_eff_dt")
    return {
        f"lap_{n}m_pol": f"count(distinct case when pol_stat_cd = 'B' and {kept} <= {n} then pol_num end)" for n in (14, 20, 26)
    }


BLOCKS: dict[str, dict[str, str]] = {
    "ape": sum_columns("adjust_ape", "ape", "ape"),
    "nbv": sum_columns("nbv", "nbv", "nbv"),
    "rider": sum_columns("adjust_ape", "rid", "rid_ape", f"{TAKEN} and cvg_typ = 'R'"),
    "repeat_ape": sum_columns("adjust_ape", "rep", "rep_ape", "repeated_sales = 1"),
    "repeat_nbv": sum_columns("nbv", "rep_nbv", "rep_nbv", "repeated_sales = 1"),
    "owner": count_columns("po_num", "po"),
    "insured": count_columns("insrd_num", "cus"),
    "policy": {**count_columns("pol_num", "pol"), "all_pol_cnt": f"count(distinct case when {TAKEN} then pol_num end)"},
    "not_taken": count_columns("pol_num", "NT", "pol_stat_cd in ('A', 'N')", ROLLING),
    "rejected": count_columns("pol_num", "rej", "pol_stat_cd = 'R'", ROLLING),
    "lapsed": {**count_columns("pol_num", "lap", "pol_stat_cd = 'B'", ROLLING), **early_lapse_columns()},
    "product": count_columns("type", "prd"),
    "family": count_columns("po_ins_rela", "fam", TAKEN, ROLLING),
}
SUM_BLOCKS = ("ape", "nbv", "rider", "repeat_ape", "repeat_nbv")


def kpi_select(*blocks: str, rounded: bool = True) -> str:
    columns = []
    for block in blocks:
        for name, text in BLOCKS[block].items():
            columns.append(f'round({text}, 6) as "{name}"' if block in SUM_BLOCKS and rounded else f'{text} as "{name}"')
    return "select wa_code, " + ", ".join(columns) + " from mart group by wa_code"


def cut_all(*names: str) -> str:
    return ", ".join(cut(f'"{n}"') + f' as "{n}"' for n in names)


def size_columns() -> dict[str, str]:
    return {
        f"{p}_{e}_size": f'case when "{p}_{e}" <> 0 then "{p}_ape" / "{p}_{e}" else 1.0 end'
        for p in WITH_YEAR for e in ("pol", "po")
    }


def kept(bad: str, every: str) -> str:
    return f"case when {every} <> 0 then 1 - {bad} / {every} else 1.0 end"


def rate_columns() -> dict[str, str]:
    rates = {}
    for p in ROLLING:
        for bad in ("NT", "rej"):
            rates[f"{p}_{bad}_per"] = kept(f'"{p}_{bad}"', f'("{p}_{bad}" + "{p}_pol")')
        rates[f"{p}_lap_per"] = kept(f'"{p}_lap"', f'"{p}_pol"')
    for n in (14, 20, 26):
        rates[f"{n}m_per"] = kept(f'"lap_{n}m_pol"', '"all_pol_cnt"')
    rates["12M_NT_rate"] = kept('"last_12m_NT"', '("last_12m_NT" + "last_12m_pol")')
    return rates


_part("kpi", kpi_select(*BLOCKS, rounded=False), "mart")
_extra = ", ".join(f'{text} as "{name}"' for name, text in {**size_columns(), **rate_columns()}.items())
_part("rates", f"select *, {_extra} from kpi", "kpi")
_part("policy_agent", """
select pol_num, agt_cd from (select pol_num, wa_code as agt_cd,
  row_number() over (partition by pol_num order by cvg_eff_dt desc, wa_code) as rn from mart) where rn = 1""", "mart")
_part("owner_agent", """
select po_num, agt_cd from (select po_num, wa_code as agt_cd,
  row_number() over (partition by po_num order by cvg_eff_dt desc, wa_code) as rn from mart) where rn = 1""", "mart")
_part("owner_policy", """
select po_num, pol_num from (select po_num, pol_num,
  row_number() over (partition by po_num order by cvg_eff_dt desc, pol_num) as rn from mart) where rn = 1""", "mart")
_part("claim", """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'),
    cast(round(l_extendedprice * 100) as bigint)) as clm_id,
  l_orderkey as pol_num, l_suppkey as wa_code, cast(l_shipdate as date) as clm_recv_dt, cast(l_shipdate as date) as clm_aprov_dt,
  case when l_linestatus = 'F' then 'A' else 'I' end as clm_stat_code, l_linenumber as clm_code,
  l_extendedprice as clm_prvd_amt, l_extendedprice as clm_aprov_amt
from lineitem where l_returnflag = 'R'""")
_part("hit", """
select event_id, user_id as login_id, ts as hit_at, case when event_type = 'error' then 1 else 0 end as exclude_hit,
  case when event_type = 'signup' then '5' else '1' end as hit_source, event_type as page from events""")
_part("lapse_score", """
select o_orderkey as pol_num, (o_orderkey * 7 % 100) / 1000 as lapse_score, o_orderkey * 7 % 10 + 1 as decile
from orders where o_orderkey % 4 <> 0""")
_part("early_score", """
select o_orderkey as pol_num, (o_orderkey * 11 % 100) / 500 as p_1, o_orderkey * 11 % 10 + 1 as early_decile
from orders where o_orderkey % 5 <> 0""")
_part("propensity", """
select po_num, min(d) as min_decile from (
  select c_custkey as po_num, least(c_custkey * 3 % 10 + 1, c_custkey * 7 % 10 + 1, c_custkey % 9 + 2,
    case when c_custkey % 6 <> 0 then c_custkey % 8 + 3 end, c_custkey % 7 + 4, c_custkey % 6 + 5) as d
  from customer where c_custkey % 3 <> 0
  union all
  select c_custkey, least(c_custkey % 10 + 1, c_custkey * 9 % 10 + 1, c_custkey % 5 + 6) from customer where c_custkey % 4 = 0)
group by 1""")
_part("lead", "select c_custkey as po_num, c_custkey * 13 % 1000 / 1000 as p_1 from customer")
_part("product", """
select po_num, which_prd, case when hb > 0.1 then '*' else '' end as health_base,
  case when which_prd = 'inv_base' then '*' else '' end as inv_base,
  case when hr > 0.1 then '*' else '' end as health_rider, case when ri > 0.1 then '*' else '' end as riders
from (select *, case greatest(hb, ib, hr, ri) when hb then 'health_base' when ib then 'inv_base' when hr then 'health_rider'
    else 'riders' end as which_prd
  from (select c_custkey as po_num, c_custkey * 3 % 10 / 20 as hb, c_custkey * 7 % 11 / 20 as ib,
    c_custkey * 5 % 12 / 20 as hr, c_custkey % 7 / 20 as ri from customer where c_custkey % 5 <> 4))""")
_part("top_lead", """
select * from (select t.*, p.* exclude (po_num), o.pol_num, row_number() over (partition by agt_cd order by p_1 desc, t.po_num) as rn2 from (
  select * from (select l.po_num, l.p_1, a.agt_cd, row_number() over (partition by a.agt_cd order by p_1 desc, l.po_num) as rn
    from lead l join owner_agent a on a.po_num = l.po_num) where rn <= 10) t
  join product p on p.po_num = t.po_num join owner_policy o on o.po_num = t.po_num) where rn2 <= 10""",
      "lead", "owner_agent", "product", "owner_policy")

_part("served", """
select m.agt_code, po_num_count, all_pol_cnt, (m.agt_code * 7 % 12) / 12 as "1yr_agent_activeness"
from master m join (select sa_code, count(*) as po_num_count from (
    select po_num, wa_code as sa_code, row_number() over (partition by po_num order by pol_eff_dt desc, pol_num desc, wa_code) as rn from cov_then)
  where rn = 1 and po_num in (select cli_num from client) group by 1) s on s.sa_code = m.agt_code
join (select wa_code, all_pol_cnt from kpi) k on k.wa_code = m.agt_code""", "master", "cov_then", "client", "kpi")

# Client side.
_part("base", f"""
select p.*, l.plan_code, l.wa_code, l.cvg_eff_dt, l.cvg_prem, l.cvg_typ, l.prem_dur, pl.type, pl.sp_ind, pl.plan_margin,
  c.email_addr as cli_email, c.mobl_phon_num as cli_mobile, c.customer_segment,
  case when a.comp_prvd_num not in ({quoted(codes.PARTNER_CODES)})
    then date_diff('day', a.agt_join_dt, coalesce(a.agt_term_dt, {DAY})) / 365.25 end as agt_tenure_yrs,
  least(cast(floor(date_diff('day', l.cvg_eff_dt, {DAY}) / 365.25) as integer), l.prem_dur) as prem_dur_pre,
  l.prem_dur - least(cast(floor(date_diff('day', l.cvg_eff_dt, {DAY}) / 365.25) as integer), l.prem_dur) as prem_dur_post,
  cast(floor(date_diff('day', p.pol_eff_dt, coalesce(p.pol_trmn_dt, {DAY})) / 365.25) as integer) as inforce_yr,
  {", ".join(f"case when pol_stat_cd in ({quoted(m)}) then 1 else 0 end as f_{n}_ind" for n, m in codes.STATUS_CODES.items())}
from policy_then p left join line_then l on l.pol_num = p.pol_num left join plan pl on pl.plan_code = l.plan_code
left join client c on c.cli_num = p.po_num left join agent a on a.agt_code = l.wa_code""",
      "policy_then", "line_then", "plan", "client", "agent")
_part("plan_margin", """
select p_partkey as plan_code, case when p_partkey % 6 <> 0 then p_partkey % 20 / 100 end as agency,
  p_partkey % 15 / 100 as direct, p_partkey % 12 / 100 as other, p_partkey % 9 / 100 as affinity,
  case when p_partkey % 5 <> 0 then p_partkey % 17 / 100 end as banca, p_partkey % 18 / 100 as tcb, p_partkey % 16 / 100 as sag
from part""")
_part("quarter_margin", """
select p_partkey as plan_code, (1994 + q // 4) || ' Q' || (q % 4 + 1) as effective_qtr, (p_partkey + q) % 25 / 100 as quarter_margin
from part, range(32) r(q)""")
QUARTER = """case when quarter(cvg_eff_dt) <= 2 then (year(cvg_eff_dt) - 1) || ' Q' || (quarter(cvg_eff_dt) + 2)
  else year(cvg_eff_dt) || ' Q' || (quarter(cvg_eff_dt) - 2) end"""
_BANCA, _AFF, _AG, _DIR = (quoted(codes.CHANNEL_CODES[c]) for c in ("banca", "affinity", "agency", "direct"))
MARGIN = f"""case when loc_cd is null then case
    when dist_chnl_cd in ({_BANCA}) then coalesce(banca, quarter_margin)
    when dist_chnl_cd in ({_AFF}) then coalesce(affinity, quarter_margin)
    when dist_chnl_cd in ({_AG}) then coalesce(agency, quarter_margin)
    when dist_chnl_cd in ({_DIR}) then coalesce(direct, quarter_margin)
    when dist_chnl_cd = '09' then {codes.FIXED_MARGIN} else coalesce(other, quarter_margin) end
  when dist_chnl_cd = '*' then coalesce(agency, quarter_margin)
  when loc_cd like 'TCB%' then coalesce(tcb, quarter_margin)
  when loc_cd like 'SAG%' then coalesce(sag, quarter_margin) else coalesce(other, quarter_margin) end"""
_part("valued", f"""
select *, cvg_prem / {codes.FX_RATE} * nbv_margin as plan_nbv, cvg_prem / {codes.FX_RATE} * 12 / cast(pmt_mode as integer) as coverage_ape,
  case when pmt_mode = '12' then 1 else 0 end as annual_flag, case when cli_email is not null then 1 else 0 end as valid_email,
  case when cli_mobile is not null then 1 else 0 end as valid_mobile,
  case when dist_chnl_cd in ({_AG}) then 'Agency' when dist_chnl_cd in ({_DIR}) then 'DMTM' else office_cd end as sales_channel
from (select b.*, qtr, {MARGIN} as nbv_margin
  from (select *, {QUARTER} as qtr from base) b left join plan_margin m on m.plan_code = b.plan_code
  left join quarter_margin q on q.plan_code = b.plan_code and q.effective_qtr = b.qtr)
where pol_stat_cd not in ('6', '8')""", "base", "plan_margin", "quarter_margin")
_part("pol_ltv", """
select v.*, next_due_decile, lapse_score, early_decile, p_1, case when coverage_ape <> 0 then plan_nbv / coverage_ape end as cli_nbv_margin,
  plan_nbv * yrs * (1 - coalesce(lapse_score, p_1, 0)) as pol_ltv,
  plan_nbv * paid * (1 - coalesce(lapse_score, p_1, 0)) as pol_ltv_pre,
  plan_nbv * rest * (1 - coalesce(lapse_score, p_1, 0)) as pol_ltv_post
from (select pol_num, po_num, cast(sum(cast(coverage_ape as decimal(28, 8))) as double) as coverage_ape,
    cast(sum(cast(plan_nbv as decimal(28, 8))) as double) as plan_nbv, min(prem_dur) as yrs,
    min(prem_dur_pre) as paid, min(prem_dur_post) as rest from valued group by 1, 2) v
left join (select pol_num, decile as next_due_decile, lapse_score from lapse_score) l on l.pol_num = v.pol_num
left join early_score e on e.pol_num = v.pol_num""", "valued", "lapse_score", "early_score")
_part("cli_ltv", f"""
select po_num, {cut(exact_sum("coverage_ape"), 2)} as coverage_ape, {cut(exact_sum("plan_nbv"), 2)} as plan_nbv,
  {cut("case when " + exact_sum("coverage_ape") + " <> 0 then " + exact_sum("plan_nbv") + " / " + exact_sum("coverage_ape") + " end")} as cli_nbv_margin,
  {", ".join(f"{cut(exact_sum(f'pol_ltv{part}'), 2)} as cli_ltv{part}" for part in ("", "_pre", "_post"))},
  min(next_due_decile) as next_due_decile, min(early_decile) as early_decile,
  least(min(next_due_decile), min(early_decile)) as lapse_decile
from pol_ltv group by 1""", "pol_ltv")
_part("channel", """
select po_num, channel, coalesce(case when max(case when sales_channel = 'Agency' then 1 end) = 1 then 'Agency' end,
  case when max(case when sales_channel = 'TCB' then 1 end) = 1 then 'TCB' end,
  case when max(case when sales_channel = 'SAG' then 1 end) = 1 then 'SAG' end, channel) as channel_final
from (select po_num, sales_channel, first_value(sales_channel) over (partition by po_num
  order by cvg_eff_dt nulls first, pol_num nulls first, sales_channel nulls first) as channel from valued)
group by po_num, channel""", "valued")
TYPES = {"ECONOMY": "economy_pol", "LARGE": "large_pol", "MEDIUM": "medium_pol", "PROMO": "promo_pol",
         "SMALL": "small_pol", "STANDARD": "standard_pol"}
CLIENT_FLAGS = {
    "f_same_agent": "max(case when sell_code = wa_code then 1 else 0 end)",
    "mdrt_flag": "coalesce(max(case when wa_code % 11 = 0 then 1 when wa_code is not null then 0 end), 0)",
    "mdrt_tot_flag": "max(case when wa_code % 33 = 0 then 1 else 0 end)",
    "mdrt_cot_flag": "max(case when wa_code % 33 = 11 then 1 else 0 end)",
    "active_1m_flag": "max(case when wa_code % 5 = 2 then 1 else 0 end)",
    "f_cash": "sum(case when lst_pmt_mthd = 'cash' then 1 else 0 end)",
    "f_cheque": "sum(case when lst_pmt_mthd = 'cheque' then 1 else 0 end)",
    "f_auto": "sum(case when lst_pmt_mthd = 'transfer' then 1 else 0 end)",
}
_STATUS_OUT = dict(zip(codes.STATUS_CODES, (
    "inforce_pol", "lapsed_pol", "surrendered_pol", "matured_pol", "nottaken_pol", "terminated_pol", "oth_paid_pol")))
_VIP = codes.VIP_BOUNDS
_part("holding", f"""
select *, date_diff('day', first_pol_eff_dt, {DAY}) / 365.25 as client_tenure,
  {" + ".join(f"(case when {c} > 0 then 1 else 0 end)" for c in TYPES.values())} as ins_typ_count,
  case when pol_count >= 2 then 1 else 0 end as multi_prod, case when inforce_pol > 0 then 1 else 0 end as inforce_ind,
  case when total_ape >= {_VIP['elite']} then 1 else 0 end as f_vip_elite,
  case when total_ape >= {_VIP['plat']} and total_ape < {_VIP['elite']} then 1 else 0 end as f_vip_plat,
  case when total_ape >= {_VIP['gold']} and total_ape < {_VIP['plat']} then 1 else 0 end as f_vip_gold,
  case when total_ape >= {_VIP['silver']} and total_ape < {_VIP['gold']} and "10yr_pol_cnt" >= 1 then 1 else 0 end as f_vip_silver
from (select po_num, min(cvg_eff_dt) as first_pol_eff_dt, count(distinct pol_num) as pol_count,
  {", ".join(f"count(distinct case when f_{n}_ind = 1 then pol_num end) as {o}" for n, o in _STATUS_OUT.items())},
  {", ".join(f"count(distinct case when type = '{k}' then pol_num end) as {o}" for k, o in TYPES.items())},
  max(annual_flag) as annual_flag, max(valid_email) as valid_email, max(valid_mobile) as valid_mobile,
  {", ".join(f"sum(case when type = '{k}' and f_inforce_ind = 1 then 1 else 0 end) as k_inf_cvg_{k.lower()}" for k in TYPES)},
  count(distinct case when inforce_yr >= 10 then pol_num end) as "10yr_pol_cnt",
  cast(sum(cast(coverage_ape as decimal(28, 8))) as double) as total_ape, avg(agt_tenure_yrs) as agt_tenure_yrs,
  {", ".join(f"{text} as {name}" for name, text in CLIENT_FLAGS.items())}
  from valued group by po_num)""", "valued")
_part("policy_type", """
select pol_num, max(type) as ins_typ from line_then join plan using (plan_code) group by 1""", "line_then", "plan")
_part("first_two", """
select po_num, max(case when rn = 1 then pol_num end) as pol_num_1, max(case when rn = 1 then pol_eff_dt end) as pol_eff_dt_1,
  cast(trunc(max(case when rn = 1 then tot_ape end)) as bigint) as tot_ape_1, max(case when rn = 1 then ins_typ end) as ins_typ_1,
  max(case when rn = 2 then pol_num end) as pol_num_2, max(case when rn = 2 then pol_eff_dt end) as pol_eff_dt_2,
  cast(trunc(max(case when rn = 2 then tot_ape end)) as bigint) as tot_ape_2, max(case when rn = 2 then ins_typ end) as ins_typ_2,
  cast(floor(date_diff('day', max(case when rn = 1 then pol_eff_dt end), max(case when rn = 2 then pol_eff_dt end)) / 365.25) as bigint)
    as yr_2nd_prod
from (select p.*, t.ins_typ, row_number() over (partition by po_num order by pol_eff_dt, p.pol_num) as rn
  from policy_then p left join policy_type t on t.pol_num = p.pol_num) where rn <= 2 group by po_num""", "policy_then", "policy_type")
_part("usable_hit", "select * from hit where exclude_hit = 0 and hit_source not in ('5', '7', '8', '9')", "hit")
_part("login", """
select login_id as po_num, max(case when rn = 1 then hit_at end) as registered_at,
  max(case when rn > 1 then hit_at end) as last_login_at, count(*) as hits
from (select *, row_number() over (partition by login_id order by hit_at, event_id) as rn from usable_hit where hit_at < timestamp '2024-02-01 00:00:00')
group by 1""", "usable_hit")
_part("app_hit", """
select event_id, 'u' || user_id as user_id, ts as hit_at, case event_id % 3 when 0 then 'Android' else 'iOS' end as os
from events where event_type not in ('error', 'purchase') and ts < timestamp '2024-02-01 00:00:00'""")
_part("app_login", """
select user_id, max(case when rn > 1 then cast(hit_at as date) end) as last_login_dt, arg_max(os, (hit_at, event_id)) as os
from (select *, row_number() over (partition by user_id order by hit_at, event_id) as rn from app_hit)
group by 1 having max(rn) > 1""", "app_hit")
_part("app_account", """
select * exclude (rn) from (
  select k.cli_num, m.user_id, k.activation_dt, l.last_login_dt, s.last_sync_dt, l.os,
    date_diff('day', k.activation_dt, date '2024-01-31') as app_tenure_days, date_diff('day', l.last_login_dt, date '2024-01-31') as app_last_log_days,
    row_number() over (partition by k.cli_num order by k.activation_dt desc, l.last_login_dt desc, m.user_id desc) as rn
  from (select 'u' || c_custkey as user_id, unnest(case when c_custkey % 4 = 0 then [c_custkey, c_custkey + 1] else [c_custkey] end) as key
      from customer where c_custkey % 8 <> 7) m
  join (select c_custkey as key, cast(c_custkey - case when c_custkey % 5 = 4 then 1 else 0 end as varchar) as cli_num,
      case when c_custkey % 13 <> 12 then date '2023-01-01' + cast(c_custkey * 29 % 420 as integer) end as activation_dt
    from customer where c_custkey % 6 <> 5) k on k.key = m.key and m.key % 9 <> 8
  join app_login l on l.user_id = m.user_id
  left join (select 'u' || c_custkey as user_id, date '2024-01-01' + cast(c_custkey % 40 as integer) as last_sync_dt
    from customer where c_custkey % 3 <> 2) s on s.user_id = m.user_id
  where k.activation_dt <= date '2024-01-31' and l.last_login_dt <= date '2024-01-31') where rn = 1""", "app_login")
_STAGES = dict(zip(codes.LIFESTAGE_FLAGS, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
_CLIENT_MART = f"""
select h.*, v.coverage_ape, v.plan_nbv, v.cli_nbv_margin, v.cli_ltv, v.cli_ltv_pre, v.cli_ltv_post, v.lapse_decile, v.next_due_decile, v.early_decile,
  c.channel, c.channel_final, s.min_decile, n.n_name as city, p.cur_age, p.frst_iss_age, p.no_dpnd, p.mthly_incm / {codes.FX_RATE} as mthly_incm,
  p.customer_segment, p.sex_code, p.dpnd_child_ind, p.dpnd_spouse_ind, case when p.sex_code = 'M' then 1 else 0 end as f_male,
  g.registered_at, g.last_login_at, g.hits, f.* exclude (po_num),
  date_diff('day', cast(g.registered_at as date), date '2024-01-31') as cws_tenure_days,
  date_diff('day', cast(g.last_login_at as date), date '2024-01-31') as cws_last_log_days,
  case when n.n_name = 'NATION_0' then 1 else 0 end as f_first, case when n.n_name = 'NATION_1' then 1 else 0 end as f_second,
  case when n.n_name not in ('NATION_0', 'NATION_1') then 1 else 0 end as f_oth_city,
  ap.activation_dt, ap.app_tenure_days, ap.app_last_log_days,
  {", ".join(f"case when {k}_dt > date '2001-06-30' - interval {n} month then 1 else 0 end as f_{k}chg_{n}m" for k in ("addr", "occp") for n in (1, 3, 6, 12))},
  {", ".join(f"case when p.customer_segment = '{kind}' then 1 else 0 end as {name}" for name, kind in _STAGES.items())},
  {", ".join(f"case when f.ins_typ_{k} = '{kind}' then 1 else 0 end as f_{n}_{kind.lower()}" for k, n in ((1, "1st"), (2, "2nd")) for kind in TYPES)},
  '2001-06-30' as image_date
from holding h join cli_ltv v on v.po_num = h.po_num join channel c on c.po_num = h.po_num and c.channel_final = 'Agency'
left join propensity s on s.po_num = h.po_num left join client p on p.cli_num = h.po_num
left join nation n on n.n_nationkey = p.city_key left join login g on g.po_num = h.po_num left join first_two f on f.po_num = h.po_num
left join app_account ap on ap.cli_num = cast(h.po_num as varchar)
left join (select c_custkey as cli_num, date '2001-06-30' - cast(c_custkey * 7 % 500 as integer) as addr_dt,
  date '2001-06-30' - cast(c_custkey * 11 % 700 as integer) as occp_dt from customer where c_custkey % 3 <> 2) ch on ch.cli_num = h.po_num"""
_CLIENT_NEEDS = ("holding", "cli_ltv", "channel", "propensity", "client", "login", "first_two", "app_account")
_part("client_mart", _CLIENT_MART, *_CLIENT_NEEDS)
_part("client_mart_all", _CLIENT_MART.replace(" and c.channel_final = 'Agency'", ""), *_CLIENT_NEEDS)
