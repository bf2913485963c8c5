"""Value, lifetime value, channel and the client mart with its decile profiles."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query, tidy
from cohortloom.catalog.slicing import in_slices, whole
from cohortloom.catalog.sql import CLIENT_FLAGS, TYPES, cut, with_parts, mean_sql
from cohortloom.catalog.windows import app_accounts_of_clients, logins, policy_types
from cohortloom.functions import codes
from cohortloom.functions.bands import decode, flag
from cohortloom.operators import reports
from cohortloom.operators.ordering import ntile_desc
from cohortloom.plans import agent_mart, client_mart
from cohortloom.session import new_folder
from cohortloom.sources.sinks import stage
from cohortloom.sources.star_tables import HIT_SNAPSHOT, SNAPSHOT


def _valued(t, base):
    return client_mart.with_margins(base, t.plan_margins(), t.quarter_margins())


CITIES = {"f_first": "NATION_0", "f_second": "NATION_1"}
_STAGES = dict(zip(codes.LIFESTAGE_FLAGS, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
# Means of the profiles: those of the plan, and the flags and counts that depend on the product types and cities at hand.
MEANS = {
    **client_mart.PROFILE_MEANS, **{f: f"mean_{f[2:]}" for f in (*CITIES, "f_oth_city")}, **{c: f"mean_{c}" for c in TYPES.values()},
    **{f"f_{n}_{kind.lower()}": f"mean_{n}_{kind.lower()}" for n in ("1st", "2nd") for kind in TYPES},
}
ANY_FLAGS = ("f_same_agent", "mdrt_flag", "mdrt_tot_flag", "mdrt_cot_flag", "active_1m_flag")
SUM_FLAGS = ("f_cash", "f_cheque", "f_auto")


def summary(t, any_flags=(), sum_flags=(), of_slice=whole):
    """One row per policy; ``of_slice`` keeps the rows of a slice of the policies."""
    flags = agent_mart.scorecard_flags(t.scorecards(), t.tier_list()).drop("agent_group", "agent_tier") if any_flags else None
    base = client_mart.policy_base(
        of_slice(t.coverage_lines()), of_slice(t.policies()), SNAPSHOT, t.plans(), t.clients(), t.agents(), flags, (t.plan_margins(), t.quarter_margins())
    )
    kind = F.col("lst_pmt_mthd")
    base = base.withColumns({
        "f_same_agent": flag(F.col("sell_code") == F.col("wa_code")), "f_cash": flag(kind == "cash"),
        "f_cheque": flag(kind == "cheque"), "f_auto": flag(kind == "transfer"),
    })
    return client_mart.policy_summary(client_mart.with_value(base), TYPES, any_flags, sum_flags)


def stored_summary(t):
    """The summary, stored."""
    return in_slices(t, "pol_num", lambda of_slice: summary(t, of_slice=of_slice))


def stored_values(t):
    """The summary with every flag and the lifetime values, stored."""
    return in_slices(t, "pol_num", lambda of_slice: client_mart.policy_ltv(
        summary(t, ANY_FLAGS, SUM_FLAGS, of_slice), of_slice(t.lapse_scores()), of_slice(t.early_scores())
    ))


def value_summary(t):
    """The part of the summary that needs no lookups of plan type, owner and agent."""
    return client_mart.policy_summary(_valued(t, client_mart.policy_base(t.coverage_lines(), t.policies(), SNAPSHOT)))


def _scored(t, policies):
    return client_mart.policy_ltv(policies, t.lapse_scores(), t.early_scores())


def policy_values(t):
    return _scored(t, value_summary(t))


def mart(t, channel="Agency"):
    cities = t.branches().select(F.col("br_code").alias("city_key"), F.col("br_nm").alias("city"))
    return client_mart.client_mart(
        client_mart.client_summary(stored_values(t), SNAPSHOT, TYPES, ANY_FLAGS, SUM_FLAGS),
        client_mart.best_propensity(t.existing_scores(), t.new_scores()), t.clients(), cities,
        logins(t).withColumnRenamed("login_id", "po_num"), stage(client_mart.first_two_policies(t.policies(), policy_types(t), SNAPSHOT), new_folder(t.spark)),
        SNAPSHOT, HIT_SNAPSHOT, channel, list(TYPES), CITIES, {kind: codes.LIFESTAGE_FLAGS[name] for name, kind in _STAGES.items()},
        app_accounts_of_clients(t), client_mart.change_flags(t.changes(), SNAPSHOT),
    )


_POL = ("coverage_ape", "plan_nbv", "pol_ltv", "pol_ltv_pre", "pol_ltv_post")
_POL_SQL = ", ".join(f"round({c}, 2) as {c}" for c in _POL)


@query("policy_ltv", with_parts(f"select pol_num, po_num, round(cli_nbv_margin, 6) as cli_nbv_margin, {_POL_SQL} from pol_ltv", "pol_ltv"))
def policy_ltv(t):
    return tidy(policy_values(t).select("pol_num", "po_num", "cli_nbv_margin", *_POL), cents=_POL)


_CLI = ("coverage_ape", "plan_nbv", "cli_ltv", "cli_ltv_pre", "cli_ltv_post")


@query("client_ltv", with_parts(f"select po_num, {', '.join(_CLI)}, cli_nbv_margin, lapse_decile from cli_ltv", "cli_ltv"))
def client_ltv(t):
    return tidy(client_mart.client_ltv(policy_values(t)).select("po_num", *_CLI, "cli_nbv_margin", "lapse_decile"))


@query("channel_priority", with_parts("select po_num, channel, channel_final from channel", "channel"))
def channel_priority(t):
    return client_mart.client_channel(value_summary(t))


_HELD = ["pol_count", "inforce_pol", "lapsed_pol", "surrendered_pol", "matured_pol", "nottaken_pol", "terminated_pol", "oth_paid_pol",
         *TYPES.values(), "annual_flag", "valid_email", "valid_mobile", "10yr_pol_cnt", "ins_typ_count", "multi_prod", "inforce_ind",
         "f_vip_elite", "f_vip_plat", "f_vip_gold", "f_vip_silver"]
_HELD_SQL = ", ".join(f'cast("{c}" as bigint) as "{c}"' for c in _HELD)


@query("client_flags", with_parts(
    "select po_num, " + ", ".join(f"cast({text} as bigint) as {name}" for name, text in CLIENT_FLAGS.items()) + " from valued group by 1", "valued"))
def client_flags(t):
    held = client_mart.client_holdings(summary(t, ANY_FLAGS, SUM_FLAGS), SNAPSHOT, TYPES, ANY_FLAGS, SUM_FLAGS)
    return tidy(held.select("po_num", *ANY_FLAGS, *SUM_FLAGS))


@query("lifestage_flags", "select c_custkey as cli_num, " + ", ".join(
    f"cast(case when c_mktsegment = '{kind}' then 1 else 0 end as bigint) as {name}" for name, kind in _STAGES.items()) + " from customer")
def lifestage_flags(t):
    stage_of = decode(F.col("customer_segment"), {kind: codes.LIFESTAGE_FLAGS[name] for name, kind in _STAGES.items()})
    flags = client_mart.lifestage_flags(F.col("stage"))
    return tidy(t.clients().withColumn("stage", stage_of).select("cli_num", *[c.alias(n) for n, c in flags.items()]))


@query("client_holdings", with_parts(f"""
select po_num, {_HELD_SQL}, cast(first_pol_eff_dt as varchar) as first_pol_eff_dt, round(client_tenure, 6) as client_tenure,
  round(agt_tenure_yrs, 6) as agt_tenure_yrs, round(total_ape, 2) as total_ape from holding""", "holding"))
def client_holdings(t):
    held = client_mart.client_holdings(summary(t), SNAPSHOT, TYPES)
    names = [f"`{c}`" for c in _HELD]
    return tidy(held.select("po_num", *names, "first_pol_eff_dt", "client_tenure", "agt_tenure_yrs", "total_ape"), cents=("total_ape",))


_WIDE = ["pol_count", "inforce_pol", "lapse_decile", "min_decile", "cur_age", "no_dpnd", "f_male", "f_vip_elite", "multi_prod",
         "valid_mobile", "frst_iss_age", *map(client_mart.cover_name, TYPES), *(f"f_{k}chg_{n}m" for k in client_mart.CHANGES for n in client_mart.CHANGE_MONTHS),
         "cws_tenure_days", "cws_last_log_days", "app_tenure_days", "app_last_log_days", "pol_num_1", "pol_num_2", "yr_2nd_prod", "next_due_decile", "early_decile",
         *CITIES, "f_oth_city", *_STAGES, *(f"f_{n}_{kind.lower()}" for n in ("1st", "2nd") for kind in TYPES)]
_MONEY = ["coverage_ape", "plan_nbv", "cli_ltv", "cli_ltv_pre", "cli_ltv_post", "total_ape", "mthly_incm"]
_TEXT = ["channel", "channel_final", "city", "customer_segment", "ins_typ_1", "ins_typ_2", "image_date"]


@query("wide_feature_mart", with_parts(
    "select po_num, " + ", ".join(f"cast({c} as bigint) as {c}" for c in _WIDE) + ", "
    + ", ".join(f"round({c}, 2) as {c}" for c in _MONEY) + ", " + ", ".join(_TEXT) + ", cast(activation_dt as varchar) as activation_dt, round(client_tenure, 6) as client_tenure from client_mart",
    "client_mart"))
def wide_feature_mart(t):
    return tidy(mart(t).select("po_num", *_WIDE, *_MONEY, *_TEXT, "activation_dt", "client_tenure"), cents=tuple(_MONEY))


def _profile(t, buckets, name):
    needed = stage(mart(t).select("po_num", *MEANS), new_folder(t.spark))
    placed = ntile_desc(needed, "cli_ltv", "po_num", buckets, name)
    return tidy(reports.profile(placed, [name], "po_num", MEANS, "customer_count"), 2)


def _profile_sql(buckets, name):
    means = ", ".join(f'{cut(mean_sql(c), 2)} as "{n}"' for c, n in MEANS.items())
    return with_parts(f"""
select cast({name} as bigint) as {name}, count(*) as customer_count, {means}
from (select *, ntile({buckets}) over (order by cli_ltv desc nulls last, po_num) as {name} from client_mart) group by 1""", "client_mart")


@query("decile_profile", _profile_sql(10, "decile"))
def decile_profile(t):
    return _profile(t, 10, "decile")


@query("quintile_profile", _profile_sql(5, "quartile"))
def quintile_profile(t):
    return _profile(t, 5, "quartile")


@query("policy_decile_profile", with_parts(f"""
select cast(poldecile as bigint) as poldecile, count(*) as pol_count, {cut(mean_sql("pol_ltv"), 2)} as mean_ltv,
  {cut(mean_sql("pol_ltv_pre"), 2)} as mean_ltv_pre, {cut(mean_sql("pol_ltv_post"), 2)} as mean_ltv_post
from (select *, ntile(10) over (order by round(pol_ltv, 2) desc nulls last, pol_num) as poldecile from pol_ltv) group by 1""", "pol_ltv"))
def policy_decile_profile(t):
    kept = policy_values(t).select("pol_num", "pol_ltv", "pol_ltv_pre", "pol_ltv_post", F.round("pol_ltv", 2).alias("_rank_value"))
    values = stage(kept, new_folder(t.spark))
    placed = ntile_desc(values, "_rank_value", "pol_num", 10, "poldecile")
    means = {"pol_ltv": "mean_ltv", "pol_ltv_pre": "mean_ltv_pre", "pol_ltv_post": "mean_ltv_post"}
    return tidy(reports.profile(placed, ["poldecile"], "pol_num", means, "pol_count"), 2)
