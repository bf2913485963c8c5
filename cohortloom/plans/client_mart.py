"""The client mart: value, lifetime value, channel, holdings, lifestage and digital features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes, measures
from cohortloom.functions.bands import decode, flag
from cohortloom.functions.calendar import Snapshot, fiscal_quarter, whole_years, years_between
from cohortloom.operators.events import days_since
from cohortloom.operators.latest import nth_as_columns
from cohortloom.operators.lookups import attach, code_texts, with_bare_rows

FAMILIES = ("agency", "direct", "other", "affinity", "banca", "tcb", "sag")
# Location prefixes with their own margin.
LOCATION_FAMILIES = {"TCB": "tcb", "SAG": "sag"}


def policy_base(coverages: DataFrame, policies: DataFrame, snapshot: Snapshot, plans: DataFrame | None = None,
                clients: DataFrame | None = None, agents: DataFrame | None = None, agent_flags: DataFrame | None = None,
                margins: Sequence[DataFrame] = ()) -> DataFrame:
    """Policies and their coverages sold up to the snapshot; a policy without coverage stays.

    Plan type, owner and selling agent are looked up where their tables are given, since a
    lookup whose columns nobody reads would still be joined. So are flags of the selling agent, one row per ``agt_code``,
    and the tables of ``margin_options``.

    A coverage is dealt by agent, by plan and by policy, in this order, while it is still narrow; what a policy
    tells of its coverages is added by the last step, and the owner is looked up once for a policy.
    """
    paid, left = measures.premium_years(F.col("cvg_eff_dt"), snapshot.column(), F.col("prem_dur"))
    known = policies.where(F.col("pol_eff_dt") <= snapshot.column())
    sold = coverages.where(F.col("cvg_eff_dt") <= snapshot.column())
    lines = sold
    if agents is not None:
        tenure = years_between(F.col("agt_join_dt"), F.coalesce("agt_term_dt", snapshot.column()))
        sellers = agents.select(
            F.col("agt_code").alias("_seller"),
            F.when(~F.col("comp_prvd_num").isin(*codes.PARTNER_CODES), tenure).alias("agt_tenure_yrs"),
        )
        lines = attach(lines, sellers, {"wa_code": "_seller"})
    if agent_flags is not None:
        lines = attach(lines, agent_flags, {"wa_code": "agt_code"})
    if plans is not None:
        lines = lines.join(plans, "plan_code", "left")
    if margins:
        lines = margin_options(lines, *margins)
    if clients is not None:
        owners = clients.select(
            F.col("cli_num").alias("_owner"), F.col("email_addr").alias("cli_email"), F.col("mobl_phon_num").alias("cli_mobile"), F.col("customer_segment")
        )
        known = attach(known, owners, {"po_num": "_owner"}).withColumns({
            "valid_email": flag(F.col("cli_email").isNotNull()), "valid_mobile": flag(F.col("cli_mobile").isNotNull()),
        })
    return with_bare_rows(lines, known, "pol_num", sold).withColumns({
        "prem_dur_pre": paid,
        "prem_dur_post": left,
        "inforce_yr": whole_years(F.col("pol_eff_dt"), F.coalesce("pol_trmn_dt", snapshot.column())),
        **measures.status_flags(F.col("pol_stat_cd")),
    })


def base_star(policies: DataFrame, links: DataFrame, clients: DataFrame, agents: DataFrame, locations: DataFrame,
              code_table: DataFrame, texts: Mapping[str, tuple[str, str]], agent: str = "agt_code") -> DataFrame:
    """Policies with their owner by link, the owner's contact, the office of the agent's location, and the texts of codes.

    The owner is the client whose link is of type O and in force; a policy without one stays. Offices are those of
    bank locations. ``texts`` maps a code column to its field in the code table and the name of its text.
    """
    owner = links.where((F.col("link_typ") == "O") & (F.col("rec_status") == "A")).groupBy("pol_num").agg(F.min("cli_num").alias("po_num"))
    contact = clients.select(F.col("cli_num").alias("_client"), F.col("email_addr").alias("cli_email"))
    office = locations.where(F.col("chnl") == "BK").groupBy("loc_cd").agg(F.min("office_cd").alias("office_cd"))
    placed = agents.select(F.col("agt_code").alias("_agent"), "loc_cd").join(office, "loc_cd", "left").select("_agent", "loc_cd", "office_cd")
    joined = policies.drop("po_num", "loc_cd", "office_cd").join(owner, "pol_num", "left")
    joined = attach(attach(joined, contact, {"po_num": "_client"}), placed, {agent: "_agent"})
    return code_texts(joined, code_table, texts)


def margin_options(coverages: DataFrame, plan_margins: DataFrame, quarter_margins: DataFrame) -> DataFrame:
    """The margin of the plan, else of its fiscal quarter, for every place of sale that there may be."""
    joined = (
        coverages.withColumn("effective_qtr", fiscal_quarter(F.col("cvg_eff_dt")))
        .join(plan_margins, "plan_code", "left")
        .join(quarter_margins, ["plan_code", "effective_qtr"], "left")
    )
    return joined.withColumns({family: F.coalesce(F.col(family), F.col("quarter_margin")) for family in FAMILIES}).drop("quarter_margin")


def with_margins(base: DataFrame, plan_margins: DataFrame, quarter_margins: DataFrame) -> DataFrame:
    """Margin of the plan, else of its fiscal quarter, chosen by place of sale; then value and premium."""
    return with_value(margin_options(base, plan_margins, quarter_margins))


def with_value(base: DataFrame) -> DataFrame:
    """The one of the ``margin_options`` that the place of sale has; then value and premium."""
    options = {family: F.col(family) for family in FAMILIES}
    margin = measures.channel_margin(F.col("loc_cd"), F.col("dist_chnl_cd"), options, LOCATION_FAMILIES)
    premium = F.col("cvg_prem") / codes.FX_RATE
    return base.withColumns({
        "nbv_margin": margin,
        "plan_nbv": premium * margin,
        "coverage_ape": F.try_divide(premium * 12, F.col("pmt_mode").try_cast("int")),
        "annual_flag": flag(F.col("pmt_mode") == "12"),
        "sales_channel": measures.sales_channel(F.col("dist_chnl_cd"), F.col("office_cd")),
    }).drop(*FAMILIES).where(~F.col("pol_stat_cd").isin(*codes.PENDING_CODES))


def cover_name(kind: str) -> str:
    """Column with the number of coverages in force of a product type."""
    return f"k_inf_cvg_{kind.lower()}"


CHANGES, CHANGE_MONTHS = ("addr", "occp"), (1, 3, 6, 12)


def change_flags(changes: DataFrame, snapshot: Snapshot, kinds: Sequence[str] = CHANGES, months: Sequence[int] = CHANGE_MONTHS) -> DataFrame:
    """(po_num, f_<kind>chg_<n>m): whether the client's last change of a kind up to the snapshot lies in the last ``n`` months."""
    day = snapshot.column()
    last = changes.where(F.col("change_dt") <= day).groupBy(F.col("cli_num").alias("po_num")).agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("change_dt"))).alias(f"_last_{kind}") for kind in kinds]
    )
    return last.select("po_num", *[
        flag(F.col(f"_last_{kind}") > F.add_months(day, -n)).alias(f"f_{kind}chg_{n}m") for kind in kinds for n in months
    ])


def policy_summary(base: DataFrame, types: Mapping[str, str] | None = None, any_flags: Sequence[str] = (),
                   sum_flags: Sequence[str] = ()) -> DataFrame:
    """One row per policy with everything the client level adds up.

    All client measures come from this one pass, and counts of distinct policies become sums.
    The sales channel belongs to the policy, so it is part of the key. ``types`` maps a product
    type to its output column; without it only the values are summed. ``any_flags`` are 1 if any
    coverage has them, ``sum_flags`` count the coverages that do.
    """
    values = [
        measures.exact_sum(F.col("coverage_ape")).alias("coverage_ape"),
        measures.exact_sum(F.col("plan_nbv")).alias("plan_nbv"),
        F.min("prem_dur").alias("years"),
        F.min("prem_dur_pre").alias("years_paid"),
        F.min("prem_dur_post").alias("years_left"),
        F.min("cvg_eff_dt").alias("first_dt"),
    ]
    holdings = [] if types is None else [
        *[F.max(f"f_{name}_ind").alias(f"f_{name}_ind") for name in codes.STATUS_CODES],
        *[F.max(flag(F.col("type") == kind)).alias(name) for kind, name in types.items()],
        F.max("annual_flag").alias("annual_flag"),
        F.max("valid_email").alias("valid_email"),
        F.max("valid_mobile").alias("valid_mobile"),
        *[F.sum(flag((F.col("type") == kind) & (F.col("f_inforce_ind") == 1))).alias(cover_name(kind)) for kind in types],
        F.max(flag(F.col("inforce_yr") >= 10)).alias("long_lived"),
        F.sum("agt_tenure_yrs").alias("tenure_sum"),
        F.count("agt_tenure_yrs").alias("tenure_rows"),
    ]
    flags = [F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in any_flags] + [F.sum(c).alias(c) for c in sum_flags]
    return base.groupBy("po_num", "pol_num", "sales_channel").agg(*values, *holdings, *flags)


def policy_ltv(summary: DataFrame, lapse_scores: DataFrame, early_scores: DataFrame) -> DataFrame:
    """Lifetime value per policy, in total, already earned and still to come, weighted by the chance to stay."""
    scored = summary.join(early_scores.select("pol_num", "early_decile", "p_1"), "pol_num", "left").join(
        lapse_scores.select("pol_num", F.col("decile").alias("next_due_decile"), "lapse_score"), "pol_num", "left"
    )

    def value(years: str) -> Column:
        return measures.lapse_adjusted(F.col("plan_nbv") * F.col(years), F.col("lapse_score"), F.col("p_1"))

    return scored.withColumns({
        "cli_nbv_margin": F.try_divide(F.col("plan_nbv"), F.col("coverage_ape")),
        "pol_ltv": value("years"),
        "pol_ltv_pre": value("years_paid"),
        "pol_ltv_post": value("years_left"),
    })


def _value_sums() -> list[Column]:
    """Lifetime value per client, rounded to cents so that ordering by it is repeatable."""
    return [
        F.round(measures.exact_sum(F.col("coverage_ape")), 2).alias("coverage_ape"),
        F.round(measures.exact_sum(F.col("plan_nbv")), 2).alias("plan_nbv"),
        F.round(F.try_divide(measures.exact_sum(F.col("plan_nbv")), measures.exact_sum(F.col("coverage_ape"))), 6).alias("cli_nbv_margin"),
        *[F.round(measures.exact_sum(F.col(f"pol_ltv{part}")), 2).alias(f"cli_ltv{part}") for part in ("", "_pre", "_post")],
        F.min("next_due_decile").alias("next_due_decile"),
        F.min("early_decile").alias("early_decile"),
        F.least(F.min("next_due_decile"), F.min("early_decile")).alias("lapse_decile"),
    ]


def client_ltv(policy_values: DataFrame) -> DataFrame:
    return policy_values.groupBy("po_num").agg(*_value_sums())


# Channels in order of preference.
CHANNEL_ORDER = ("Agency", "TCB", "SAG")


def _channels() -> list[Column]:
    """The first coverage's channel, and the preferred one among all channels of the client."""
    first = F.min_by("sales_channel", F.struct("first_dt", "pol_num"))
    preferred = [F.when(F.max(flag(F.col("sales_channel") == name)) == 1, name) for name in CHANNEL_ORDER]
    return [first.alias("channel"), F.coalesce(*preferred, first).alias("channel_final")]


def client_channel(summary: DataFrame) -> DataFrame:
    return summary.groupBy("po_num").agg(*_channels())


HOLDINGS = (
    "inforce_pol", "lapsed_pol", "surrendered_pol", "matured_pol", "nottaken_pol", "terminated_pol", "oth_paid_pol",
)


def _holding_sums(types: Mapping[str, str]) -> list[Column]:
    return [
        F.min("first_dt").alias("first_pol_eff_dt"),
        F.count("pol_num").alias("pol_count"),
        *[F.sum(f"f_{kind}_ind").alias(name) for kind, name in zip(codes.STATUS_CODES, HOLDINGS)],
        *[F.sum(name).alias(name) for name in types.values()],
        F.max("annual_flag").alias("annual_flag"),
        F.max("valid_email").alias("valid_email"),
        F.max("valid_mobile").alias("valid_mobile"),
        *[F.sum(cover_name(kind)).alias(cover_name(kind)) for kind in types],
        F.sum("long_lived").alias("10yr_pol_cnt"),
        measures.exact_sum(F.col("coverage_ape")).alias("total_ape"),
        F.try_divide(F.sum("tenure_sum"), F.sum("tenure_rows")).alias("agt_tenure_yrs"),
    ]


def _with_holding_flags(clients: DataFrame, snapshot: Snapshot, types: Mapping[str, str]) -> DataFrame:
    held = sum((flag(F.col(name) > 0) for name in types.values()), F.lit(0))
    return clients.withColumns({
        "client_tenure": years_between(F.col("first_pol_eff_dt"), snapshot.column()),
        "ins_typ_count": held,
        "multi_prod": flag(F.col("pol_count") >= 2),
        "inforce_ind": flag(F.col("inforce_pol") > 0),
        **measures.vip_flags(F.col("total_ape"), F.col("10yr_pol_cnt")),
    })


def client_holdings(summary: DataFrame, snapshot: Snapshot, types: Mapping[str, str], any_flags: Sequence[str] = (),
                    sum_flags: Sequence[str] = ()) -> DataFrame:
    """Policy counts, tenure, VIP tier and flags per client."""
    flags = [F.max(c).alias(c) for c in any_flags] + [F.sum(c).alias(c) for c in sum_flags]
    return _with_holding_flags(summary.groupBy("po_num").agg(*_holding_sums(types), *flags), snapshot, types)


def client_summary(policy_values: DataFrame, snapshot: Snapshot, types: Mapping[str, str], any_flags: Sequence[str] = (),
                   sum_flags: Sequence[str] = ()) -> DataFrame:
    """Holdings, lifetime value and channel per client from one aggregation."""
    flags = [F.max(c).alias(c) for c in any_flags] + [F.sum(c).alias(c) for c in sum_flags]
    summed = policy_values.groupBy("po_num").agg(*_holding_sums(types), *_value_sums(), *_channels(), *flags)
    return _with_holding_flags(summed, snapshot, types)


def first_two_policies(policies: DataFrame, type_of_policy: DataFrame, snapshot: Snapshot) -> DataFrame:
    """First and second policy of every owner up to the snapshot side by side, with the years between them."""
    typed = policies.where(F.col("pol_eff_dt") <= snapshot.column()).select("po_num", "pol_num", "pol_eff_dt", "tot_ape").join(type_of_policy, "pol_num", "left")
    wide = nth_as_columns(
        typed, "po_num", [F.col("pol_eff_dt"), F.col("pol_num")], ["pol_num", "pol_eff_dt", "tot_ape", "ins_typ"], 2
    )
    return wide.withColumns({
        "tot_ape_1": F.col("tot_ape_1").cast("int"),
        "tot_ape_2": F.col("tot_ape_2").cast("int"),
        "yr_2nd_prod": whole_years(F.col("pol_eff_dt_1"), F.col("pol_eff_dt_2")),
    })


def type_flags(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """One flag per product type for the first and the second policy."""
    return df.withColumns({
        f"f_{place}_{kind.lower()}": flag(F.col(f"ins_typ_{n}") == kind)
        for n, place in ((1, "1st"), (2, "2nd")) for kind in types
    })


def best_propensity(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Best decile over all products and both score lists, one row per client."""
    known = existing.select(
        F.col("cli_num").alias("po_num"),
        F.least("decile_inv", "decile_ci", "decile_lp", "decile_lt", "decile_acc", "decile_med").alias("min_decile"),
    )
    fresh = new.select("po_num", F.least("ci_decile", "invst_decile", "lt_decile").alias("min_decile"))
    return known.unionByName(fresh).groupBy("po_num").agg(F.min("min_decile").alias("min_decile"))


def lifestage_flags(segment: Column) -> dict[str, Column]:
    return {name: flag(segment == value) for name, value in codes.LIFESTAGE_FLAGS.items()}


def city_flags(city: Column, cities: Mapping[str, str], other: str = "f_oth_city") -> dict[str, Column]:
    named = {name: flag(city == value) for name, value in cities.items()}
    return {**named, other: flag(~city.isin(*cities.values()))}


def client_mart(summary: DataFrame, propensity: DataFrame, clients: DataFrame, cities: DataFrame, logins: DataFrame,
                first_two: DataFrame, snapshot: Snapshot, hit_snapshot: Snapshot, channel: str | None = "Agency",
                types: Sequence[str] = (), named_cities: Mapping[str, str] | None = None,
                stages: Mapping[str, str] | None = None, apps: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """One wide row per client. Every input has one row per client, so no join multiplies rows.

    ``types`` gives the product types that the first and the second policy are flagged by,
    ``named_cities`` the cities with a flag of their own, and ``stages`` the lifestage that a customer segment stands for.
    ``apps`` are the clients' app accounts (``app_accounts.app_activation``), with the client number as text, and
    ``changes`` their ``change_flags``; a client that never changed anything has 0.
    """
    chosen = summary if channel is None else summary.where(F.col("channel_final") == channel)
    people = clients.join(cities, "city_key", "left").select(
        F.col("cli_num").alias("po_num"), "city", "cur_age", "frst_iss_age", "no_dpnd", "mthly_incm", "customer_segment",
        "sex_code", "dpnd_child_ind", "dpnd_spouse_ind",
    )
    wide = (
        chosen.join(propensity, "po_num", "left")
        .join(people, "po_num", "left")
        .join(logins, "po_num", "left")
        .join(first_two, "po_num", "left")
    )
    if apps is not None:
        known = apps.select(F.col("cli_num").alias("_app_client"), "activation_dt", "app_tenure_days", "app_last_log_days")
        wide = wide.join(known, F.col("po_num").cast("string") == F.col("_app_client"), "left").drop("_app_client")
    if changes is not None:
        wide = wide.join(changes, "po_num", "left").fillna(0, subset=[c for c in changes.columns if c != "po_num"])
    stage = F.col("customer_segment") if stages is None else decode(F.col("customer_segment"), stages)
    wide = type_flags(wide, types) if types else wide
    return wide.withColumns({
        **lifestage_flags(stage),
        **({} if named_cities is None else city_flags(F.col("city"), named_cities)),
        "mthly_incm": F.col("mthly_incm") / codes.FX_RATE,
        "f_male": flag(F.col("sex_code") == "M"),
        "cws_tenure_days": days_since(F.col("registered_at"), hit_snapshot.column()),
        "cws_last_log_days": days_since(F.col("last_login_at"), hit_snapshot.column()),
        "image_date": F.lit(str(snapshot)),
    })


# Names of the profile columns.
PROFILE_MEANS = {
    "cli_ltv": "mean_ltv", "cli_ltv_pre": "mean_ltv_pre", "cli_ltv_post": "mean_ltv_post", "pol_count": "mean_pol",
    "client_tenure": "mean_client_tenure", "f_vip_elite": "mean_platinum_elite", "f_vip_plat": "mean_platinum",
    "f_vip_gold": "mean_gold", "f_vip_silver": "mean_silver", "cur_age": "mean_age", "mthly_incm": "mean_MTHLY_INCM",
    "no_dpnd": "mean_NO_DPND", "inforce_pol": "mean_inf_pol", "lapsed_pol": "mean_lps_pol",
    "surrendered_pol": "mean_srd_pol", "matured_pol": "mean_mat_pol", "nottaken_pol": "mean_ntk_pol",
    "terminated_pol": "mean_ter_pol", "oth_paid_pol": "mean_oth_pol", "lapse_decile": "mean_lapse_decile",
    "ins_typ_count": "mean_ins_type", "yr_2nd_prod": "mean_yr_2nd_prod", "agt_tenure_yrs": "mean_agt_tenure",
    "mdrt_flag": "mdrt%", "mdrt_tot_flag": "mdrt_tot%", "mdrt_cot_flag": "mdrt_cot%", "active_1m_flag": "1mA%",
    "multi_prod": "multi_prod%", "coverage_ape": "mean_ape", "inforce_ind": "mean_inforce_ind",
    "next_due_decile": "mean_next_due_decile", "early_decile": "mean_early_decile", "f_male": "mean_male",
    **{name: f"mean_{name[2:]}" for name in codes.LIFESTAGE_FLAGS},
}
