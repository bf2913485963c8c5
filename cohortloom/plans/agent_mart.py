"""The agent mart: coverages, rolling KPIs, claims, call lists and the way to the next tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes, measures
from cohortloom.functions.bands import argmax_label, decode, flag, mark
from cohortloom.functions.calendar import Snapshot, month_offset, periods, tenure_text, whole_months
from cohortloom.operators.cleaning import strip_names
from cohortloom.operators.latest import first_per_key, top_list_per_key, top_per_key
from cohortloom.operators.lookups import attach, keep_known, latest_rate, one_per_key, owner_of, owners_of
from cohortloom.operators.ordering import average_rank_desc
from cohortloom.operators.rolling import Distinct, Measure, period_distincts, period_kpis, period_sums, same_names
from cohortloom.session import new_folder, settle
from cohortloom.sources.sinks import stage

ROLLING = ("last_mth", "last_12m", "last_3m", "last_6m", "last_9m")
WITH_YEAR = ("last_yr", *ROLLING)
EARLY_LAPSE_MONTHS = (14, 20, 26)


def training_counts(training: DataFrame, courses: Sequence[str], companies: Sequence[str]) -> DataFrame:
    """Finished courses per agent of the given companies; agents without any are left out."""
    finished = F.expr(" + ".join(f"int({c} is not null)" for c in courses))
    return (
        training.where(F.col("compro").isin(*companies) & (F.col("stat_cd") == "01"))
        .groupBy("agt_code")
        .agg(F.sum(finished).alias("no_sbw_completed"))
        .where(F.col("no_sbw_completed") > 0)
    )


def agent_master(agents: DataFrame, tier_list: DataFrame, training: DataFrame, snapshot: Snapshot,
                 companies: Sequence[str] = ("01", "98")) -> DataFrame:
    """Serving agency agents with tier, tenure and training."""
    serving = agents.where(
        (F.col("channel") == "Agency")
        & (F.col("agt_stat_code") == "1")
        & F.col("agt_term_dt").isNull()
        & F.col("comp_prvd_num").isin(*companies)
    )
    title = decode(F.col("title"), codes.TITLE_NAMES)
    return (
        serving.join(one_per_key(tier_list, ["agt_code"]), "agt_code", "left")
        .join(training, "agt_code", "left")
        .withColumn("mpro_title", title)
        .withColumn("tier", F.coalesce("ranking", "mpro_title", F.lit("Unranked")))
        .withColumn("tenure_mth", whole_months(F.col("agt_join_dt"), snapshot.column()))
        .fillna(0, subset=["no_sbw_completed"])
        .drop("ranking")
    )


def scorecard_flags(scorecard: DataFrame, tier_list: DataFrame) -> DataFrame:
    """Scorecards of one month with the agent's place on the top lists and activity flags."""
    listed = one_per_key(tier_list.where(F.col("ranking").isin(*codes.TOP_LISTS)), ["agt_code"])
    return scorecard.join(listed, "agt_code", "left").withColumns({
        "mdrt_flag": flag(F.col("agent_group") == "MDRT"),
        "mdrt_tot_flag": flag(F.col("ranking") == "TOT"),
        "mdrt_cot_flag": flag(F.col("ranking") == "COT"),
        **{name: flag(F.col("agent_tier") == code) for name, code in codes.ACTIVITY_FLAGS.items()},
    }).drop("ranking")


def persistency_balance(balances: DataFrame, master: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The persistency balance of the snapshot month for serving agents."""
    month = balances.where((F.col("run_num") == snapshot.compact) & (F.col("acum_cd") == codes.PERSISTENCY_KIND))
    return keep_known(month, master, {"agt_cd": "agt_code"}).select(
        F.col("agt_cd").alias("wa_code"), F.col("acum_bal").cast("double").alias("m19_per")
    )


def first_policies(policies: DataFrame) -> DataFrame:
    """The first policy of every owner that came into force."""
    taken = policies.where(~F.col("pol_stat_cd").isin(*codes.VOID_CODES)).select("po_num", "pol_num", "pol_eff_dt")
    return first_per_key(taken, ["po_num"], [F.col("pol_eff_dt"), F.col("pol_num")])


def with_sale_order(coverages: DataFrame, policies: DataFrame) -> DataFrame:
    """Flag coverages of an owner's first policy and of later, repeated sales."""
    first = first_policies(policies).select(F.col("pol_num").alias("frst_pol_num"))
    joined = attach(coverages, first.withColumn("if_first_pol", F.lit(1)), {"pol_num": "frst_pol_num"})
    taken = ~F.col("pol_stat_cd").isin(*codes.VOID_CODES)
    return joined.withColumn("repeated_sales", flag(taken & F.col("if_first_pol").isNull())).fillna(
        0, subset=["if_first_pol"]
    )


def with_premium(coverages: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan attributes, annualised and adjusted premium. ``plans`` has one row per plan."""
    days = F.datediff("pol_trmn_dt", "pol_eff_dt")
    mode, premium = F.col("pmt_mode"), F.col("cvg_prem")
    return (
        coverages.join(plans, "plan_code", "left")
        .withColumn("pol_eff_days", days)
        .withColumn("ape", measures.annualised_premium(premium, mode, F.col("pol_stat_cd")))
        .withColumn(
            "adjust_ape",
            measures.adjusted_premium(F.col("pol_eff_days"), mode, premium, F.col("ape"), F.col("sp_ind")),
        )
    )


def with_value(coverages: DataFrame, margins: DataFrame) -> DataFrame:
    """Margin of the quarter of sale, else the plan's own, and the new business value."""
    dated = latest_rate(
        coverages, margins, "plan_code", "cvg_eff_dt", "effective_date", "nbv_margin", (0, 2), "dated_margin"
    )
    return (
        dated.withColumn("nbv_margin", F.coalesce("dated_margin", "plan_margin"))
        .drop("dated_margin")
        .withColumn("nbv", F.col("adjust_ape") * F.col("nbv_margin"))
    )


def with_relation(coverages: DataFrame, clients: DataFrame) -> DataFrame:
    """Estimated relation of the insured to the owner; clients are looked up in both roles."""
    people = clients.select("cli_num", "cur_age", "sex_code")
    owner = people.select(
        F.col("cli_num").alias("o"), F.col("cur_age").alias("po_age"), F.col("sex_code").alias("po_gender")
    )
    insured = people.select(
        F.col("cli_num").alias("i"), F.col("cur_age").alias("in_age"), F.col("sex_code").alias("in_gender")
    )
    joined = attach(attach(coverages, owner, {"po_num": "o"}), insured, {"insrd_num": "i"})
    is_owner = flag(F.col("po_num") == F.col("insrd_num"))
    gap = F.when(is_owner == 0, F.col("po_age") - F.col("in_age"))
    return joined.withColumns({
        "po_is_cli": is_owner,
        "po_cli_age_gap": gap,
        "po_ins_rela": measures.relation(is_owner, gap, F.col("po_gender"), F.col("in_gender")),
    })


def beneficiary_flags(coverages: DataFrame, code: str = "rel_to_insrd") -> DataFrame:
    """Name of the beneficiary code and whether it is the owner; an unknown code stays null."""
    named = coverages.withColumn("insrd", decode(F.col(code).try_cast("int"), codes.RELATION_CODES))
    return named.withColumn("be_is_cli", (F.col("insrd") == "Self").cast("int"))


def in_snapshot(coverages: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Rows known at the snapshot, stamped with it."""
    known = (F.col("cvg_eff_dt") <= snapshot.column()) & (F.col("pol_eff_dt") <= snapshot.column())
    return coverages.where(known)


# What the KPIs and call lists read; a stage for them needs no more.
KPI_COLUMNS = (
    "wa_code", "pol_num", "po_num", "insrd_num", "type", "po_ins_rela", "pol_stat_cd", "pol_eff_dt", "pol_trmn_dt", "cvg_typ",
    "cvg_eff_dt", "cvg_eff_yr", "last_n_month_eff_cvg", "repeated_sales", "adjust_ape", "nbv",
)
PARTS = ("sale_order", "premium", "value", "relation", "first_date")


def coverage_mart(coverages: DataFrame, policies: DataFrame, master: DataFrame, clients: DataFrame, plans: DataFrame,
                  margins: DataFrame, snapshot: Snapshot, parts: Sequence[str] = PARTS) -> DataFrame:
    """One row per coverage sold by a serving agent, with every measure the KPIs need.

    The stored mart has all ``parts``. A single result that reads the sources directly names the
    parts it uses, since a join whose columns nobody reads still has to be made.
    """
    mart = in_snapshot(coverages, snapshot).join(
        master.select(F.col("agt_code").alias("wa_code"), "tier", "agt_join_dt"), "wa_code"
    )
    if "sale_order" in parts:
        mart = with_sale_order(mart, policies)
    if "premium" in parts:
        mart = with_premium(mart, plans)
    if "value" in parts:
        mart = with_value(mart, margins)
    if "relation" in parts:
        mart = with_relation(mart, clients)
    if "premium" in parts and "relation" in parts:
        mart = mart.withColumn("prd_cus_mix", F.concat_ws("_", "type", "po_ins_rela"))
    mart = with_calendar(mart, snapshot)
    if "first_date" in parts:
        # The earliest day of an insured needs the slim coverages of serving agents only, not the finished mart.
        sold = in_snapshot(coverages, snapshot).join(master.select(F.col("agt_code").alias("wa_code")), "wa_code", "left_semi")
        first = sold.groupBy(F.col("insrd_num").alias("_insured")).agg(F.min("cvg_eff_dt").alias("frst_pol_dt"))
        mart = attach(mart, first, {"insrd_num": "_insured"})
    return mart


def with_calendar(coverages: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Status flags, readable codes and the distances between the dates of a sale."""
    status = F.col("pol_stat_cd")
    return coverages.withColumns({
        "is_non_taken": flag(status.isin(*codes.NOT_TAKEN_CODES)),
        "lapsed": flag(status == codes.LAPSED_CODE),
        "rejected": flag(status == codes.REJECTED_CODE),
        "pol_active": flag(status.isin(*codes.ACTIVE_CODES)),
        "pmt_mode_desc": decode(F.col("pmt_mode").try_cast("int"), codes.PAYMENT_MODES),
        "cvg_eff_yr": F.year("cvg_eff_dt"),
        "year_month": F.date_format("cvg_eff_dt", "yyyy-MM"),
        "pol_eff_yr": F.year("pol_eff_dt"),
        "cvg_eff_mth_from_pol_eff": F.expr("int(months_between(cvg_eff_dt, pol_eff_dt) + 1)"),
        "cvg_eff_mth_from_agt_join": F.expr("int(months_between(cvg_eff_dt, agt_join_dt) + 1)"),
        "cvg_eff_week_from_agt_join": F.expr("int(datediff(cvg_eff_dt, agt_join_dt) / 7) + 1"),
        "pol_eff_mth_from_agt_join": F.expr("int(months_between(pol_eff_dt, agt_join_dt) + 1)"),
        "pol_eff_days_from_agt_join": F.datediff("pol_eff_dt", "agt_join_dt"),
        "last_n_month_eff_cvg": month_offset(F.col("cvg_eff_dt"), snapshot),
        "image_date": F.lit(str(snapshot)),
    })


def _conditions(snapshot: Snapshot) -> dict[str, Column]:
    kept = F.months_between("pol_trmn_dt", "pol_eff_dt")
    return {
        **periods(F.col("cvg_eff_yr"), F.col("last_n_month_eff_cvg"), snapshot),
        "all": F.lit(True),
        **{f"lap_{n}m": kept <= n for n in EARLY_LAPSE_MONTHS},
    }


def _listed(members: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{m}'" for m in members) + ")"


TAKEN = f"pol_stat_cd not in {_listed(codes.VOID_CODES)}"


def premium_measures() -> dict[str, Measure]:
    """Sums of adjusted premium and value: all sales, riders, repeated sales."""
    rider, repeat = f"{TAKEN} and cvg_typ = '{codes.RIDER_CODE}'", f"{TAKEN} and repeated_sales = 1"

    def block(value: str, suffix: str, tail: str, only: str) -> Measure:
        return Measure(value, same_names(WITH_YEAR, suffix, f"{tail}_ytd", f"total_{tail}"), only)

    return {
        "ape": block("adjust_ape", "ape", "ape", TAKEN),
        "nbv": block("nbv", "nbv", "nbv", TAKEN),
        "rider": block("adjust_ape", "rid", "rid_ape", rider),
        "repeat_ape": block("adjust_ape", "rep", "rep_ape", repeat),
        "repeat_nbv": block("nbv", "rep_nbv", "rep_nbv", repeat),
    }


def count_measures() -> dict[str, Distinct]:
    """Distinct owners, insured, policies, product types, relations and bad outcomes."""

    def full(entity: str, suffix: str) -> Distinct:
        return Distinct(entity, same_names(WITH_YEAR, suffix, f"{suffix}_ytd", f"total_{suffix}"), TAKEN)

    every = full("pol_num", "pol")
    early = {f"lap_{n}m": f"lap_{n}m_pol" for n in EARLY_LAPSE_MONTHS}
    not_taken = f"pol_stat_cd in {_listed(codes.NOT_TAKEN_CODES)}"
    lapsed = f"pol_stat_cd = '{codes.LAPSED_CODE}'"
    return {
        "owner": full("po_num", "po"),
        "insured": full("insrd_num", "cus"),
        "policy": Distinct("pol_num", {**every.names, "all": "all_pol_cnt"}, TAKEN),
        "not_taken": Distinct("pol_num", same_names(ROLLING, "NT"), not_taken),
        "rejected": Distinct("pol_num", same_names(ROLLING, "rej"), f"pol_stat_cd = '{codes.REJECTED_CODE}'"),
        "lapsed": Distinct("pol_num", {**same_names(ROLLING, "lap"), **early}, lapsed),
        "product": full("type", "prd"),
        "family": Distinct("po_ins_rela", same_names(ROLLING, "fam"), TAKEN),
    }


def kpi_sums(mart: DataFrame, snapshot: Snapshot, *names: str) -> DataFrame:
    chosen = premium_measures()
    return period_sums(mart, "wa_code", _conditions(snapshot), [chosen[n] for n in names or chosen])


def kpi_counts(mart: DataFrame, snapshot: Snapshot, *names: str) -> DataFrame:
    chosen = count_measures()
    return period_distincts(mart, "wa_code", _conditions(snapshot), [chosen[n] for n in names or chosen])


def kpi_block(mart: DataFrame, snapshot: Snapshot, sums: Sequence[str] = (), counts: Sequence[str] = ()) -> DataFrame:
    """Sums and counts of the named blocks (all of them if none is named) from one reading of the mart."""
    measures_of, counts_of = premium_measures(), count_measures()
    every = not sums and not counts
    return period_kpis(
        mart, "wa_code", _conditions(snapshot), [measures_of[n] for n in (measures_of if every else sums)], [counts_of[n] for n in (counts_of if every else counts)]
    )


def with_ticket_sizes(kpis: DataFrame) -> DataFrame:
    """Average premium per policy and per owner; 1 where nothing was sold."""
    sizes = {
        f"{period}_{entity}_size": measures.ratio_or_one(F.col(f"{period}_ape"), F.col(f"{period}_{entity}"))
        for period in WITH_YEAR for entity in ("pol", "po")
    }
    return kpis.withColumns(sizes)


def with_quality_rates(kpis: DataFrame) -> DataFrame:
    """Shares of policies without a bad outcome.

    Not-taken and rejected policies are outside the count of taken ones, so they are added to
    the denominator; lapsed ones are inside it.
    """
    rates = {}
    for period in ROLLING:
        taken = F.col(f"{period}_pol")
        for bad in ("NT", "rej"):
            rates[f"{period}_{bad}_per"] = measures.kept_rate(F.col(f"{period}_{bad}"), F.col(f"{period}_{bad}") + taken)
        rates[f"{period}_lap_per"] = measures.kept_rate(F.col(f"{period}_lap"), taken)
    for n in EARLY_LAPSE_MONTHS:
        rates[f"{n}m_per"] = measures.kept_rate(F.col(f"lap_{n}m_pol"), F.col("all_pol_cnt"))
    rates["12M_NT_rate"] = measures.kept_rate(F.col("last_12m_NT"), F.col("last_12m_NT") + F.col("last_12m_pol"))
    return kpis.withColumns(rates)


def agent_kpis(mart: DataFrame, snapshot: Snapshot) -> DataFrame:
    """All rolling KPIs, ticket sizes and rates per agent."""
    return with_quality_rates(with_ticket_sizes(kpi_block(mart, snapshot)))


def claim_kpis(claims: DataFrame, policy_agents: DataFrame, snapshot: Snapshot, by: str = "agt_cd") -> DataFrame:
    """Claims of the last three years per agent of the policy."""
    mine = claims.join(policy_agents, "pol_num").where(F.col("clm_recv_dt") <= snapshot.column())
    recent = F.col("clm_recv_dt") >= F.add_months(snapshot.column(), -36)
    lately = F.col("clm_recv_dt") >= F.add_months(snapshot.column(), -12)
    approved, open_ = F.col("clm_stat_code") == "A", F.col("clm_stat_code") == "I"
    # One row per claim first: amounts add up over its rows, the claim itself counts once.
    per_claim = mine.groupBy(by, "clm_id").agg(
        F.max(flag(recent)).alias("c3"),
        F.max(flag(recent & approved)).alias("a3"),
        F.max(flag(lately & open_)).alias("w1"),
        measures.decimal_sum(F.when(recent, F.col("clm_prvd_amt")).otherwise(0.0)).alias("amt"),
        measures.decimal_sum(F.when(recent & approved, F.col("clm_aprov_amt")).otherwise(0.0)).alias("appr_amt"),
    )
    totals = per_claim.groupBy(by).agg(
        F.sum("c3").alias("claim_cnt_last_3_yr"),
        F.sum("amt").cast("double").alias("claim_amt_last_3_yr"),
        F.sum("a3").alias("claim_appr_cnt_last_3_yr"),
        F.sum("appr_amt").cast("double").alias("claim_appr_amt_last_3_yr"),
        F.sum("w1").alias("claim_wip_last_1_yr"),
    )
    rate = F.try_divide(F.col("claim_appr_cnt_last_3_yr"), F.col("claim_cnt_last_3_yr"))
    return totals.where((F.col("claim_cnt_last_3_yr") > 0) | (F.col("claim_wip_last_1_yr") > 0)).withColumn(
        "claim_appr_rate_last_3_yr", rate
    )


def policy_agents(mart: DataFrame) -> DataFrame:
    """The agent responsible for each policy."""
    return owner_of(mart, "pol_num", "wa_code", "cvg_eff_dt").withColumnRenamed("wa_code", "agt_cd")


def risk_lists(scores: DataFrame, agents_of_policy: DataFrame, least: float = 0.05, k: int = 3) -> DataFrame:
    """Up to ``k`` policies most likely to lapse, per agent."""
    risky = scores.where(F.col("lapse_score") >= least).join(agents_of_policy, "pol_num")
    return top_list_per_key(risky, "agt_cd", [F.desc("lapse_score"), F.col("pol_num")], "pol_num", k, "lps_pol_list")


def approved_products(scores: DataFrame) -> DataFrame:
    """Approved product scores as marks; the investment product is marked only when it is the best one."""
    renamed = strip_names(scores, "rep_purchase_comb_", "_PREDICTION")
    best = argmax_label(["health_base", "inv_base", "health_rider", "riders"])
    approved = renamed.where(F.col("DEPLOYMENT_APPROVAL_STATUS") == "APPROVED").withColumn("which_prd", best)
    return approved.withColumns({
        "inv_base": mark(F.col("which_prd") == "inv_base"),
        **{c: mark(F.col(c) > 0.1) for c in ("health_base", "riders", "health_rider")},
    }).drop("DEPLOYMENT_APPROVAL_STATUS")


def lead_owners(mart: DataFrame) -> DataFrame:
    """(po_num, agt_cd, pol_num): the agent and the policy of every owner's latest sale."""
    return owners_of(mart, "po_num", ["wa_code", "pol_num"], "cvg_eff_dt").withColumnRenamed("wa_code", "agt_cd")


def top_leads(leads: DataFrame, products: DataFrame, owners: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best leads per agent that have an approved product and a policy.

    ``owners`` tells the agent and the policy of each owner, in one row per ``po_num``.
    """
    order = [F.desc("p_1"), F.col("po_num")]
    mine = top_per_key(leads.join(owners.where("agt_cd is not null"), "po_num"), ["agt_cd"], order, k)
    offered = mine.where("pol_num is not null").join(products.where(F.col("which_prd").isNotNull()), "po_num")
    return top_per_key(offered, ["agt_cd"], order, k)


def lead_lists(top: DataFrame, k: int = 3) -> DataFrame:
    return top_list_per_key(top, "agt_cd", [F.desc("p_1"), F.col("po_num")], "pol_num", k, "cpm_pol_list")


def with_next_tier(df: DataFrame, tier: str = "tier", ytd: str = "ape_ytd") -> DataFrame:
    """Next tier, its yearly premium and what is still missing; the top tier points to itself."""
    steps = dict(zip(codes.TIER_LADDER, (*codes.TIER_LADDER[1:], codes.TIER_LADDER[-1])))
    next_tier = decode(F.col(tier), steps)
    benchmark = decode(F.col("next_tier"), codes.TIER_BENCHMARKS)
    gap = F.col("next_tier_benchmark") - F.coalesce(F.col(ytd), F.lit(0.0))
    return (
        df.withColumn("next_tier", next_tier)
        .withColumn("next_tier_benchmark", benchmark)
        .withColumn("gap_to_next_tier", F.when(gap < 0, F.lit(0.0)).otherwise(gap))
    )


def agent_scorecard(master: DataFrame, mart: DataFrame, claims: DataFrame, lapse_scores: DataFrame, leads: DataFrame,
                    product_scores: DataFrame, snapshot: Snapshot, kpis: DataFrame | None = None) -> DataFrame:
    """One row per serving agent with sales: everything the agent report shows.

    ``kpis`` are the ``agent_kpis`` of the mart where they are stored already. What comes of all policies or claims is
    stored part by part, so that the shuffles of one part are gone before the next.
    """

    def stored(df: DataFrame) -> DataFrame:
        return stage(df, new_folder(df.sparkSession))

    known = (agent_kpis(mart, snapshot) if kpis is None else kpis).withColumnRenamed("wa_code", "agt_cd")
    agents_of_policy = stored(policy_agents(mart))
    top = top_leads(leads, approved_products(product_scores), lead_owners(mart))
    base = master.select(
        F.col("agt_code").alias("agt_cd"), "agt_nm", "br_code", "tenure_mth", "agt_join_dt", "tier", "no_sbw_completed"
    ).join(known, "agt_cd")
    joined = (
        base.join(stored(claim_kpis(claims, agents_of_policy, snapshot)), "agt_cd", "left")
        .join(stored(risk_lists(lapse_scores, agents_of_policy)), "agt_cd", "left")
        .join(stored(lead_lists(top)), "agt_cd", "left")
    )
    # Ranking compares sums of doubles with themselves, so they must not be added up a second time.
    ranked = average_rank_desc(settle(joined), "last_mth_ape", "rank_of_last_mth_ape")
    return with_next_tier(ranked).withColumns({
        "tenure_ym": tenure_text(F.col("tenure_mth")),
        "image_date": F.lit(str(snapshot)),
    })


def leaderboard(scorecard: DataFrame, n: int = 10) -> DataFrame:
    """Agents up to rank ``n`` by last month's premium, best first."""
    return scorecard.where(
        (F.col("rank_of_last_mth_ape") <= n) & (F.col("last_mth_ape") != 0)
    ).orderBy("rank_of_last_mth_ape", "agt_cd")


def _agent_months(mart: DataFrame) -> DataFrame:
    """Premium per agent and month of the last twelve months, as a decimal."""
    return _last_year(mart).groupBy(F.col("wa_code").alias("agt_cd"), F.col("year_month").alias("date")).agg(
        measures.decimal_sum(F.col("adjust_ape")).alias("avg_ape_agt")
    )


def monthly_sales(mart: DataFrame) -> DataFrame:
    """Premium per agent and month of the last twelve months."""
    return _agent_months(mart).withColumn("avg_ape_agt", F.col("avg_ape_agt").cast("double"))


def average_sales(mart: DataFrame) -> DataFrame:
    """Mean agent premium per month; the fraction of the exact mean is cut off."""
    mean = F.sum("avg_ape_agt") / F.count("avg_ape_agt").cast("decimal(20,0)")
    return _agent_months(mart).groupBy("date").agg(mean.cast("long").alias("avg_ape_tier"))


def product_sales(mart: DataFrame, by_agent: bool = False) -> DataFrame:
    """Premium per product type, per agent on request."""
    source = _last_year(mart).withColumnsRenamed({"type": "prd_type", "wa_code": "agt_cd"})
    if by_agent:
        return source.groupBy("agt_cd", "prd_type").agg(measures.exact_sum(F.col("adjust_ape")).alias("sum_ape_agt"))
    return source.groupBy("prd_type").agg(measures.decimal_sum(F.col("adjust_ape")).cast("long").alias("sum_ape_tier"))


def _last_year(mart: DataFrame) -> DataFrame:
    return mart.where(
        F.col("last_n_month_eff_cvg").between(-12, -1) & ~F.col("pol_stat_cd").isin(*codes.VOID_CODES)
    )
