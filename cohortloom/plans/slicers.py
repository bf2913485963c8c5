"""Customer slicers and family groups for the campaign base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions.bands import band, first_match
from cohortloom.functions.calendar import Snapshot
from cohortloom.functions.measures import decimal_sum, exact_sum
from cohortloom.operators.cleaning import fill_by_type, lower_names
from cohortloom.operators.latest import latest_value
from cohortloom.operators.lookups import attach
from cohortloom.plans.activation import with_bands


def agent_premium(policies: DataFrame, snapshot: Snapshot, agent: str = "wa_code") -> DataFrame:
    """Premium in dollars of all policies an agent sold up to the snapshot."""
    taken = policies.where(~F.col("pol_stat_cd").isin(*codes.VOID_CODES))
    known = F.when(F.col("pol_eff_dt") <= snapshot.column(), F.col("tot_ape") / codes.FX_RATE)
    return taken.groupBy(agent).agg(exact_sum(known).alias("agt_total_ape"))


def claims_last_6m(claims: DataFrame, policies: DataFrame, snapshot: Snapshot,
                   claim_codes: Sequence[int] = codes.CLAIM_CODES) -> DataFrame:
    """Approved claims of the last six months per owner, with the newest date and amount.

    Claims are reduced to one row per policy before they meet the policies.
    """
    since = F.add_months(snapshot.column(), -6)
    counted = claims.where(
        (F.col("clm_aprov_dt") > since)
        & (F.col("clm_aprov_dt") <= snapshot.column())
        & (F.col("clm_stat_code") == "A")
        & F.col("clm_code").isin(*claim_codes)
    )
    per_policy = counted.groupBy("pol_num").agg(
        F.count("clm_id").alias("cnt"),
        decimal_sum(F.col("clm_aprov_amt")).alias("amt"),
        F.max("clm_aprov_dt").alias("lst_dt"),
        latest_value("clm_aprov_amt", "clm_aprov_dt", "clm_id").alias("lst_amt"),
    )
    taken = policies.where(~F.col("pol_stat_cd").isin(*codes.VOID_CODES)).select("pol_num", "po_num")
    return taken.join(per_policy, "pol_num").groupBy("po_num").agg(
        F.sum("cnt").alias("clm_6m_cnt"),
        (F.sum("amt").cast("double") / codes.FX_RATE).alias("clm_6m_amt"),
        F.max("lst_dt").alias("clm_lst_dt"),
        latest_value("lst_amt", "lst_dt", "pol_num").alias("clm_lst_amt"),
    )


def campaign_base(customers: DataFrame, products: DataFrame, claims: DataFrame, agents: DataFrame,
                  agent_totals: DataFrame) -> DataFrame:
    """Customers with premium who are no agents, with every slicer of the campaign.

    ``products`` and ``claims`` have one row per ``po_num``, ``agents`` one per ``agt_cd`` and
    ``agent_totals`` one per ``wa_code``; so no customer is repeated.
    """
    kept = customers.where((F.col("total_ape") > 0) & (F.col("f_owner_is_agent") == 0))
    joined = kept.join(products, "po_num", "left").join(claims, "po_num", "left")
    joined = attach(attach(joined, agents, {"sa_code": "agt_cd"}), agent_totals, {"sa_code": "wa_code"})
    filled = fill_by_type(lower_names(joined), 0, skip=["po_num", "sa_code"])
    return with_family_groups(with_bands(with_claim_ratio(filled), codes.CUSTOMER_BANDS))


def with_claim_ratio(df: DataFrame) -> DataFrame:
    """Claims of six months as a fraction of yearly premium."""
    return df.withColumn("clm_6m_ratio", F.try_divide(F.col("clm_6m_amt"), F.round("total_ape", 4)))


def with_family_groups(df: DataFrame) -> DataFrame:
    """Marital status, VIP class and one of four family groups. Needs ``no_dpnd_cat``."""
    with_kids, married, unknown = codes.MARITAL_LABELS
    marital = first_match([(F.col("dpnd_child_ind") == 1, with_kids), (F.col("dpnd_spouse_ind") == 1, married)], unknown)
    vip_columns = ("f_vip_elite", "f_vip_plat", "f_vip_gold", "f_vip_silver")
    vip = first_match(
        [(F.col(c) == 1, label) for c, label in zip(vip_columns, codes.VIP_LABELS)], codes.VIP_LABELS[-1]
    )
    status, dependants = F.col("mar_stat_cat"), F.col("no_dpnd_cat")
    guardians, mature, younger, personal, none = codes.FAMILY_LABELS
    group = first_match([
        (status.isin(married, unknown) & dependants.isin("2", "3+"), guardians),
        ((status == with_kids) & dependants.isin("1", "2", "3+"), mature),
        (status.isin(married, unknown) & (dependants == "1"), younger),
        (dependants == "0", personal),
    ], none)
    return df.withColumn("mar_stat_cat", marital).withColumn("cus_vip_cat", vip).withColumn("group", group)


# The bands of the three breakdown reports.
BREAKDOWNS = {
    "affinity": ("segmentation_rules", "which_prd", "age_grp", "adj_mthly_incm_cat", "protection_income_grp", "tenure_grp"),
    "family": (
        "mar_stat_cat", "no_dpnd_cat", "age_grp", "adj_mthly_incm_cat", "protection_income_grp", "protection_income%_cat",
        "ins_typ_count_cat", "clm_6m_ratio_cat", "tenure_grp", "cus_vip_cat",
    ),
    "groups": ("group", "protection_income%_cat", "segmentation_rules", "cur_age_cat"),
}


def with_report_bands(base: DataFrame) -> DataFrame:
    """The campaign base with the bands that only the breakdown reports use.

    ``age_grp`` and ``tenure_grp`` are the profiling intervals, ``protection_income_grp`` tells whether half of
    the income is protected.
    """
    banded = with_bands(base, codes.PROTECTION_BANDS)
    protected = F.col("`protection_income%`")
    return banded.withColumns({
        "age_grp": band(F.col("cur_age"), codes.PROFILE_EDGES["cur_age"], include_lowest=False),
        "tenure_grp": band(F.col("client_tenure"), codes.PROFILE_EDGES["client_tenure"], include_lowest=False),
        "protection_income_grp": first_match([(protected <= 50, "protected"), (protected > 50, "gap")]),
    })
