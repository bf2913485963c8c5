"""The agent activation study: bands, scope, waterfalls, profiles and performance segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions.bands import band, first_match, flag, ordinal
from cohortloom.functions.calendar import Snapshot
from cohortloom.operators.latest import first_per_key
from cohortloom.operators.lookups import attach, keep_known
from cohortloom.operators.ordering import percentiles


def with_bands(df: DataFrame, bands: dict[str, tuple[Sequence[float], Sequence[str]]]) -> DataFrame:
    """Add ``<column>_cat`` for every column that has bands and is present."""
    return df.withColumns({
        f"{c}_cat": band(F.col(f"`{c}`"), edges, labels) for c, (edges, labels) in bands.items() if c in df.columns
    })


def first_manager(hierarchy: DataFrame, levels: Sequence[str], name: str = "first_sm_name") -> DataFrame:
    """The nearest manager of a location: the first level that is filled."""
    return hierarchy.withColumn(name, F.coalesce(*levels))


def recency(last_policies: Sequence[str] = ("last_mth_pol", "last_3m_pol", "last_6m_pol", "last_9m_pol", "last_12m_pol")) -> Column:
    """How long ago the agent last sold."""
    *labels, none = codes.RECENCY_LABELS
    return first_match([(F.col(c) > 0, label) for c, label in zip(last_policies, labels)], none)


def activity(df: DataFrame) -> DataFrame:
    """Active with a sale in nine months; an unknown count is inactive."""
    active = F.coalesce(F.col("last_9m_pol") > 0, F.lit(False))
    return df.withColumns({
        "manager_0_active": F.when(active, "Active").otherwise("Inactive"),
        "f_agt_inactive": flag(~active),
        "last_pol_cat": recency(),
    })


def target_conditions() -> list[Column]:
    """What a target agent must have, in waterfall order."""
    return [
        F.col("agt_tenure_mths_cat") == ">1 year",
        F.col("last_12m_ape_cat").isin("5-7k", "7-10k", "10k+"),
        F.col("cus_existing_cat") == ">2 customers",
        F.col("14m_per_cat") == "70%+",
    ]


def with_target(df: DataFrame) -> DataFrame:
    every = target_conditions()
    return df.withColumn("f_target_agent", flag(every[0] & every[1] & every[2] & every[3]))


def latest_servicing_agent(policies: DataFrame, owners: DataFrame, agent: str = "sa_code") -> DataFrame:
    """The agent of the newest policy of every owner in ``owners``."""
    mine = keep_known(policies.select("po_num", "pol_num", "pol_eff_dt", agent), owners, {"po_num": "po_num"})
    return first_per_key(mine, ["po_num"], [F.desc("pol_eff_dt"), F.desc("pol_num"), F.col(agent)]).select("po_num", agent)


def in_scope_agents(agents: DataFrame, servicing: DataFrame, agent: str = "sa_code") -> DataFrame:
    """Agents that serve at least one owner, with the number of owners."""
    served = servicing.groupBy(agent).agg(F.countDistinct("po_num").alias("po_num_count"))
    return attach(agents, served, {"agt_code": agent}, "inner").withColumn("in_scope", F.lit(1))


def rider_counts(coverages: DataFrame, policies: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(po_num, rider_cnt) of owners with a rider sold up to the snapshot.

    Riders are counted per policy before they meet the policies, so the facts stay as narrow as they are.
    """
    day = snapshot.column()
    riders = coverages.where((F.col("cvg_typ") == codes.RIDER_CODE) & (F.col("cvg_eff_dt") <= day)).groupBy("pol_num").agg(F.count(F.lit(1)).alias("riders"))
    owned = policies.where(F.col("pol_eff_dt") <= day).select("pol_num", "po_num").join(riders, "pol_num")
    return owned.groupBy("po_num").agg(F.sum("riders").alias("rider_cnt"))


def customers_with_agents(customers: DataFrame, servicing: DataFrame, agents: DataFrame, agent: str = "sa_code") -> DataFrame:
    """Customers next to the agent that serves them; customers without one stay."""
    return attach(customers.join(servicing, "po_num", "left"), agents, {agent: "agt_code"})


def performance_segments(df: DataFrame, metrics: Sequence[str], deciding: Sequence[str] = ("po_num_count", "all_pol_cnt")) -> DataFrame:
    """Top, high or low performers by the upper and lower quartile of either deciding metric."""
    limits = {row["metric"]: row for row in percentiles(df, metrics, [0.75, 0.25]).collect()}  # one row per metric

    def reaches(point: str) -> Column:
        checks = [F.col(m) >= F.lit(limits[m][point]) for m in deciding if m in limits]
        result = F.lit(False)
        for check in checks:
            result = result | F.coalesce(check, F.lit(False))
        return result

    top, high, low = codes.PERFORMANCE_LABELS
    return df.withColumn("segment", first_match([(reaches("p75"), top), (reaches("p25"), high)], low))


def tier_place(tier: str = "tier") -> Column:
    """1 for unranked up to 7 for the top tier, 0 for anything else."""
    return ordinal(F.col(tier), codes.TIER_LADDER)


def ranked_agents(segments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Agents with their segment, best segment first, without repeated rows."""
    merit = ordinal(F.col("segment"), codes.PERFORMANCE_LABELS)
    return segments.select("segment", *columns).distinct().orderBy(merit, "agt_cd")
