"""A chain of monthly marts: customers of a month, then their slicers, then the agents behind them.

Each step reads one month of the store that the step before has written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import codes
from cohortloom.functions.calendar import Snapshot
from cohortloom.functions.measures import exact_sum
from cohortloom.operators.lookups import attach
from cohortloom.plans.activation import latest_servicing_agent, with_bands
from cohortloom.plans.slicers import with_family_groups
from cohortloom.sources.store import MonthlyStore

NO_VIP = ("f_vip_elite", "f_vip_plat", "f_vip_gold", "f_vip_silver")


def customer_month(clients: DataFrame, policies: DataFrame, sold: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Clients with policies up to the snapshot: policies, premium in dollars, serving agent.

    ``sold`` has the agent of each policy as ``sa_code``.
    """
    day = snapshot.column()
    totals = policies.where(F.col("pol_eff_dt") <= day).groupBy("po_num").agg(
        F.count(F.lit(1)).alias("pol_count"), (exact_sum(F.col("tot_ape")) / codes.FX_RATE).alias("total_ape")
    )
    people = attach(clients, totals, {"cli_num": "po_num"}, "inner").withColumnRenamed("cli_num", "po_num")
    return people.join(latest_servicing_agent(sold.where((F.col("pol_eff_dt") <= day) & (F.col("cvg_eff_dt") <= day)), people), "po_num", "left")


def slicer_month(customers: DataFrame) -> DataFrame:
    """A month of customers with bands and family groups."""
    banded = with_bands(customers.withColumns({c: F.lit(0) for c in NO_VIP if c not in customers.columns}), codes.CUSTOMER_BANDS)
    return with_family_groups(banded).drop(*NO_VIP)


def run_months(base: MonthlyStore, slicers: MonthlyStore, months: Sequence[Snapshot]) -> None:
    """The second step for the named months; each reads its own partition of the first store only."""
    for snapshot in months:
        slicers.write(slicer_month(base.read(snapshot)), snapshot)


def agents_of_month(slicers: MonthlyStore, months: DataFrame) -> DataFrame:
    """Per month, agent and family group: customers and premium. ``months`` names the months at run time."""
    return slicers.read_months(months).where("sa_code is not null").groupBy(slicers.column, "sa_code", "group").agg(
        F.countDistinct("po_num").alias("customers"), exact_sum(F.col("total_ape")).alias("total_ape")
    )
