"""The insurance entities read from a TPC-H-like star schema.

orders are policies, lineitem rows are coverages, customers are clients, suppliers are agents,
parts are plans, nations are branches, events are hit logs. Columns the star schema lacks are
derived from its keys by simple rules, so that every status, mode and edge occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.calendar import Snapshot
from cohortloom.session import cut_for, prepare, spread

SNAPSHOT = Snapshot.of("2001-06-30")
HIT_SNAPSHOT = Snapshot.of("2024-01-31")

# Rules for the columns that the star schema lacks.
_STATUS = """case when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then '4' when o_orderstatus = 'O' then '1'
  when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'E' when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' then 'F'
  when o_orderstatus = 'F' then 'B' when o_orderpriority = '5-LOW' then 'R' when o_orderpriority = '4-NOT SPECIFIED' then 'N' else 'A' end"""
_MODE = """case o_orderpriority when '1-URGENT' then '12' when '2-HIGH' then '06' when '3-MEDIUM' then '03' when '4-NOT SPECIFIED' then '01' end"""
_CHANNEL = """case o_orderpriority when '1-URGENT' then '01' when '2-HIGH' then '10' when '3-MEDIUM' then '48'
  when '4-NOT SPECIFIED' then '05' when '5-LOW' then '09' end"""


# The star tables hold far larger premiums than the bands of the study expect, and one agent sells thousands of policies.
STUDY_SCALE, STUDY_MONTHS, STUDY_CUSTOMERS = 2000.0, 27, 7


def study_units(agents: DataFrame) -> DataFrame:
    """Agents with KPIs in the units that the bands of the activation study expect."""
    return agents.withColumns({
        "last_12m_ape": F.col("last_12m_ape") / STUDY_SCALE,
        "agt_tenure_mths": F.col("tenure_mth") - STUDY_MONTHS,
        "cus_existing": F.col("total_cus") % STUDY_CUSTOMERS,
    })


class StarTables:
    """Entity views over one folder of parquet files; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            cut_for(self.spark, [f"{self.folder}/{n}.parquet" for n in self._opened])
        return self._opened[name]

    def policies(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as pol_num",
            "o_custkey as po_num",
            "if(o_orderkey % 3 = 0, o_custkey, o_custkey + o_orderkey % 97) as insrd_num",
            f"{_STATUS} as pol_stat_cd",
            f"{_MODE} as pmt_mode",
            f"{_CHANNEL} as dist_chnl_cd",
            "case o_custkey % 4 when 1 then 'TCB01' when 2 then 'SAG02' when 3 then 'OTH03' end as loc_cd",
            "case o_custkey % 4 when 1 then 'TCB' when 2 then 'SAG' when 3 then 'OTH' end as office_cd",
            "to_date(o_orderdate) as pol_eff_dt",
            "if(o_orderstatus = 'F', date_add(to_date(o_orderdate), int(o_orderkey % 1200)), null) as pol_trmn_dt",
            "date_add(to_date(o_orderdate), int(o_orderkey % 365)) as pd_to_dt",
            "o_totalprice as tot_ape",
            "o_orderkey % 10 as sell_code",
            "case o_orderkey % 3 when 0 then 'cash' when 1 then 'cheque' else 'transfer' end as lst_pmt_mthd",
        )

    def coverage_lines(self) -> DataFrame:
        """Coverages without their policy."""
        return self.raw("lineitem").selectExpr(
            "l_orderkey as pol_num",
            "l_partkey as plan_code",
            "l_suppkey as wa_code",
            "to_date(l_shipdate) as cvg_eff_dt",
            "l_extendedprice as cvg_prem",
            "if(l_returnflag = 'R', 'R', 'B') as cvg_typ",
            "int(l_quantity) as prem_dur",
        )

    def coverages(self) -> DataFrame:
        return self.coverage_lines().join(self.policies(), "pol_num")

    def sold_coverages(self, snapshot: Snapshot) -> DataFrame:
        """Coverages with their policy, both known at the snapshot."""
        day = snapshot.column()
        lines = self.coverage_lines().where(F.col("cvg_eff_dt") <= day)
        return lines.join(self.policies().where(F.col("pol_eff_dt") <= day), "pol_num")

    def clients(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey as cli_num",
            "if(c_custkey % 2 = 0, 'M', 'F') as sex_code",
            "int(20 + c_custkey % 50) as cur_age",
            "int(c_custkey % 4) as no_dpnd",
            "if(c_custkey % 3 = 0, 1, 0) as dpnd_child_ind",
            "if(c_custkey % 5 in (0, 1), 1, 0) as dpnd_spouse_ind",
            "c_acctbal as mthly_incm",
            "c_nationkey as city_key",
            "c_mktsegment as customer_segment",
            "if(c_custkey % 7 != 0, concat('c', c_custkey, '@x.example'), null) as email_addr",
            "if(c_custkey % 6 != 0, concat('+84', 900000000 + c_custkey), null) as mobl_phon_num",
            "int(18 + c_custkey % 45) as frst_iss_age",
            "concat('rule ', c_custkey % 4) as segmentation_rules",
            "if(c_custkey % 11 != 10, double(c_custkey * 17 % 101), null) as `protection_income%`",
        )

    def changes(self) -> DataFrame:
        """Days on which clients changed their address or occupation, some after the snapshot."""
        return self.raw("customer").where("c_custkey % 3 != 2").selectExpr(
            "c_custkey as cli_num",
            """inline(array(
                named_struct('kind', 'addr', 'change_dt', date_sub(date '2001-06-30', int(c_custkey * 7 % 500))),
                named_struct('kind', 'occp', 'change_dt', date_sub(date '2001-06-30', int(c_custkey * 11 % 700))),
                named_struct('kind', 'addr', 'change_dt', date_add(date '2001-06-30', int(c_custkey % 9 + 1)))))""",
        )

    def agents(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey as agt_code",
            "s_name as agt_nm",
            "s_nationkey as br_code",
            "s_suppkey * 13 as own_cli_num",
            "date_add(date '1994-01-01', int(s_suppkey * 37 % 2500)) as agt_join_dt",
            "if(s_suppkey % 10 != 9, 'Agency', 'Partner') as channel",
            "if(s_suppkey % 13 = 12, '9', '1') as agt_stat_code",
            "if(s_suppkey % 17 = 16, date '2001-01-31', null) as agt_term_dt",
            "if(s_suppkey % 3 = 2, '98', '01') as comp_prvd_num",
            "case s_suppkey % 4 when 1 then 'S' when 2 then 'G' when 3 then 'P' end as title",
            "concat('L', s_suppkey % 10) as loc_cd",
        )

    def owner_links(self) -> DataFrame:
        """Links of clients to policies: the owner, an insured, an ended owner; some policies have no owner in force."""
        return self.raw("orders").selectExpr(
            "o_orderkey as pol_num",
            "inline(array(struct(o_custkey as cli_num, 'O' as link_typ, if(o_orderkey % 20 = 0, 'X', 'A') as rec_status), "
            "struct(o_custkey + 1 as cli_num, 'I' as link_typ, 'A' as rec_status), struct(o_custkey + 2 as cli_num, 'O' as link_typ, 'X' as rec_status)))",
        )

    def locations(self) -> DataFrame:
        """Offices of locations; a location of several channels is listed several times."""
        return self.raw("nation").selectExpr(
            "concat('L', n_nationkey % 9) as loc_cd", "if(n_nationkey % 3 = 0, 'BK', 'AG') as chnl", "concat('office ', n_nationkey % 9) as office_cd"
        )

    def code_table(self) -> DataFrame:
        """Texts of codes by field. Lapsed is a status without a text, and one type has two."""
        types = self.raw("part").selectExpr("'INS_TYP' as fld_nm", "p_type as fld_valu", "concat('Type ', lower(p_type)) as fld_valu_desc_eng")
        modes = self.raw("orders").selectExpr("'PMT_MODE'", f"{_MODE}", "lower(o_orderpriority)")
        states = self.raw("orders").selectExpr("'POL_STAT'", f"{_STATUS} as code", f"concat('Status ', {_STATUS})").where("code <> 'B'")
        again = self.raw("part").where("p_type = 'PROMO'").selectExpr("'INS_TYP'", "p_type", "'a second text'")
        return types.union(modes).union(states).union(again).where("fld_valu is not null").distinct()

    def tier_list(self) -> DataFrame:
        """Agents on the yearly list of top producers."""
        return self.raw("supplier").where("s_suppkey % 11 = 0").selectExpr(
            "s_suppkey as agt_code", "case s_suppkey % 33 when 0 then 'TOT' when 11 then 'COT' when 22 then 'MDRT' end as ranking"
        )

    def scorecards(self) -> DataFrame:
        """Activity group and tier code of every agent."""
        return self.raw("supplier").selectExpr(
            "s_suppkey as agt_code",
            "if(s_suppkey % 11 = 0, 'MDRT', 'AGENT') as agent_group",
            "case s_suppkey % 5 when 0 then 'FC' when 1 then 'MBA' when 2 then '1mAA' when 3 then '3mAA' else '3mZ' end as agent_tier",
        )

    def activeness(self) -> DataFrame:
        """Share of the last year's months in which an agent sold nothing."""
        return self.raw("supplier").selectExpr("s_suppkey as agt_code", "s_suppkey * 7 % 12 / 12 as `1yr_agent_activeness`")

    def balances(self) -> DataFrame:
        """Persistency balances: two kinds, two months."""
        return self.raw("supplier").selectExpr(
            "s_suppkey as agt_cd",
            "inline(array(struct('200106' as run_num, 'A214' as acum_cd, s_acctbal as acum_bal), "
            "struct('200106' as run_num, 'A100' as acum_cd, 1.0D as acum_bal), struct('200105' as run_num, 'A214' as acum_cd, 2.0D as acum_bal)))",
        )

    def branches(self) -> DataFrame:
        return self.raw("nation").selectExpr("n_nationkey as br_code", "n_name as br_nm", "n_regionkey as rh_key")

    def region_heads(self) -> DataFrame:
        return self.raw("region").selectExpr("r_regionkey as rh_key", "r_name as rh_name")

    def plans(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey as plan_code", "p_type as type", "if(p_size <= 5, 1, 0) as sp_ind", "p_partkey % 20 / 100 as plan_margin"
        )

    def dated_margins(self) -> DataFrame:
        """Two margins per plan, the second one starting a month and two weeks after the first."""
        start = "add_months(date '1995-01-01', int(p_partkey * 7 % 80))"
        return self.raw("part").selectExpr(
            "p_partkey as plan_code",
            f"""inline(array(
                named_struct('effective_date', {start}, 'nbv_margin', p_size / 100),
                named_struct('effective_date', date_add(add_months({start}, 1), 14), 'nbv_margin', p_size / 200)))""",
        )

    def plan_margins(self) -> DataFrame:
        """Default margin per plan and sales family; some plans lack an agency or bank margin."""
        return self.raw("part").selectExpr(
            "p_partkey as plan_code",
            "if(p_partkey % 6 != 0, p_partkey % 20 / 100, null) as agency",
            "p_partkey % 15 / 100 as direct",
            "p_partkey % 12 / 100 as other",
            "p_partkey % 9 / 100 as affinity",
            "if(p_partkey % 5 != 0, p_partkey % 17 / 100, null) as banca",
            "p_partkey % 18 / 100 as tcb",
            "p_partkey % 16 / 100 as sag",
        )

    def quarter_margins(self) -> DataFrame:
        """Margin per plan and fiscal quarter, 1994 to 2001."""
        plans = spread(self.raw("part").selectExpr("p_partkey as plan_code"), "plan_code", f"{self.folder}/part.parquet", 32)
        return plans.selectExpr("plan_code", "explode(sequence(0, 31)) as q").selectExpr(
            "plan_code",
            "concat(1994 + q div 4, ' Q', q % 4 + 1) as effective_qtr",
            "(plan_code + q) % 25 / 100 as quarter_margin",
        )

    def claims(self) -> DataFrame:
        """Returned coverages are claims; a closed line is an approved claim, an open one is in work."""
        return self.raw("lineitem").where("l_returnflag = 'R'").selectExpr(
            """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'),
                bigint(round(l_extendedprice * 100))) as clm_id""",
            "l_orderkey as pol_num",
            "l_suppkey as wa_code",
            "to_date(l_shipdate) as clm_recv_dt",
            "to_date(l_shipdate) as clm_aprov_dt",
            "if(l_linestatus = 'F', 'A', 'I') as clm_stat_code",
            "l_linenumber as clm_code",
            "l_extendedprice as clm_prvd_amt",
            "l_extendedprice as clm_aprov_amt",
        )

    def hits(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id",
            "user_id as login_id",
            "ts as hit_at",
            "if(event_type = 'error', 1, 0) as exclude_hit",
            "if(event_type = 'signup', '5', '1') as hit_source",
            "event_type as page",
        )

    def app_users(self) -> DataFrame:
        """Users of the app: most clients are one."""
        return self.raw("customer").where("c_custkey % 8 != 7").selectExpr("concat('u', c_custkey) as user_id")

    def app_members(self) -> DataFrame:
        """Members of a user and their keys: every fourth user has a second member, some have no key."""
        return self.raw("customer").selectExpr(
            "concat('u', c_custkey) as user_id",
            "explode(if(c_custkey % 4 = 0, array(c_custkey, c_custkey + 1), array(c_custkey))) as key",
        ).selectExpr("user_id", "if(key % 9 != 8, concat('k', key), null) as key_id")

    def app_keys(self) -> DataFrame:
        """Keys with the client number behind one letter; some clients have two keys, some keys no day."""
        return self.raw("customer").selectExpr(
            "concat('k', c_custkey) as key_id",
            "concat('M', c_custkey - if(c_custkey % 5 = 4, 1, 0)) as key_value",
            "if(c_custkey % 13 != 12, concat(date_add(date '2023-01-01', int(c_custkey * 29 % 420)), ' 08:00:00'), null) as activation_date",
            "if(c_custkey % 6 != 5, 1, 0) as activated",
        )

    def app_states(self) -> DataFrame:
        return self.raw("customer").where("c_custkey % 3 != 2").selectExpr(
            "concat('u', c_custkey) as user_id", "concat(date_add(date '2024-01-01', int(c_custkey % 40)), ' 10:00:00') as last_data_sync"
        )

    def app_hits(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id", "concat('u', user_id) as user_id", "ts as hit_at", "event_type as page",
            "if(event_type = 'error', 1, 0) as exclude_hit", "if(event_type = 'purchase', '9', '1') as hit_source",
            "case event_id % 3 when 0 then 'Android 14' when 1 then 'iOS 17' end as os_version",
        )

    def lapse_scores(self) -> DataFrame:
        """Lapse score and decile of a policy, known for three policies out of four."""
        return self.raw("orders").where("o_orderkey % 4 != 0").selectExpr(
            "o_orderkey as pol_num", "o_orderkey * 7 % 100 / 1000 as lapse_score", "int(o_orderkey * 7 % 10 + 1) as decile"
        )

    def early_scores(self) -> DataFrame:
        return self.raw("orders").where("o_orderkey % 5 != 0").selectExpr(
            "o_orderkey as pol_num", "o_orderkey * 11 % 100 / 500 as p_1", "int(o_orderkey * 11 % 10 + 1) as early_decile"
        )

    def existing_scores(self) -> DataFrame:
        return self.raw("customer").where("c_custkey % 3 != 0").selectExpr(
            "c_custkey as cli_num",
            "int(c_custkey * 3 % 10 + 1) as decile_inv",
            "int(c_custkey * 7 % 10 + 1) as decile_ci",
            "int(c_custkey % 9 + 2) as decile_lp",
            "int(if(c_custkey % 6 != 0, c_custkey % 8 + 3, null)) as decile_lt",
            "int(c_custkey % 7 + 4) as decile_acc",
            "int(c_custkey % 6 + 5) as decile_med",
        )

    def new_scores(self) -> DataFrame:
        return self.raw("customer").where("c_custkey % 4 = 0").selectExpr(
            "c_custkey as po_num",
            "int(c_custkey % 10 + 1) as ci_decile",
            "int(c_custkey * 9 % 10 + 1) as invst_decile",
            "int(c_custkey % 5 + 6) as lt_decile",
        )

    def product_scores(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey as po_num",
            "if(c_custkey % 5 = 4, 'REJECTED', 'APPROVED') as DEPLOYMENT_APPROVAL_STATUS",
            "c_custkey * 3 % 10 / 20 as rep_purchase_comb_health_base_PREDICTION",
            "c_custkey * 7 % 11 / 20 as rep_purchase_comb_inv_base_PREDICTION",
            "c_custkey * 5 % 12 / 20 as rep_purchase_comb_health_rider_PREDICTION",
            "c_custkey % 7 / 20 as rep_purchase_comb_riders_PREDICTION",
        )

    def leads(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey as po_num", "c_custkey * 13 % 1000 / 1000 as p_1")

    def training(self) -> DataFrame:
        """Twelve training columns per agent, null where a course was not finished."""
        return self.raw("supplier").selectExpr(
            "s_suppkey as agt_code",
            "case s_suppkey % 3 when 2 then '98' when 1 then '01' else '77' end as compro",
            "if(s_suppkey % 8 = 7, '02', '01') as stat_cd",
            *[f"if((s_suppkey + {i}) % 5 = 0, 'done', null) as sbw{i:02d}" for i in range(1, 13)],
        )
