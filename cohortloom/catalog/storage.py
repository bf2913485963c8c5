"""Readers and writers, each proven by reading back what was written.

Files go to a new folder per run below the shared folder of the session.
"""

from datetime import date

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query, tidy
from cohortloom.catalog.selection import _MARITAL_SQL
from cohortloom.catalog.sql import band_sql, cut, with_parts
from cohortloom.functions import codes
from cohortloom.functions.calendar import Snapshot, month_end
from cohortloom.plans import chain
from cohortloom.session import new_folder
from cohortloom.sources import schemas, sinks, tables
from cohortloom.sources.star_tables import SNAPSHOT
from cohortloom.sources.store import MonthlyStore


@query("csv_roundtrip", with_parts("select pol_num, cast(decile as bigint) as decile, lapse_score from lapse_score", "lapse_score"))
def csv_roundtrip(t):
    path = new_folder(t.spark)
    sinks.write_report(t.lapse_scores().select("pol_num", "decile", "lapse_score"), path)
    typed = tables.csv_table(t.spark, path, schemas.LAPSE_SCORES)
    return tidy(typed.withColumn("pol_num", F.col("pol_num").cast("long")))


@query("csv_inferred", with_parts("select po_num, round(p_1, 6) as p_1 from lead", "lead"))
def csv_inferred(t):
    path = new_folder(t.spark)
    sinks.write_report(t.leads(), path)
    return tidy(tables.csv_table(t.spark, path, infer=True).withColumn("po_num", F.col("po_num").cast("long")))


@query("partitioned_roundtrip", with_parts("""
select cast(last_day(pol_eff_dt) as varchar) as image_date, count(*) as policies,
  round(sum(case when last_day(pol_eff_dt) = date '2001-06-30' then 2 * tot_ape else tot_ape end), 4) as tot_ape
from policy group by 1""", "policy"))
def partitioned_roundtrip(t):
    """Write all months, replace one of them, and read everything back."""
    path = new_folder(t.spark)
    stamped = t.policies().select(
        "pol_num", "tot_ape", month_end(F.col("pol_eff_dt")).cast("string").alias("image_date")
    )
    # Months meet in few files each, and AQE splits a month that is too large for one task.
    sinks.write_partitions(stamped.hint("rebalance", "image_date"), path)
    # The month is picked by its days, which the scan of the policies can use.
    month = tables.in_snapshot_month(t.policies(), SNAPSHOT, "pol_eff_dt")
    again = month.select("pol_num", (F.col("tot_ape") * 2).alias("tot_ape"), F.lit(str(SNAPSHOT)).alias("image_date"))
    sinks.write_partitions(again, path)
    stored = tables.parquet_table(t.spark, path)
    return tidy(stored.groupBy(F.col("image_date").cast("string").alias("image_date")).agg(
        F.count(F.lit(1)).alias("policies"), F.sum("tot_ape").alias("tot_ape")
    ), 4)


@query("snapshot_folder", with_parts("""
select pol_num, tot_ape from policy where last_day(pol_eff_dt) = date '2001-06-30'""", "policy"))
def snapshot_folder(t):
    path = new_folder(t.spark)
    stamped = t.policies().select("pol_num", "tot_ape", month_end(F.col("pol_eff_dt")).cast("string").alias("image_date"))
    sinks.write_partitions(stamped.hint("rebalance", "image_date"), path)
    return tables.snapshot_folder(t.spark, path, SNAPSHOT).select("pol_num", "tot_ape")


@query("staged_mart", with_parts("select plan_code, count(*) as coverages, round(sum(cvg_prem), 4) as premium from line group by 1", "line"))
def staged_mart(t):
    stored = sinks.stage(t.coverage_lines().select("plan_code", "cvg_prem"), new_folder(t.spark))
    return tidy(stored.groupBy("plan_code").agg(F.count(F.lit(1)).alias("coverages"), F.sum("cvg_prem").alias("premium")), 4)


@query("single_file_report", with_parts("select pol_stat_cd, count(*) as policies from policy group by 1", "policy"))
def single_file_report(t):
    path = new_folder(t.spark)
    sinks.write_single(t.policies().groupBy("pol_stat_cd").agg(F.count(F.lit(1)).alias("policies")), path)
    return tables.parquet_table(t.spark, path)


@query("typed_empty_union", "select cast(c_custkey as varchar) as po_num, cast(c_custkey % 5 as integer) as clusters from customer")
def typed_empty_union(t):
    scored = t.clients().select(
        F.col("cli_num").cast("string").alias("po_num"), (F.col("cli_num") % 5).cast("int").alias("clusters")
    )
    return tables.empty_table(t.spark, schemas.CLUSTERS).unionByName(scored)


@query("sql_views", """
select r_name, count(*) as agents from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
where date '1994-01-01' + cast(s_suppkey * 37 % 2500 as integer) <= date '1998-12-31' group by 1""")
def sql_views(t):
    """Agents by region that had joined by a day, which is a parameter of the statement."""
    tables.register_views({"agents_v": t.agents(), "branches_v": t.branches(), "all_heads_v": t.region_heads()})
    tables.register_views({"heads_v": tables.catalog_table(t.spark, "all_heads_v")})
    return tables.run_sql(t.spark, """
        select rh_name as r_name, count(*) as agents from agents_v join branches_v using (br_code) join heads_v using (rh_key)
        where agt_join_dt <= :upto group by 1;""", upto=date(1998, 12, 31))


@query("table_list", "select n_name, r_name from nation join region on r_regionkey = n_regionkey")
def table_list(t):
    loaded = tables.load_tables(t.spark, [f"{t.folder}/missing", t.folder], ["nation.parquet/", "region.parquet"])
    nation, region = loaded["NATION.PARQUET"], loaded["REGION.PARQUET"]
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_name", "r_name")


_MONTHS = (Snapshot.of("2001-05-31"), SNAPSHOT)
_MONTH_SQL = " union all ".join(f"""
select '{m}' as image_date, h.po_num, total_ape * {factor} as total_ape, sa_code, c.no_dpnd, c.dpnd_child_ind, c.dpnd_spouse_ind
from (select po_num, cast(sum(cast(tot_ape as decimal(28, 8))) as double) / {codes.FX_RATE} as total_ape from policy where pol_eff_dt <= date '{m}' group by 1) h
join client c on c.cli_num = h.po_num left join (select po_num, wa_code as sa_code from (select po_num, wa_code,
    row_number() over (partition by po_num order by pol_eff_dt desc, pol_num desc, wa_code) as rn from cov where cvg_eff_dt <= date '{m}' and pol_eff_dt <= date '{m}')
  where rn = 1) s on s.po_num = h.po_num""" for m, factor in zip(_MONTHS, (2, 1)))


@query("chained_months", with_parts(f"""
select image_date, sa_code, "group", count(distinct po_num) as customers, {cut("cast(sum(cast(total_ape as decimal(28, 8))) as double)", 2)} as total_ape
from (select *, case when mar_stat_cat in ('2. Married', '3. Unknown') and no_dpnd_cat in ('2', '3+') then '1. Family Guardians'
    when mar_stat_cat = '1. Married w/ kids' and no_dpnd_cat in ('1', '2', '3+') then '2. Mature Couples'
    when mar_stat_cat in ('2. Married', '3. Unknown') and no_dpnd_cat = '1' then '3. Younger Couples'
    when no_dpnd_cat = '0' then '4. Personal Protection Seekers' else '5. Unknown' end as "group"
  from (select *, {_MARITAL_SQL} as mar_stat_cat, {band_sql("no_dpnd", *codes.CUSTOMER_BANDS["no_dpnd"])} as no_dpnd_cat from ({_MONTH_SQL})))
where sa_code is not null group by 1, 2, 3""", "policy", "client", "cov"))
def chained_months(t):
    """Two months of customers, one of them replaced, their slicers month by month, and the agents of all months."""
    base, sliced = (MonthlyStore(t.spark, new_folder(t.spark)) for _ in range(2))
    sold = t.coverages().withColumnRenamed("wa_code", "sa_code")
    for month in _MONTHS:
        base.write(chain.customer_month(t.clients(), t.policies(), sold, month), month)
    # The earlier month is restated: its partition alone is written again.
    restated = chain.customer_month(t.clients(), t.policies(), sold, _MONTHS[0]).withColumn("total_ape", F.col("total_ape") * 2)
    base.write(restated, _MONTHS[0])
    chain.run_months(base, sliced, _MONTHS)
    wanted = base.all_months().select("image_date").where(F.col("image_date") >= str(_MONTHS[0]))
    return tidy(chain.agents_of_month(sliced, wanted), 2)


@query("schema_drift", """
select '2001-05-31' as image_date, s_suppkey as agt_code, s_name as agt_nm, cast('' as varchar) as title, cast(null as varchar) as agt_term_dt, round(s_acctbal, 2) as balance
from supplier where s_suppkey % 2 = 0
union all
select '2001-06-30', s_suppkey, s_name, case s_suppkey % 4 when 1 then 'S' when 2 then 'G' when 3 then 'P' end,
  case when s_suppkey % 17 = 16 then '2001-01-31' end, round(s_acctbal, 2) from supplier""")
def schema_drift(t):
    """Two months of one table: the earlier one has text numbers, another case, a column more and two less."""
    path = new_folder(t.spark)
    agents = t.raw("supplier").select(F.col("s_suppkey").alias("agt_code"), F.col("s_acctbal").alias("balance")).join(t.agents(), "agt_code")
    early = agents.where("agt_code % 2 = 0").select(
        F.col("agt_code").cast("int").alias("AGT_CODE"), "agt_nm", F.col("balance").cast("decimal(18,2)").cast("string").alias("balance"), F.lit("x").alias("legacy")
    )
    sinks.write_mart(early, f"{path}/image_date={_MONTHS[0]}")
    sinks.write_mart(agents.select("agt_code", "agt_nm", "title", "agt_term_dt", "balance"), f"{path}/image_date={_MONTHS[1]}")
    return tidy(tables.united_months(t.spark, path, _MONTHS, schemas.AGENT_MONTH, {"title": ""}), 2)
