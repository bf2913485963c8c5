"""First, latest, n-th, running and event-order queries."""

from pyspark.sql import functions as F

from cohortloom.catalog.registry import query, tidy
from cohortloom.catalog.sql import with_parts
from cohortloom.functions import codes
from cohortloom.operators import events, latest
from cohortloom.operators.ordering import ntile_desc
from cohortloom.plans import activation, agent_mart, app_accounts, client_mart
from cohortloom.sources.star_tables import HIT_SNAPSHOT, SNAPSHOT


def usable_hits(t):
    return events.usable_hits(t.hits(), "exclude_hit", "hit_source", ["login_id", "page"], codes.EXCLUDED_HIT_SOURCES)


def logins(t):
    return events.first_and_last_login(usable_hits(t), "login_id", "hit_at", HIT_SNAPSHOT.column())


@query("first_vs_later_events", with_parts("""
select po_num as login_id, strftime(registered_at, '%Y-%m-%d %H:%M:%S') as registered_at, strftime(last_login_at, '%Y-%m-%d %H:%M:%S') as last_login_at, hits
from login""", "login"))
def first_vs_later_events(t):
    shape = "yyyy-MM-dd HH:mm:ss"
    return logins(t).select(
        "login_id", F.date_format("registered_at", shape).alias("registered_at"),
        F.date_format("last_login_at", shape).alias("last_login_at"), "hits",
    )


@query("last_login", with_parts("""
select po_num as login_id, strftime(last_login_at, '%Y-%m-%d %H:%M:%S') as last_login_at from login where last_login_at is not null""", "login"))
def last_login(t):
    """Of every user with a later hit than the registration, the last one up to the snapshot."""
    seen = logins(t).where(F.col("last_login_at").isNotNull())
    return seen.select("login_id", F.date_format("last_login_at", "yyyy-MM-dd HH:mm:ss").alias("last_login_at"))


@query("digital_recency", with_parts("""
select po_num as login_id, date_diff('day', cast(registered_at as date), date '2024-01-31') as cws_tenure_days,
  date_diff('day', cast(last_login_at as date), date '2024-01-31') as cws_last_log_days from login""", "login"))
def digital_recency(t):
    return tidy(logins(t).select(
        "login_id", events.days_since(F.col("registered_at"), HIT_SNAPSHOT.column()).alias("cws_tenure_days"),
        events.days_since(F.col("last_login_at"), HIT_SNAPSHOT.column()).alias("cws_last_log_days"),
    ))


def app_accounts_of_clients(t):
    """The newest used app account of every client."""
    hits = events.usable_hits(t.app_hits(), "exclude_hit", "hit_source", ["user_id", "page"], codes.EXCLUDED_HIT_SOURCES)
    accounts = app_accounts.client_accounts(t.app_users(), t.app_members(), t.app_keys(), t.app_states())
    return app_accounts.app_activation(accounts, app_accounts.app_logins(hits, HIT_SNAPSHOT), HIT_SNAPSHOT)


@query("app_activation", with_parts("""
select cli_num, user_id, cast(activation_dt as varchar) as activation_dt, cast(last_login_dt as varchar) as last_login_dt,
  cast(last_sync_dt as varchar) as last_sync_dt, os, app_tenure_days, app_last_log_days from app_account""", "app_account"))
def app_activation(t):
    return tidy(app_accounts_of_clients(t))


@query("app_os_share", with_parts("""
select os, count(*) as clients, cast(min(app_last_log_days) as bigint) as least_days, cast(max(app_tenure_days) as bigint) as most_tenure
from app_account group by 1""", "app_account"))
def app_os_share(t):
    """Clients by the system of their last login."""
    return tidy(app_accounts_of_clients(t).groupBy("os").agg(
        F.count("*").alias("clients"), F.min("app_last_log_days").alias("least_days"), F.max("app_tenure_days").alias("most_tenure")
    ))


@query("latest_per_key", with_parts("""
select login_id, event_id, page from (select *, row_number() over (partition by login_id order by hit_at desc, event_id desc) as rn from hit)
where rn = 1""", "hit"))
def latest_per_key(t):
    newest = latest.first_per_key(t.hits(), ["login_id"], [F.desc("hit_at"), F.desc("event_id")])
    return newest.select("login_id", "event_id", "page")


@query("first_policy_per_owner", with_parts("select po_num, frst_pol_num from first_policy", "first_policy"))
def first_policy_per_owner(t):
    return agent_mart.first_policies(t.policies()).select("po_num", F.col("pol_num").alias("frst_pol_num"))


@query("latest_servicing_agent", with_parts("""
select po_num, wa_code as sa_code from (select po_num, wa_code, row_number() over (partition by po_num order by pol_eff_dt desc, pol_num desc, wa_code) as rn
  from cov_then where po_num in (select cli_num from client)) where rn = 1""", "cov_then", "client"))
def latest_servicing_agent(t):
    sold = t.sold_coverages(SNAPSHOT).withColumnRenamed("wa_code", "sa_code")
    owners = t.clients().withColumnRenamed("cli_num", "po_num")
    return activation.latest_servicing_agent(sold, owners)


@query("running_min", with_parts("""
select pol_num, po_num, cast(pol_eff_dt as varchar) as pol_eff_dt,
  min(tot_ape) over (partition by po_num order by pol_eff_dt range between unbounded preceding and current row) as least_so_far
from policy""", "policy"))
def running_min(t):
    run = latest.running_min(t.policies(), "po_num", "pol_eff_dt", "tot_ape", "least_so_far")
    return tidy(run.select("pol_num", "po_num", "pol_eff_dt", "least_so_far"))


@query("first_value_desc", with_parts("""
select pol_num, cast(max(clm_aprov_dt) as varchar) as clm_lst_dt, arg_max(clm_aprov_amt, (clm_aprov_dt, clm_id)) as clm_lst_amt from claim group by 1""", "claim"))
def first_value_desc(t):
    return tidy(t.claims().groupBy("pol_num").agg(
        F.max("clm_aprov_dt").alias("clm_lst_dt"), latest.latest_value("clm_aprov_amt", "clm_aprov_dt", "clm_id").alias("clm_lst_amt")
    ))


def policy_types(t):
    """Main product type of a policy at the snapshot."""
    typed = t.coverage_lines().where(F.col("cvg_eff_dt") <= SNAPSHOT.column()).select("pol_num", "plan_code").join(t.plans().select("plan_code", "type"), "plan_code")
    # Distinct pairs first: a maximum over text needs a sort, and far fewer rows are left to sort.
    return typed.select("pol_num", "type").distinct().groupBy("pol_num").agg(F.max("type").alias("ins_typ"))


@query("first_second_policy_pivot", with_parts("""
select po_num, pol_num_1, cast(pol_eff_dt_1 as varchar) as pol_eff_dt_1, tot_ape_1, ins_typ_1, pol_num_2, cast(pol_eff_dt_2 as varchar) as pol_eff_dt_2,
  tot_ape_2, ins_typ_2, yr_2nd_prod, cast(case when ins_typ_1 = 'PROMO' then 1 else 0 end as bigint) as f_1st_promo,
  cast(case when ins_typ_2 = 'PROMO' then 1 else 0 end as bigint) as f_2nd_promo from first_two""", "first_two"))
def first_second_policy_pivot(t):
    return tidy(client_mart.type_flags(client_mart.first_two_policies(t.policies(), policy_types(t), SNAPSHOT), ["PROMO"]))


@query("decile_ntile", with_parts("""
select pol_num, tot_ape, cast(ntile(10) over (order by tot_ape desc, pol_num) as bigint) as decile from policy""", "policy"))
def decile_ntile(t):
    return tidy(ntile_desc(t.policies().select("pol_num", "tot_ape"), "tot_ape", "pol_num", 10))


@query("ntile_with_ties", with_parts("""
select event_id, cast(ntile(7) over (order by login_id desc, event_id) as bigint) as bucket from hit""", "hit"))
def ntile_with_ties(t):
    return tidy(ntile_desc(t.hits().select("event_id", "login_id"), "login_id", "event_id", 7, "bucket").drop("login_id"))
