"""Accounts of the app: users resolved to clients over two key tables, with activation and last login."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.calendar import Snapshot
from cohortloom.operators.events import days_since, first_and_last_login
from cohortloom.operators.latest import first_per_key


def without_first(text: Column) -> Column:
    """The text from its second character on."""
    return F.substring(text, 2, 2**31 - 1)


def os_family(version: Column) -> Column:
    """Android where the version says so, else iOS, also for an unknown version."""
    return F.when(version.contains("Android"), "Android").otherwise("iOS")


def client_accounts(users: DataFrame, members: DataFrame, keys: DataFrame, states: DataFrame) -> DataFrame:
    """(user_id, cli_num, activation_dt, last_sync_dt) of every activated key of a user.

    A user has members, a member has a key, and the key's value is the client number behind one leading
    character. A user of several members and a client behind several keys keep a row each. A key without a
    client number is no account.
    """
    active = keys.where("activated = 1").select("key_id", without_first(F.col("key_value")).alias("cli_num"), F.to_date(F.substring("activation_date", 1, 10)).alias("activation_dt"))
    synced = states.groupBy("user_id").agg(F.max(F.to_date(F.substring("last_data_sync", 1, 10))).alias("last_sync_dt"))
    owned = members.join(active.where("cli_num <> ''"), "key_id").join(users.select("user_id").distinct(), "user_id", "left_semi")
    return owned.join(synced, "user_id", "left").select("user_id", "cli_num", "activation_dt", "last_sync_dt")


def app_logins(hits: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(user_id, last_login_dt, os) of users with a login after their first hit; ``os`` is that of the last hit."""
    day = snapshot.column()
    seen = first_and_last_login(hits, "user_id", "hit_at", day).where("last_login_at is not null")
    known = hits.where(F.col("user_id").isNotNull() & (F.col("hit_at") < F.date_add(day, 1)))
    newest = known.groupBy("user_id").agg(F.max_by("os_version", F.struct("hit_at", "event_id")).alias("os_version"))
    return seen.join(newest, "user_id").select("user_id", F.to_date("last_login_at").alias("last_login_dt"), os_family(F.col("os_version")).alias("os"))


def app_activation(accounts: DataFrame, logins: DataFrame, snapshot: Snapshot) -> DataFrame:
    """One row per client: its newest account, activated and used up to the snapshot.

    Of several accounts the latest activation counts, then the latest login, then the highest user. An
    account without an activation day, or never used after its first hit, does not count.
    """
    day = snapshot.column()
    used = accounts.join(logins, "user_id").where((F.col("activation_dt") <= day) & (F.col("last_login_dt") <= day))
    newest = first_per_key(used, ["cli_num"], [F.desc("activation_dt"), F.desc("last_login_dt"), F.desc("user_id")])
    return newest.select(
        "cli_num", "user_id", "activation_dt", "last_login_dt", "last_sync_dt", "os",
        days_since(F.col("activation_dt"), day).alias("app_tenure_days"), days_since(F.col("last_login_dt"), day).alias("app_last_log_days"),
    )
