"""App accounts on hand-made edge rows."""

from datetime import date, datetime

from cohortloom.functions.calendar import Snapshot
from cohortloom.plans import app_accounts

SNAPSHOT = Snapshot.of("2024-01-31")


def _accounts(spark):
    users = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "user_id string")
    members = spark.createDataFrame([("a", "k1"), ("a", "k2"), ("b", "k1"), ("c", None), ("d", "k4"), ("x", "k1"), ("d", "k5"), (None, "k1")], "user_id string, key_id string")
    keys = spark.createDataFrame([
        ("k1", "M10", "2023-05-01 10:00:00", 1), ("k2", "M20", "2023-05-01", 0), ("k4", "M40", None, 1), ("k5", "M", "2023-01-01", 1), (None, "M50", "2023-01-01", 1),
    ], "key_id string, key_value string, activation_date string, activated int")
    states = spark.createDataFrame([("a", "2024-01-05 00:00:00"), ("a", "2024-01-09 00:00:00"), ("b", None)], "user_id string, last_data_sync string")
    return app_accounts.client_accounts(users, members, keys, states)


def test_users_resolve_to_clients_over_two_tables(spark):
    got = {tuple(r) for r in _accounts(spark).collect()}
    assert got == {
        ("a", "10", date(2023, 5, 1), date(2024, 1, 9)), ("b", "10", date(2023, 5, 1), None), ("d", "40", None, None),
    }


def _hits(spark):
    rows = [
        (1, "a", datetime(2024, 1, 1), "Android 9"), (2, "a", datetime(2024, 1, 3), None), (3, "b", datetime(2024, 1, 2), "iOS"),
        (4, "b", datetime(2024, 1, 5, 23), "x Android"), (5, "b", datetime(2024, 2, 1), "iOS"), (6, "d", datetime(2024, 1, 1), "iOS"), (7, None, datetime(2024, 1, 1), "iOS"),
    ]
    return spark.createDataFrame(rows, "event_id long, user_id string, hit_at timestamp, os_version string")


def test_the_first_hit_is_no_login_and_later_months_do_not_count(spark):
    got = {tuple(r) for r in app_accounts.app_logins(_hits(spark), SNAPSHOT).collect()}
    assert got == {("a", date(2024, 1, 3), "iOS"), ("b", date(2024, 1, 5), "Android")}


def test_latest_account_of_a_client(spark):
    logins = app_accounts.app_logins(_hits(spark), SNAPSHOT)
    got = app_accounts.app_activation(_accounts(spark), logins, SNAPSHOT).collect()
    # Same day of activation: the later login decides. No activation day or login: no account.
    assert [(r.cli_num, r.user_id, r.app_tenure_days, r.app_last_log_days) for r in got] == [("10", "b", 275, 26)]
    assert app_accounts.app_activation(_accounts(spark), logins, Snapshot.of("2023-04-30")).count() == 0
    assert app_accounts.app_activation(_accounts(spark).limit(0), logins.limit(0), SNAPSHOT).count() == 0
