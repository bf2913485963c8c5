"""Run-time settings of a session: broadcasts by measured sizes, and how much one task reads."""

import pytest

from cohortloom.operators import lookups
from cohortloom.session import (
    ADVISORY, FINEST, GROWN, MEASURED_BROADCAST, MOST_PER_TASK, MOST_UNMEASURED, SPLIT, STATIC_BROADCAST, cut_for, prepare, size_in_bytes, stored_bytes,
)
from cohortloom.sources.star_tables import StarTables

KEYS = (STATIC_BROADCAST, MEASURED_BROADCAST, ADVISORY, SPLIT, FINEST)


@pytest.fixture
def fresh(spark):
    """The session without the settings that earlier tests made, and with them again afterwards."""
    had = {k: spark.conf.get(k, None) for k in KEYS}
    for k in KEYS:
        spark.conf.unset(k)
    yield spark
    for k, v in had.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    ran = df._jdf.queryExecution()
    ran.toRdd().count()
    return ran.executedPlan().toString().split("Initial Plan")[0]


def test_a_generated_table_is_not_broadcast_by_the_size_of_its_file(fresh, tmp_path):
    fresh.range(0, 40000, 1, 2).selectExpr("id as k", "repeat('x', 200) as pad").write.parquet(f"{tmp_path}/plans")
    fresh.range(0, 60000, 1, 2).selectExpr("id % 50000 as k", "int(id % 32) as q", "id as v").write.parquet(f"{tmp_path}/facts")
    facts = fresh.read.parquet(f"{tmp_path}/facts")
    # 1.28 million rows of about 32 bytes each come from a file of a few hundred KB.
    listed = fresh.read.parquet(f"{tmp_path}/plans").selectExpr("k", "explode(sequence(0, 31)) as q").selectExpr("k", "q", "k + q as m")
    prepare(fresh)
    joined = facts.join(listed, ["k", "q"], "left")
    shape = final_plan(joined)
    assert "SortMergeJoin" in shape and "BroadcastHashJoin" not in shape
    assert joined.selectExpr("count(*) as n", "count(m) as known").first().asDict() == {"n": 60000, "known": 50000}


def test_a_small_table_is_broadcast_once_it_is_measured(fresh, tmp_path):
    fresh.range(0, 200000, 1, 2).selectExpr("id % 3000 as k", "id as v").write.parquet(f"{tmp_path}/facts")
    fresh.range(0, 3000, 1, 1).selectExpr("id as k", "uuid() as name").write.parquet(f"{tmp_path}/owners")
    prepare(fresh)
    joined = lookups.attach(fresh.read.parquet(f"{tmp_path}/facts"), fresh.read.parquet(f"{tmp_path}/owners").withColumnRenamed("k", "o"), {"k": "o"})
    assert "BroadcastHashJoin" in final_plan(joined)
    assert joined.where("name is not null").count() == 200000


def test_limits_of_the_session_stay_where_they_are_lower(fresh):
    fresh.conf.set(STATIC_BROADCAST, "3MB")
    fresh.conf.set(ADVISORY, "2m")
    for _ in range(2):
        prepare(fresh)
        assert (fresh.conf.get(STATIC_BROADCAST), fresh.conf.get(MEASURED_BROADCAST), fresh.conf.get(ADVISORY)) == (str(MOST_UNMEASURED), "3MB", "2m")
    for k in KEYS:
        fresh.conf.unset(k)
    fresh.conf.set(STATIC_BROADCAST, "-1")
    prepare(fresh)
    assert (fresh.conf.get(STATIC_BROADCAST), fresh.conf.get(MEASURED_BROADCAST)) == ("-1", "-1")
    assert size_in_bytes(fresh.conf.get(ADVISORY)) == MOST_PER_TASK


def test_sizes_are_read_as_spark_writes_them():
    assert [size_in_bytes(t) for t in ("-1", "7", "10MB", "64m", "67108864b", "1g", "16KB")] == [-1, 7, 10 * 2**20, 2**26, 2**26, 2**30, 2**14]


def test_shuffles_are_cut_by_the_size_of_the_input(fresh, tmp_path, monkeypatch):
    fresh.range(0, 400000, 1, 4).selectExpr("id as o_orderkey", "uuid() as o_note").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr("cohortloom.session.MOST_PER_TASK", 2**20)
    size = stored_bytes(fresh, [f"{tmp_path}/orders.parquet", f"{tmp_path}/none.parquet"])
    assert size > 10 * 2**20
    orders = StarTables(fresh, str(tmp_path)).raw("orders")
    asked = int(fresh.conf.get(FINEST))
    assert asked == -(-GROWN * size // 2**20) and asked > int(fresh.conf.get("spark.sql.shuffle.partitions"))
    ran = orders.groupBy("o_note").agg({"o_orderkey": "max"})
    assert f", {asked})" in ran._jdf.queryExecution().executedPlan().toString()
    assert ran.count() == 400000
    fresh.conf.set(FINEST, str(asked + 1))
    cut_for(fresh, [f"{tmp_path}/orders.parquet"])
    assert fresh.conf.get(FINEST) == str(asked + 1)


def test_a_task_reads_no_more_of_a_file_than_of_a_shuffle(fresh):
    prepare(fresh)
    assert size_in_bytes(fresh.conf.get(SPLIT)) == MOST_PER_TASK
    fresh.conf.set(SPLIT, "1m")
    prepare(fresh)
    assert fresh.conf.get(SPLIT) == "1m"


def test_quarter_margins_are_made_by_more_tasks_from_a_larger_file(fresh, tmp_path):
    fresh.range(0, 200000, 1, 1).selectExpr("id as p_partkey", "uuid() as p_name").write.parquet(f"{tmp_path}/part.parquet")
    size = stored_bytes(fresh, [f"{tmp_path}/part.parquet"])
    margins = StarTables(fresh, str(tmp_path)).quarter_margins()
    tasks = -(-32 * size // MOST_PER_TASK)
    assert tasks > 8 and margins.rdd.getNumPartitions() == tasks
    assert margins.count() == margins.distinct().count() == 32 * 200000
