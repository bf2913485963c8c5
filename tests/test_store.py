"""Monthly stores, months of changing columns, and texts of codes."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.calendar import Snapshot
from cohortloom.operators import lookups
from cohortloom.session import new_folder
from cohortloom.sources import sinks, tables
from cohortloom.sources.store import MonthlyStore

MAY, JUNE, JULY = (Snapshot.of(d) for d in ("2001-05-31", "2001-06-30", "2001-07-31"))


def _store(spark):
    store = MonthlyStore(spark, new_folder(spark))
    for month, n in ((MAY, 3), (JUNE, 5)):
        store.write(spark.range(n).withColumn("image_date", F.lit("to be replaced")), month)
    return store


def test_a_month_is_replaced_and_others_stay(spark):
    store = _store(spark)
    store.write(spark.range(1), MAY)
    store.write(spark.range(2), JULY)
    counts = {r["image_date"]: r["count"] for r in store.all_months().groupBy("image_date").count().collect()}
    assert counts == {"2001-05-31": 1, "2001-06-30": 5, "2001-07-31": 2}
    assert store.read(JUNE).columns == ["id"] and store.read(Snapshot.of("1999-01-31")).count() == 0


def test_the_next_step_reads_one_partition(spark):
    store = _store(spark)
    month = store.read(JUNE)
    assert month.count() == 5
    # The month is a filter of the scan on partitions, not on rows, so other folders are not read.
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(image_date" in plan and "= 2001-06-30)]" in plan and "Filter (" not in plan.replace("PartitionFilters", "")
    assert {r[0] for r in month.select(F.regexp_extract(F.input_file_name(), "image_date=([0-9-]+)", 1)).collect()} == {"2001-06-30"}


def test_months_found_at_run_time_prune_partitions(spark):
    store = _store(spark)
    chosen = spark.createDataFrame([("2001-06-30", "yes"), ("2001-05-31", "no"), (None, "yes")], "image_date string, wanted string")
    found = store.read_months(chosen.where("wanted = 'yes'"))
    assert found.groupBy("image_date").count().collect() == [("2001-06-30", 5)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_months_of_changing_columns(spark):
    path = new_folder(spark)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("t", T.StringType())])
    sinks.write_mart(spark.createDataFrame([("1", "2.5", 1), ("x", "y", 2)], "K string, v string, gone int"), f"{path}/image_date={MAY}")
    sinks.write_mart(spark.createDataFrame([(3, 1, "t")], "k int, v int, t string"), f"{path}/image_date={JUNE}")
    got = tables.united_months(spark, path, [MAY, JUNE], schema, {"t": "-"})
    assert [f.dataType for f in got.schema.fields[:3]] == [f.dataType for f in schema.fields]
    assert {tuple(r) for r in got.collect()} == {(1, 2.5, "-", "2001-05-31"), (None, None, "-", "2001-05-31"), (3, 1.0, "t", "2001-06-30")}
    assert tables.united_months(spark, path, [], schema).count() == 0


def test_texts_of_several_codes_from_one_table(spark):
    facts = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, None, 8), (4, "a", None), (5, "a", 7)], "id int, c string, d int")
    table = spark.createDataFrame([("C", "a", "A"), ("C", "b", None), ("D", "7", "seven"), ("D", "7", "other"), ("D", "a", "wrong field"), (None, "a", "no field"), ("C", None, "no value")], "fld_nm string, fld_valu string, fld_valu_desc_eng string")
    got = lookups.code_texts(facts, table, {"c": ("C", "c_text"), "d": ("D", "d_text")})
    assert got.columns == ["id", "c", "d", "c_text", "d_text"]
    assert {r["id"]: (r["c_text"], r["d_text"]) for r in got.collect()} == {1: ("A", "other"), 2: (None, "other"), 3: (None, None), 4: ("A", None), 5: ("A", "other")}
    assert lookups.code_texts(facts, table.limit(0), {"c": ("C", "t")}).count() == 5
