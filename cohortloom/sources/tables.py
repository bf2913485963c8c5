"""Reading snapshot tables, files and catalog tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.calendar import Snapshot


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def snapshot_folder(spark: SparkSession, path: str, snapshot: Snapshot, column: str = "image_date") -> DataFrame:
    """One partition folder named by its value, for example ``image_date=2024-05-31``.

    Monthly tables are partitioned by ``YYYY-MM``; their column is ``monthend_dt``.
    """
    value = snapshot.partition if column == "monthend_dt" else str(snapshot)
    return spark.read.parquet(f"{path.rstrip('/')}/{column}={value}")


def at_snapshot(df: DataFrame, snapshot: Snapshot, column: str = "image_date") -> DataFrame:
    """Filter on the partition column, which prunes folders before any file is read."""
    value = snapshot.partition if column == "monthend_dt" else str(snapshot)
    return df.where(F.col(column).cast("string") == value)


def in_snapshot_month(df: DataFrame, snapshot: Snapshot, column: str) -> DataFrame:
    """Rows dated in the month of the snapshot, as a range that a scan can use."""
    first = snapshot.day.replace(day=1)
    return df.where((F.col(column) >= F.lit(first)) & (F.col(column) <= snapshot.column()))


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The columns of ``schema`` in its order and types, whatever ``df`` has.

    Names match in any case. A missing column holds its default or null, a value of another type is cast, or
    null where that is impossible, and columns that the schema does not know are left out.
    """
    present = {c.lower(): c for c in df.columns}
    columns = []
    for field in schema.fields:
        found = present.get(field.name.lower())
        value = F.col(f"`{found}`").try_cast(field.dataType) if found else F.lit((defaults or {}).get(field.name)).cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def united_months(spark: SparkSession, path: str, snapshots: Sequence[Snapshot], schema: T.StructType,
                  defaults: Mapping[str, object] | None = None, column: str = "image_date") -> DataFrame:
    """Months of a snapshot table whose columns changed over time, as one table of ``schema`` and the month.

    Each month is read with the schema of its own files, so a column that came later or changed its type does not
    decide about the other months. Only the folders of the named months are read.
    """
    parts = [
        conform(snapshot_folder(spark, path, s, column), schema, defaults).withColumn(column, F.lit(s.partition if column == "monthend_dt" else str(s)))
        for s in snapshots
    ]
    if not parts:
        return empty_table(spark, schema).withColumn(column, F.lit(None).cast("string"))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = False) -> DataFrame:
    """A CSV file with a header: all text, typed by ``schema``, or inferred."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.csv(path, inferSchema=infer)


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def load_tables(spark: SparkSession, folders: Sequence[str], names: Sequence[str]) -> dict[str, DataFrame]:
    """Load each table from the first folder that has it; keys are upper-case names without slashes."""
    found = {}
    for name in names:
        for folder in folders:
            path = f"{folder.rstrip('/')}/{name.strip('/')}"
            if _exists(spark, path):
                found[name.strip("/").upper()] = parquet_table(spark, path)
                break
        else:
            raise FileNotFoundError(f"{name} is in none of the folders")
    return found


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, **values: object) -> DataFrame:
    """Run one statement; a trailing semicolon is allowed and values are bound as parameters."""
    return spark.sql(text.strip().rstrip(";"), args=values or None)


def empty_table(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)
