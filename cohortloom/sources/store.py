"""Monthly marts between the steps of a chain: one partition for each snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.calendar import Snapshot
from cohortloom.sources.sinks import write_partitions
from cohortloom.sources.tables import at_snapshot, parquet_table


@dataclass(frozen=True)
class MonthlyStore:
    """A partitioned table in shared storage that a step writes month by month and the next step reads."""

    spark: SparkSession
    path: str
    column: str = "image_date"

    def write(self, df: DataFrame, snapshot: Snapshot) -> None:
        """Put ``df`` in as that month. A month that is there already is replaced, other months stay."""
        stamped = df.drop(self.column).withColumn(self.column, F.lit(str(snapshot)))
        # Files of a size that AQE picks, however many rows a month has.
        write_partitions(stamped.hint("rebalance"), self.path, (self.column,))

    def read(self, snapshot: Snapshot) -> DataFrame:
        """The rows of one month; no other folder is listed or read."""
        return at_snapshot(self.all_months(), snapshot, self.column).drop(self.column)

    def read_months(self, months: DataFrame) -> DataFrame:
        """The rows of the months that the column of ``months`` holds, known only at run time.

        The join lets Spark prune partitions by the months that it finds.
        """
        chosen = months.select(F.col(self.column).cast("string").alias("_month")).distinct()
        stored = self.all_months()
        return stored.join(chosen, stored[self.column] == chosen["_month"]).drop("_month")

    def all_months(self) -> DataFrame:
        """Every month; the month is text."""
        found = parquet_table(self.spark, self.path).schema
        typed = T.StructType([T.StructField(f.name, T.StringType() if f.name == self.column else f.dataType) for f in found.fields])
        return self.spark.read.schema(typed).parquet(self.path)
