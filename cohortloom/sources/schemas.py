"""Schemas of the files that arrive as CSV, and of monthly tables whose columns changed."""

from pyspark.sql import types as T


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


TEXT, WHOLE, NUMBER, DAY = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()

# Column names as they stand in the file headers.
EXISTING_SCORES = T.StructType(
    _fields(TEXT, "cli_num")
    + _fields(WHOLE, "decile_inv", "decile_ci", "decile_lp", "decile_lt", "decile_acc", "decile_med")
)
NEW_SCORES = T.StructType(_fields(TEXT, "po_num") + _fields(WHOLE, "ci_decile", "invst_decile", "lt_decile"))
LAPSE_SCORES = T.StructType(_fields(TEXT, "pol_num") + _fields(WHOLE, "decile") + _fields(NUMBER, "lapse_score"))
CLUSTERS = T.StructType(_fields(TEXT, "po_num") + _fields(WHOLE, "clusters"))
AGENT_MONTH = T.StructType(_fields(T.LongType(), "agt_code") + _fields(TEXT, "agt_nm", "title") + _fields(DAY, "agt_term_dt") + _fields(NUMBER, "balance"))
