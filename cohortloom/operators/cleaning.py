"""Schema-driven cleaning: fills, casts, renames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill_by_type(df: DataFrame, number: float = 0, text: str | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """Replace nulls in every numeric column, and in every text column when ``text`` is given."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name not in skip}
    numbers = [name for name, kind in kinds.items() if isinstance(kind, T.NumericType)]
    filled = df.fillna(number, subset=numbers) if numbers else df
    texts = [name for name, kind in kinds.items() if isinstance(kind, T.StringType)]
    return filled.fillna(text, subset=texts) if text is not None and texts else filled


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls column by column, for example with numeric sentinels."""
    return df.fillna(dict(values))


def decimals_to_double(df: DataFrame) -> DataFrame:
    casts = {f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(casts) if casts else df


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def strip_names(df: DataFrame, *parts: str) -> DataFrame:
    """Remove each text from every column name."""
    names = df.columns
    for part in parts:
        names = [c.replace(part, "") for c in names]
    return df.toDF(*names)


def numbers_from_text(df: DataFrame, columns: Sequence[str], kind: str = "int") -> DataFrame:
    """Cast text columns of an untyped file; text that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c in columns})
