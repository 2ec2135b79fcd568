"""Boundary rules applied once when a table enters the engine.

pandas treats NaN and NULL alike; Spark keeps them apart and NaN poisons
``avg``/``max``.  Every floating column is normalised with ``nanvl(c, NULL)`` so
inside the engine only NULL exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_boolean(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def dtype_kind(dt: T.DataType) -> str:
    """numeric | bool | string | datetime | other — the four kinds profiling counts."""
    if is_numeric(dt):
        return "numeric"
    if is_boolean(dt):
        return "bool"
    if is_string(dt):
        return "string"
    if is_datetime(dt):
        return "datetime"
    return "other"


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude or ())
    return [f.name for f in df.schema.fields
            if (is_numeric(f.dataType) or is_boolean(f.dataType)) and f.name not in ex]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set(exclude or ())
    return [f.name for f in df.schema.fields if is_string(f.dataType) and f.name not in ex]


def clean_value(c: str | Column, dt: T.DataType | None = None) -> Column:
    """NaN → NULL for floating columns; other types pass through."""
    col = F.col(c) if isinstance(c, str) else c
    if dt is None or isinstance(dt, FLOAT_TYPES):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double")) if dt is not None else col
    return col


def nan_to_null(df: DataFrame, columns=None) -> DataFrame:
    """Normalise NaN to NULL in every float/double column (one narrow projection)."""
    cols = set(columns) if columns else None
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES) and (cols is None or f.name in cols):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def as_double(c: str) -> Column:
    """Numeric value as double with NaN folded into NULL (booleans → 0/1)."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def require_key(df: DataFrame, key: str | None) -> str:
    """Row identity must be an explicit column: the engine never relies on file order."""
    if not key:
        raise ValueError("a row key column is required (file order is not an identity)")
    require_columns(df, [key])
    return key
