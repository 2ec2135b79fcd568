"""Registered queries: each operator applied to the driver tables, paired with
an equivalent DuckDB SQL statement (the correctness oracle) where one exists.

Registered queries read whole tables; doubles are rounded to 6 dp on both
sides so the order-insensitive value hash does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REG: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in _REG:
            raise ValueError(f"duplicate query {name}")
        _REG[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 dp (applied to registered outputs only)."""
    return df.select([F.round(F.col(f.name), 6).alias(f.name) if f.dataType.simpleString() in ("double", "float")
                      else F.col(f.name) for f in df.schema.fields])


def _load_all():
    from tabwright.catalog import (q_profile, q_clean, q_features, q_prep, q_split,  # noqa: F401
                                   q_evaluate, q_misc, q_models, q_more)


def queries() -> dict[str, Callable]:
    _load_all()
    return {k: v[0] for k, v in _REG.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in _REG.items() if v[1]}
