"""Set operations and row-weight helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.plans.ordering import global_row_number


def append_tagged(frames: dict, tag: str = "source") -> DataFrame:
    """U1/U2 — union by name with a tag column telling where each row came from."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def append_weighted(data: DataFrame, extra: DataFrame, weight: str = "weight", extra_weight: float = 10.0) -> DataFrame:
    """U3 — training rows (weight 1) plus corrected/penalty rows (given weight)."""
    return data.withColumn(weight, F.lit(1.0)).unionByName(extra.withColumn(weight, F.lit(float(extra_weight))),
                                                           allowMissingColumns=True)


def real_vs_shuffled(df: DataFrame, key: str, columns, seed: int = 42, label: str = "is_real") -> DataFrame:
    """U4 — the table plus a synthetic copy whose columns are permuted
    independently (each column re-attached by a hash-rank join), labelled 1/0."""
    base = global_row_number(df.select(key), [F.col(key)], "_tw_r")
    syn = base
    for j, c in enumerate(columns):
        src = global_row_number(df.select(key, F.col(c).alias("_v")), [F.xxhash64(key, F.lit(seed), F.lit(j)), F.col(key)],
                                "_tw_r")
        syn = syn.join(src.select("_tw_r", F.col("_v").alias(c)), "_tw_r")
    real = df.select(key, *columns).withColumn(label, F.lit(1))
    fake = syn.select(F.col(key), *columns).withColumn(label, F.lit(0))
    return real.unionByName(fake)


def column_difference(a: DataFrame, b: DataFrame) -> list:
    """U5 — names in a but not in b (schema arithmetic)."""
    bs = set(b.columns)
    return [c for c in a.columns if c not in bs]


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """U6 — rows of a not present in b (multiset difference)."""
    return a.exceptAll(b.select(*a.columns))


def append_rows(table: DataFrame, new_rows: DataFrame) -> DataFrame:
    """U7 — new experiment rows appended by column name (missing → NULL)."""
    return table.unionByName(new_rows, allowMissingColumns=True)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """T4 — exactly ``n`` rows without replacement, deterministic (hash order)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def poisson_weights(df: DataFrame, key: str, b: int, seed: int = 42, name: str = "w") -> DataFrame:
    """T5 — bootstrap as Poisson(1) weights from a hash of (key, b)."""
    import math
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(b)), F.lit(1 << 40)).cast("double")) / float(1 << 40)
    cdf, acc, p = [], 0.0, math.exp(-1.0)
    for k in range(12):
        acc += p
        cdf.append(acc)
        p /= (k + 1)
    w = F.lit(12)
    for k in reversed(range(12)):
        w = F.when(u < F.lit(cdf[k]), F.lit(k)).otherwise(w)
    return df.withColumn(name, w.cast("double"))


def append_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """J4 — column-wise append of two tables aligned on ``key`` (equi-join, not
    position); on a name clash the left table's column wins."""
    extra = [c for c in right.columns if c != key and c not in left.columns]
    return left.join(right.select(key, *extra), key, "left")
