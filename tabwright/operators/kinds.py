"""Column-kind detection (G11, G12) — the 12-kind profile of a table.

Two aggregate passes cover all columns: pass 1 (counts, distinct counts,
moments, exact quartiles through the value ladder), pass 2 (share of values
outside 1.5·IQR).  String rules read the first 20 / 10 non-null values in key
order through a distributed top-k (``orderBy(key).limit(k)``), never a
whole-column window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.functions.scalar import MOLECULE_ALPHABET_PATTERN, MOLECULE_ATOM_PATTERN
from tabwright.plans.ordering import exact_quantiles, stack_columns

# Kind names, thresholds and the molecule-name hints.
KINDS = ["binary", "category_low", "category_high", "numeric_normal", "numeric_log", "numeric_power",
         "numeric_outlier", "periodic", "datetime", "text", "constant", "smiles"]
CARDINALITY_THRESHOLD = 20
SKEWNESS_THRESHOLD = 0.5
OUTLIER_IQR_FACTOR = 1.5
OUTLIER_SHARE = 0.05
TEXT_MEAN_LENGTH = 50
SMILES_NAME_HINTS = ["smiles", "smi", "structure", "mol", "compound"]
COLLECT_LIMIT = 1000   # value counts go to the driver only for columns with fewer distinct values than this estimate


def detect_column_types(df: DataFrame, key: str | None = None, periodic_cols=(), columns=None,
                        smiles_by_name: bool = True, stats_out: dict | None = None) -> DataFrame:
    """G11 — profile frame: col_name, col_type, n_unique, null_rate, skewness, has_outliers.

    ``n_unique`` is exact for every column.
    ``stats_out`` (optional dict) receives the value counts of the small
    columns and the numeric statistics, so a caller fitting encoders or
    scalers next does not scan again."""
    types = B.field_types(df)
    columns = [c for c in (columns or df.columns) if c != key]
    num = [c for c in columns if B.is_numeric(types[c]) or B.is_boolean(types[c])]
    strs = [c for c in columns if B.is_string(types[c])]
    spark = df.sparkSession
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        v = B.as_double(c) if c in num else F.col(c)
        aggs.append(F.count(v).alias(f"{c}__nn"))
        aggs.append(F.approx_count_distinct(v, 0.05).alias(f"{c}__hll"))
        if c in num:
            aggs += [F.skewness(v).alias(f"{c}__skew"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
        if c in strs:
            aggs.append(F.avg(F.length(v)).alias(f"{c}__len"))
    r = df.agg(*aggs).first().asDict()
    # an HLL estimate (in the same aggregate) tells which columns are small enough for their value counts
    # to go to the driver; the others' distinct values are counted where they lie
    small = [c for c in columns if (r.get(f"{c}__hll") or 0) <= COLLECT_LIMIT]
    large = [c for c in columns if c not in small]
    nunique = {c: 0 for c in columns}
    if large:
        from tabwright.operators.profile import distinct_counts
        nunique |= {x["col_name"]: x["n_unique"] for x in distinct_counts(df, large).collect()}
    value_counts = {c: [] for c in small}
    if small:
        parts = []
        sn, so = [c for c in small if c in num], [c for c in small if c not in num]
        if sn:
            parts.append(stack_columns(df, sn).select("col_name", F.col("value").cast("string").alias("value"),
                                                      F.col("value").alias("num")))
        if so:
            parts.append(stack_columns(df, so, value_type="string").withColumn("num", F.lit(None).cast("double")))
        u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        for row in u.groupBy("col_name", "value").agg(F.first("num").alias("num"), F.count(F.lit(1)).alias("n")).collect():
            value_counts[row["col_name"]].append((row["num"] if row["num"] is not None else row["value"], row["n"]))
        nunique.update({c: len(v) for c, v in value_counts.items()})
    if stats_out is not None:
        stats_out["value_counts"] = value_counts
        stats_out["row"] = r
    # numeric: quartiles then outlier share
    quart = {}
    if num:
        quart = {x["col_name"]: (x["q0"], x["q1"]) for x in exact_quantiles(df, num, [0.25, 0.75]).collect()}
    out_share = {}
    with_iqr = [c for c in num if quart.get(c, (None, None))[0] is not None and quart[c][1] - quart[c][0] > 0]
    if with_iqr:
        aggs2 = []
        for c in with_iqr:
            q1, q3 = quart[c]
            lo, hi = q1 - OUTLIER_IQR_FACTOR * (q3 - q1), q3 + OUTLIER_IQR_FACTOR * (q3 - q1)
            v = B.as_double(c)
            aggs2.append(F.avg(F.when(v.isNull(), None).when((v < lo) | (v > hi), 1.0).otherwise(0.0)).alias(c))
        out_share = df.agg(*aggs2).first().asDict()
    # strings: first values in key order — one job over a union of distributed top-k
    firsts = {c: [] for c in strs}
    if strs:
        parts = []
        for c in strs:
            base = df.where(F.col(c).isNotNull())
            base = base.orderBy(key) if key else base
            parts.append(base.select(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v"),
                                     *([F.col(key).alias("_k")] if key else [F.lit(0).alias("_k")])).limit(20))
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        got = u.collect()
        for row in sorted(got, key=lambda x: (x["_c"], x["_k"])):
            firsts[row["_c"]].append(row["_v"])
    rows = []
    n = r["_n"]
    for c in columns:
        nn = r[f"{c}__nn"]
        nu = int(nunique.get(c, 0))
        null_rate = (n - nn) / n if n else 0.0
        skew, has_out, kind = None, False, None
        if nu <= 1:
            kind = "constant"
        elif c in set(periodic_cols):
            kind = "periodic"
        elif B.is_datetime(types[c]):
            kind = "datetime"
        elif c in num:
            skew = r[f"{c}__skew"]
            mn, mx = r[f"{c}__min"], r[f"{c}__max"]
            if nu == 2 and mn == 0.0 and mx == 1.0:
                kind = "binary"
            else:
                has_out = (out_share.get(c) or 0.0) > OUTLIER_SHARE
                sk = skew if skew is not None else 0.0
                if sk >= SKEWNESS_THRESHOLD and mn > 0:
                    kind = "numeric_log"
                elif abs(sk) >= SKEWNESS_THRESHOLD:
                    kind = "numeric_power"
                elif has_out:
                    kind = "numeric_outlier"
                else:
                    kind = "numeric_normal"
        elif c in strs:
            sample = firsts.get(c, [])
            if _smiles_like(c, sample, spark, smiles_by_name):
                kind = "smiles"
            elif _datetime_like(sample[:10], spark):
                kind = "datetime"
            elif (r[f"{c}__len"] or 0) > TEXT_MEAN_LENGTH:
                kind = "text"
            elif nu == 2:
                kind = "binary"
            elif nu <= CARDINALITY_THRESHOLD:
                kind = "category_low"
            else:
                kind = "category_high"
        else:
            kind = "category_low"
        rows.append((c, kind, nu, float(null_rate), None if skew is None else float(skew), bool(has_out)))
    return spark.createDataFrame(rows, "col_name string, col_type string, n_unique long, null_rate double, "
                                       "skewness double, has_outliers boolean")


def _smiles_like(name, sample, spark=None, by_name=True) -> bool:
    """Molecule heuristic on the ≤ 20 sampled strings (driver-side helper that
    mirrors :func:`looks_like_molecule`)."""
    import re
    if by_name and any(h in name.lower() for h in SMILES_NAME_HINTS):
        return True
    if not sample:
        return False
    alpha = re.compile(MOLECULE_ALPHABET_PATTERN)
    atom = re.compile(MOLECULE_ATOM_PATTERN)
    word = re.compile(r"^[A-Za-z]+$")
    ok = [bool(alpha.search(s)) and bool(atom.search(s)) and not (len(s) < 3 and word.search(s)) for s in sample]
    return sum(ok) / len(ok) > 0.8


def _datetime_like(sample, spark=None) -> bool:
    """All of the first ≤ 10 values parse as dates (pandas parser on the driver sample)."""
    if not sample:
        return False
    import warnings

    import pandas as pd
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            pd.to_datetime(pd.Series(sample))
        return True
    except (ValueError, TypeError, OverflowError):
        return False


def columns_by_type(profile: DataFrame, kind: str) -> list[str]:
    """G12 — names of one kind (the profile is one row per column)."""
    return [r[0] for r in profile.where(F.col("col_type") == kind).select("col_name").collect()]


def type_summary(profile: DataFrame) -> DataFrame:
    """G12 — kind, number of columns, names."""
    return profile.groupBy("col_type").agg(F.count(F.lit(1)).alias("n_columns"),
                                           F.sort_array(F.collect_list("col_name")).alias("columns"))
