"""Profiling and aggregation operators (column statistics, correlation, outliers,
histograms, target analysis).

Every operator computes all requested columns in one aggregation and returns a
*long* frame (one row per column, or per column pair), never one job per column.
Exact quantiles and ranks go through the distributed value ladder
(:mod:`tabwright.plans.ordering`), so no single task holds a column's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.functions.stats import sample_kurtosis, sample_skewness, sample_std
from tabwright.plans.ordering import average_ranks, exact_quantiles, stack_columns, value_ladder


def _union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _wide_to_long(row: DataFrame, columns, fields) -> DataFrame:
    """A one-row frame with ``<col>__<field>`` columns → one row per column."""
    structs = F.array(*[F.struct(F.lit(c).alias("col_name"),
                                 *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns])
    return row.select(F.inline(structs))


def column_stats(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """G1 — per column: dtype, n_total, n_null, null_rate, n_unique and, for numeric
    columns, mean, std (ddof 1, 0 when n≤1), min, p25, p50, p75, max, skew (n>2),
    kurt (n>3), bias-corrected like pandas.

    One aggregate job for moments and counts, one value-ladder job for exact
    quantiles and distinct counts; both joined on the (tiny) column name.
    """
    types = B.field_types(df)
    columns = list(columns or df.columns)
    B.require_columns(df, columns)
    num = [c for c in columns if B.is_numeric(types[c]) or B.is_boolean(types[c])]
    aggs = [F.count(F.lit(1)).alias("_n_total")]
    for c in columns:
        v = B.as_double(c) if c in num else F.col(c)
        aggs.append(F.count(v).alias(f"{c}__n_valid"))
        if c in num:
            n = F.count(v)
            aggs += [F.avg(v).alias(f"{c}__mean"), sample_std(v).alias(f"{c}__std"),
                     F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"),
                     sample_skewness(v, n).alias(f"{c}__skew"), sample_kurtosis(v, n).alias(f"{c}__kurt")]
        else:
            for f in ("mean", "std", "min", "max", "skew", "kurt"):
                aggs.append(F.lit(None).cast("double").alias(f"{c}__{f}"))
    row = df.agg(*aggs)
    fields = ["n_valid", "mean", "std", "min", "max", "skew", "kurt"]
    structs = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col("_n_total").alias("n_total"),
                                 *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns])
    base = row.select(F.inline(structs))
    # distinct counts (all columns) through one map-side-combined groupBy
    distinct = distinct_counts(df, columns)
    out = base.join(distinct, "col_name", "left")
    if num:
        q = exact_quantiles(df, num, [0.25, 0.5, 0.75], approx=approx).select(
            "col_name", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
        out = out.join(q, "col_name", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(p) for p in ("p25", "p50", "p75")])
    dtype_map = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c].simpleString()))])
    return out.select(
        "col_name", dtype_map[F.col("col_name")].alias("dtype"), F.col("n_total").cast("long").alias("n_total"),
        (F.col("n_total") - F.col("n_valid")).cast("long").alias("n_null"),
        F.when(F.col("n_total") > 0, (F.col("n_total") - F.col("n_valid")) / F.col("n_total"))
        .otherwise(F.lit(0.0)).alias("null_rate"),
        F.coalesce(F.col("n_unique"), F.lit(0)).cast("long").alias("n_unique"),
        "mean", "std", "min", "p25", "p50", "p75", "max", "skew", "kurt")


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    """(col_name, n_unique) — non-null distinct values per column.  Numeric
    columns are grouped on their double value, others on their string form;
    each ``groupBy(col_name, value)`` combines map-side, so a hot value costs
    one row per task before the shuffle."""
    types = B.field_types(df)
    num = [c for c in columns if B.is_numeric(types[c]) or B.is_boolean(types[c])]
    other = [c for c in columns if c not in num]
    parts = []
    for cols, vt in ((num, "double"), (other, "string")):
        if cols:
            parts.append(stack_columns(df, cols, value_type=vt).groupBy("col_name", "value")
                         .agg(F.lit(1).alias("_one")).groupBy("col_name").agg(F.count(F.lit(1)).alias("n_unique")))
    if not parts:
        return df.sparkSession.createDataFrame([], "col_name string, n_unique long")
    return _union_all(parts)


def top_values(df: DataFrame, columns=None, k: int = 5) -> DataFrame:
    """T3 / G1 — the ``k`` most frequent values of each (non-numeric) column.

    Output: column, value (string), count, rank; ties broken by value so the
    result is deterministic.  Counting is a map-side-combined ``groupBy``.
    """
    types = B.field_types(df)
    columns = list(columns or [c for c in df.columns
                               if not (B.is_numeric(types[c]) or B.is_boolean(types[c]))])
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, rank int")
    long = stack_columns(df, columns, value_type="string")
    counts = long.groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("col_name").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def table_summary(df: DataFrame) -> DataFrame:
    """G2 — rows, columns, per-kind column counts, total null share (4 dp), duplicate rows."""
    types = B.field_types(df)
    kinds = [B.dtype_kind(t) for t in types.values()]
    n_cols = len(df.columns)
    nulls = [F.sum(F.when(B.as_double(c).isNull() if B.is_numeric(t) else F.col(c).isNull(), 1)
                   .otherwise(0)) for c, t in types.items()]
    total_null = reduce(lambda a, b: a + b, nulls) if nulls else F.lit(0)
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), total_null.alias("_nulls"))
    # distinct rows: copies collapse in the map-side partial aggregate
    distinct = df.groupBy(*df.columns).agg(F.lit(1).alias("_o")).agg(F.count(F.lit(1)).alias("_n_distinct"))
    return stats.crossJoin(distinct).select(
        F.col("n_rows").cast("long"), F.lit(n_cols).cast("long").alias("n_cols"),
        F.lit(sum(k in ("numeric", "bool") for k in kinds)).cast("long").alias("n_numeric"),
        F.lit(sum(k == "string" for k in kinds)).cast("long").alias("n_categorical"),
        F.lit(sum(k == "datetime" for k in kinds)).cast("long").alias("n_datetime"),
        F.round(F.when(F.col("n_rows") * n_cols > 0, F.col("_nulls") / (F.col("n_rows") * n_cols))
                .otherwise(F.lit(0.0)), 4).alias("total_null_rate"),
        (F.col("n_rows") - F.col("_n_distinct")).cast("long").alias("n_duplicates"))


def describe(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """G3 — count, mean, std, min, 25/50/75 %, max per numeric column (exact quantiles)."""
    columns = list(columns or B.numeric_columns(df))
    s = column_stats(df, columns, approx=approx)
    return s.select("col_name", (F.col("n_total") - F.col("n_null")).alias("count"),
                    "mean", "std", "min", "p25", "p50", "p75", "max")


def coerced_summary(df: DataFrame, columns=None) -> DataFrame:
    """G4 — after numeric coercion (bad → NULL): distinct, missing, missing %, min/max/mean."""
    columns = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        v = F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
        aggs += [F.count(v).alias(f"{c}__valid"), F.min(v).alias(f"{c}__min"),
                 F.max(v).alias(f"{c}__max"), F.avg(v).alias(f"{c}__mean")]
    row = df.agg(*aggs)
    long = _wide_to_long(row.withColumn("_keep", F.col("_n")), columns, ["valid", "min", "max", "mean"])
    nrow = row.select("_n")
    vals = df.select([F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    distinct = (stack_columns(vals, columns).groupBy("col_name", "value").agg(F.lit(1).alias("_o"))
                .groupBy("col_name").agg(F.count(F.lit(1)).alias("n_distinct")))
    out = long.crossJoin(nrow).join(distinct, "col_name", "left")
    return out.select("col_name", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
                      (F.col("_n") - F.col("valid")).cast("long").alias("n_missing"),
                      F.when(F.col("_n") > 0, 100.0 * (F.col("_n") - F.col("valid")) / F.col("_n"))
                      .otherwise(F.lit(0.0)).alias("missing_pct"),
                      "min", "max", "mean")


def correlation_matrix(df: DataFrame, method: str = "pearson", columns=None,
                       target: str | None = None) -> DataFrame:
    """G5 — pairwise-complete correlation of numeric columns as a long frame
    (col_a, col_b, corr); with ``target`` only (column, corr) against it.

    pearson: ``corr`` of every pair in one aggregate.  spearman: ``corr`` of
    average ranks (value ladder).  kendall: exact tau-b from distinct cells (see :func:`kendall_tau`).
    """
    columns = list(columns or B.numeric_columns(df))
    if len(columns) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    method = method.lower()
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown correlation method: {method}")
    if target is not None and target not in columns:
        raise KeyError(target)
    pairs = ([(c, target) for c in columns if c != target] if target
             else [(a, b) for a in columns for b in columns])
    if method == "kendall":
        return kendall_tau(df, pairs, target)
    data = df.select([B.as_double(c).alias(c) for c in columns])
    if method == "spearman":
        ranked = average_ranks(data, columns)
        data = ranked.select([F.col(c + "_rank").alias(c) for c in columns])
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs.append(F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"_c{i}"))
    row = data.agg(*aggs)
    structs = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                 F.when(F.lit(a) == F.lit(b), F.lit(1.0)).otherwise(F.col(f"_c{i}")).alias("corr"))
                        for i, (a, b) in enumerate(pairs)])
    out = row.select(F.inline(structs))
    if target:
        return out.select(F.col("col_a").alias("col_name"), "corr")
    return out


def kendall_tau(df: DataFrame, pairs, target=None) -> DataFrame:
    """Kendall tau-b per (a, b) pair — exact, computed on distinct (x, y) cells
    with a grid decomposition of the discordant-pair count (see
    :mod:`tabwright.plans.kendall`); no row pairs are ever formed."""
    from tabwright.plans.kendall import kendall_tau_b
    spark = df.sparkSession
    rows = [(a, b, 1.0 if a == b else kendall_tau_b(df, a, b)) for a, b in pairs]
    out = spark.createDataFrame(rows, "col_a string, col_b string, corr double")
    if target:
        return out.select(F.col("col_a").alias("col_name"), "corr")
    return out


def correlate_with_target(df: DataFrame, target: str, columns=None, top_n: int | None = None,
                          method: str = "pearson") -> DataFrame:
    """G6 — |r| of every numeric column with the target, NULL dropped, sorted desc, top N."""
    columns = [c for c in (columns or B.numeric_columns(df)) if c != target]
    corr = correlation_matrix(df, method, columns + [target], target=target)
    out = (corr.where(F.col("corr").isNotNull() & ~F.isnan("corr"))
           .select("col_name", F.abs("corr").alias("abs_corr")))
    if top_n:
        w = Window.orderBy(F.desc("abs_corr"), F.asc("col_name"))
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return out


def detect_outliers(df: DataFrame, method: str = "iqr", k: float = 1.5, z_threshold: float = 3.0,
                    columns=None) -> DataFrame:
    """G7 — per column: n_outliers, outlier_rate (over non-null), lower, upper.

    iqr: Q1−k·IQR, Q3+k·IQR.  zscore: mean ± t·std (sample), skipped when std=0.
    modified_zscore: median ± t·MAD/0.6745, skipped when MAD=0 (second pass).
    """
    method = method.lower()
    if method not in ("iqr", "zscore", "modified_zscore"):
        raise ValueError(f"unknown outlier method: {method}")
    columns = [c for c in (columns or B.numeric_columns(df)) if c in df.columns]
    b = outlier_bounds(df, method, k, z_threshold, columns)
    return count_outside(df, b, columns)


def outlier_bounds(df: DataFrame, method: str, k: float, z_threshold: float, columns) -> DataFrame:
    if method == "iqr":
        q = exact_quantiles(df, columns, [0.25, 0.75])
        return q.select("col_name", (F.col("q0") - k * (F.col("q1") - F.col("q0"))).alias("lower"),
                        (F.col("q1") + k * (F.col("q1") - F.col("q0"))).alias("upper"))
    if method == "zscore":
        row = df.agg(*[x for c in columns for x in (F.avg(B.as_double(c)).alias(f"{c}__mu"),
                                                     F.stddev_samp(B.as_double(c)).alias(f"{c}__sd"))])
        m = _wide_to_long(row, columns, ["mu", "sd"])
        return m.where(F.col("sd") != 0).select(
            "col_name", (F.col("mu") - z_threshold * F.col("sd")).alias("lower"),
            (F.col("mu") + z_threshold * F.col("sd")).alias("upper"))
    med = exact_quantiles(df, columns, [0.5]).select("col_name", F.col("q0").alias("med"))
    medmap = med.agg(F.map_from_entries(F.collect_list(F.struct("col_name", "med"))).alias("m"))
    # |x - median| per column, then its median: MAD
    dev = df.crossJoin(medmap).select([F.abs(B.as_double(c) - F.col("m")[F.lit(c)]).alias(c) for c in columns])
    mad = exact_quantiles(dev, columns, [0.5]).select("col_name", F.col("q0").alias("mad"))
    return med.join(mad, "col_name").where(F.col("mad") != 0).select(
        "col_name", (F.col("med") - z_threshold * F.col("mad") / 0.6745).alias("lower"),
        (F.col("med") + z_threshold * F.col("mad") / 0.6745).alias("upper"))


def count_outside(df: DataFrame, bounds: DataFrame, columns) -> DataFrame:
    """Count values strictly outside per-column (lower, upper) — bounds broadcast
    (one row per column), data stacked narrowly and aggregated once."""
    long = stack_columns(df, columns)
    j = long.join(F.broadcast(bounds), "col_name")
    agg = j.groupBy("col_name").agg(
        F.sum(F.when((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), 1).otherwise(0))
        .cast("long").alias("n_outliers"),
        F.count(F.lit(1)).alias("_valid"), F.first("lower").alias("lower"), F.first("upper").alias("upper"))
    return agg.select("col_name", "n_outliers",
                      F.when(F.col("_valid") > 0, F.col("n_outliers") / F.col("_valid")).otherwise(0.0)
                      .alias("outlier_rate"), "lower", "upper")


def outlier_rows(df: DataFrame, key: str, method: str = "iqr", k: float = 1.5, z_threshold: float = 3.0,
                 columns=None, limit: int | None = None) -> DataFrame:
    """G7 row ids — every outlying key per column with its value; with ``limit``, the first
    ``limit`` keys of each column (rank in key order) as a preview."""
    B.require_key(df, key)
    columns = [c for c in (columns or B.numeric_columns(df, exclude=[key])) if c in df.columns]
    b = outlier_bounds(df, method.lower(), k, z_threshold, columns)
    long = stack_columns(df, columns, keep=[key]).join(F.broadcast(b), "col_name")
    out = long.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    if limit is None:
        return out.select("col_name", key, "value")
    w = Window.partitionBy("col_name").orderBy(key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("col_name", key, "value", "rank")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """G8 — equal-width bins over [min, max], the last bin closed; lo = hi → range ±0.5.

    Output: bin, lo, hi, center, count (empty bins included via a generated bin
    table of ``bins`` rows — bounded by the argument, broadcast).
    """
    types = B.field_types(df)
    if not (B.is_numeric(types[column]) or B.is_boolean(types[column])):
        return top_values(df, [column], 30).select(F.col("value").alias("category"), "count", "rank")
    v = B.as_double(column)
    mm = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx")).select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    idx = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                  F.lit(bins - 1)).cast("int")
    counts = (df.select(v.alias("_v")).where(F.col("_v").isNotNull()).crossJoin(F.broadcast(mm))
              .select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(mm))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * width).alias("lo_edge"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("hi_edge"),
                    (F.col("lo") + (F.col("bin") + 0.5) * width).alias("center"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def infer_task(df: DataFrame, target: str, rule: str = "eda") -> str:
    """G10 — 'regression' or 'classification' by one of the three reference rules.

    eda: float → regression, else nunique ≤ 20 → classification.
    automl: float → regression; integer → nunique ≤ max(10, 5 % n); other → classification.
    pipeline: string or nunique ≤ 10 → classification.
    Reads only the distinct count (one aggregate) — the result is a scalar.
    """
    dt = B.field_types(df)[target]
    is_float = isinstance(dt, B.FLOAT_TYPES) or dt.simpleString().startswith("decimal")
    if rule == "eda":
        if is_float:
            return "regression"
        nu = df.agg(F.countDistinct(target)).first()[0]
        return "classification" if nu <= 20 else "regression"
    if rule == "automl":
        if is_float:
            return "regression"
        if B.is_numeric(dt):
            r = df.agg(F.countDistinct(target), F.count(F.lit(1))).first()
            return "classification" if r[0] <= max(10, 0.05 * r[1]) else "regression"
        return "classification"
    if rule == "pipeline":
        if not B.is_numeric(dt):
            return "classification"
        nu = df.agg(F.countDistinct(target)).first()[0]
        return "classification" if nu <= 10 else "regression"
    raise ValueError(f"unknown rule {rule}")


def analyze_target(df: DataFrame, target: str, task: str = "auto") -> DataFrame:
    """G9 — one-row regression profile, or per-class counts/balance with is_balanced."""
    if target not in df.columns:
        raise KeyError(f"target column '{target}' not found")
    if task == "auto":
        task = infer_task(df, target, "eda")
    if task == "regression":
        return column_stats(df, [target]).withColumn("task", F.lit("regression"))
    return class_balance(df, target)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """G20 / G9 — class, count, share (4 dp), is_balanced = min/max ≥ 0.5 (one class → true)."""
    vc = (df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class"))
          .agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy()
    # vc has one row per class: the un-partitioned window runs over the class table only
    return vc.select("class", "count",
                     F.round(F.col("count") / F.sum("count").over(w), 4).alias("share"),
                     F.when(F.count(F.lit(1)).over(w) < 2, F.lit(True))
                     .otherwise(F.min("count").over(w) / F.max("count").over(w) >= 0.5).alias("is_balanced"))


def variance_ranking(df: DataFrame, columns=None, top_n: int | None = None) -> DataFrame:
    """G14 — sample variance per column, sorted desc (ties by name), optional top N."""
    columns = list(columns or B.numeric_columns(df))
    row = df.agg(*[F.var_samp(B.as_double(c)).alias(f"{c}__var") for c in columns])
    out = _wide_to_long(row, columns, ["var"]).select("col_name", F.col("var").alias("variance"))
    w = Window.orderBy(F.desc_nulls_last("variance"), F.asc("col_name"))
    out = out.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top_n) if top_n else out


def missing_report(df: DataFrame, columns=None) -> DataFrame:
    """G15 — nulls and null rate per column, only columns with nulls."""
    types = B.field_types(df)
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.when((B.as_double(c) if B.is_numeric(types[c]) else F.col(c)).isNull(), 1)
                         .otherwise(0)).alias(f"{c}__nulls") for c in columns])
    long = _wide_to_long(row, columns, ["nulls"]).crossJoin(row.select("_n"))
    return long.where(F.col("nulls") > 0).select(
        "col_name", F.col("nulls").cast("long").alias("n_null"), (F.col("nulls") / F.col("_n")).alias("null_rate"))


def range_stats(df: DataFrame, column: str, default=(0.0, 1.0)) -> DataFrame:
    """G17 — min/max/quartiles/mean/std of one column; defaults when empty."""
    q = exact_quantiles(df, [column], [0.25, 0.5, 0.75])
    v = B.as_double(column)
    m = df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
               sample_std(v).alias("std"))
    lo, hi = default
    return m.crossJoin(q.select("q0", "q1", "q2")).select(
        F.coalesce("min", F.lit(float(lo))).alias("min"), F.coalesce("max", F.lit(float(hi))).alias("max"),
        F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
        F.coalesce("mean", F.lit((lo + hi) / 2.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))


def ols_trend(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """G18 — OLS slope, intercept and R² of y on x (``regr_*`` aggregates)."""
    xv, yv = B.as_double(x), B.as_double(y)
    aggs = [F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept"),
            F.regr_r2(yv, xv).alias("r2"), F.regr_count(yv, xv).alias("n")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def box_stats(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """G19 — per group: n, min, q1, median, q3, max and whisker ends (1.5·IQR, clipped
    to the data range).  Quantiles via the value ladder with the group as name."""
    gname = F.col(group).cast("string") if group else F.lit("all")
    long = df.select(gname.alias("grp"), B.as_double(value).alias("value")).where(F.col("value").isNotNull())
    lad = value_ladder(long, "grp", "value")
    probs = [0.25, 0.5, 0.75]
    sel = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.ceil(h)
        sel += [F.max(F.when((F.col("cum_before") <= lo) & (lo < F.col("cum_after")), F.col("value"))).alias(f"_lo{i}"),
                F.max(F.when((F.col("cum_before") <= hi) & (hi < F.col("cum_after")), F.col("value"))).alias(f"_hi{i}"),
                F.max(h - lo).alias(f"_fr{i}")]
    g = lad.groupBy("grp").agg(F.max("n").cast("long").alias("n"), F.min("value").alias("min"),
                               F.max("value").alias("max"), *sel)
    qs = [(F.col(f"_lo{i}") + F.col(f"_fr{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))) for i in range(3)]
    g = g.select("grp", "n", "min", qs[0].alias("q1"), qs[1].alias("median"), qs[2].alias("q3"), "max")
    iqr = F.col("q3") - F.col("q1")
    return g.select(F.col("grp").alias(group or "group"), "n", "min", "q1", "median", "q3", "max",
                    F.greatest(F.col("min"), F.col("q1") - 1.5 * iqr).alias("whisker_lo"),
                    F.least(F.col("max"), F.col("q3") + 1.5 * iqr).alias("whisker_hi"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """G20 — value, count (NULL excluded), sorted by count desc then value."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")))


def fill_card(df: DataFrame) -> DataFrame:
    """G21 — dtype, nulls, null %, distinct per column (subset of column_stats)."""
    s = column_stats(df)
    return s.select("col_name", "dtype", "n_null", (100.0 * F.col("null_rate")).alias("null_pct"), "n_unique")
