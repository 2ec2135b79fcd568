"""Cleaning operators (B1–B14).  Each returns ``(DataFrame, CleaningAction)``.

The returned frame is a lazy plan; the action record keeps the before/after
plans and resolves row counts only when asked (one aggregate per side), so a
chain of cleaning steps stays one Spark query until it is written.  The list of
previous frames *is* the undo stack (B14): lineage, not copies.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.plans.ordering import exact_quantiles


@dataclass
class CleaningAction:
    """B14 — one cleaning step: type, description, shape before/after, details."""
    action_type: str
    description: str
    before: DataFrame | None = None
    after: DataFrame | None = None
    details: dict = field(default_factory=dict)
    timestamp: str = field(default_factory=lambda: _dt.datetime.now().isoformat(timespec="seconds"))
    _counts: tuple | None = None

    def _resolve(self):
        if self._counts is None:
            rb = self.before.count() if self.before is not None else 0
            ra = self.after.count() if self.after is not None else rb
            self._counts = (rb, ra)
        return self._counts

    @property
    def rows_before(self) -> int:
        return self._resolve()[0]

    @property
    def rows_after(self) -> int:
        return self._resolve()[1]

    @property
    def cols_before(self) -> int:
        return len(self.before.columns) if self.before is not None else 0

    @property
    def cols_after(self) -> int:
        return len(self.after.columns) if self.after is not None else self.cols_before

    @property
    def rows_removed(self) -> int:
        return self.rows_before - self.rows_after

    @property
    def cols_removed(self) -> int:
        return self.cols_before - self.cols_after

    def as_row(self) -> dict:
        return {"action_type": self.action_type, "description": self.description,
                "rows_before": self.rows_before, "rows_after": self.rows_after,
                "cols_before": self.cols_before, "cols_after": self.cols_after,
                "details": {k: str(v) for k, v in self.details.items()}, "timestamp": self.timestamp}


class CleaningLog:
    """B14 — ordered actions with an undo stack of previous (lazy) frames."""

    def __init__(self, df: DataFrame):
        self.current = df
        self._stack: list[DataFrame] = []
        self.actions: list[CleaningAction] = []

    def apply(self, op, *args, **kwargs) -> CleaningAction:
        out, action = op(self.current, *args, **kwargs)
        self._stack.append(self.current)
        self.actions.append(action)
        self.current = out
        return action

    def undo(self) -> DataFrame:
        if not self._stack:
            raise IndexError("nothing to undo")
        self.current = self._stack.pop()
        self.actions.pop()
        return self.current

    def to_frame(self, spark) -> DataFrame:
        schema = ("action_type string, description string, rows_before long, rows_after long, "
                  "cols_before long, cols_after long, details map<string,string>, timestamp string")
        return spark.createDataFrame([a.as_row() for a in self.actions], schema)


def _null_flag(df: DataFrame, c: str) -> Column:
    dt = B.field_types(df)[c]
    v = F.isnan(F.col(c)) | F.col(c).isNull() if isinstance(dt, B.FLOAT_TYPES) else F.col(c).isNull()
    return v.cast("int")


def drop_columns(df: DataFrame, columns) -> tuple[DataFrame, CleaningAction]:
    """B1 — drop existing names, ignore unknown; empty list or none existing raises."""
    if not columns:
        raise ValueError("no columns given")
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError(f"none of the columns exist: {list(columns)}")
    out = df.drop(*present)
    return out, CleaningAction("drop_columns", f"dropped {len(present)} columns", df, out,
                               {"columns": present})


def missing_predicate(df: DataFrame, threshold: float = 0.5, subset=None) -> Column | None:
    """Row keeps ⇔ (threshold 0: no null) else (null share < threshold), over ``subset``."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be within [0, 1]: {threshold}")
    cols = [c for c in (subset if subset is not None else df.columns) if c in df.columns]
    if not cols:
        return None
    n_missing = reduce(lambda a, b: a + b, [_null_flag(df, c) for c in cols])
    if threshold == 0.0:
        return n_missing == 0
    return n_missing / F.lit(float(len(cols))) < F.lit(threshold)


def drop_rows_with_missing(df: DataFrame, threshold: float = 0.5, subset=None):
    """B4 — one narrow filter; no check columns → unchanged."""
    keep = missing_predicate(df, threshold, subset)
    if keep is None:
        return df, CleaningAction("drop_missing_rows", "no columns to check", df, df)
    out = df.where(keep)
    return out, CleaningAction("drop_missing_rows", f"drop rows with missing share ≥ {threshold}",
                               df, out, {"threshold": threshold, "subset": subset})


def preview_missing_impact(df: DataFrame, threshold: float = 0.5, subset=None) -> DataFrame:
    """B5 — number of rows B4 would drop (one ``count_if``)."""
    keep = missing_predicate(df, threshold, subset)
    if keep is None:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("rows_removed"))
    return df.agg(F.sum(F.when(~keep, 1).otherwise(0)).cast("long").alias("rows_removed"))


def drop_null_rows(df: DataFrame):
    """B6 — any NULL (or NaN) anywhere removes the row."""
    keep = missing_predicate(df, 0.0)
    out = df if keep is None else df.where(keep)
    return out, CleaningAction("drop_null_rows", "drop rows with any missing", df, out)


def constant_columns(df: DataFrame, columns=None) -> list[str]:
    """Names whose non-null distinct count ≤ 1, from one ``min``/``max`` aggregate
    (cheaper than distinct counts: constant ⇔ min <=> max over non-null values)."""
    cols = list(columns or df.columns)
    types = B.field_types(df)
    aggs = []
    for c in cols:
        v = B.as_double(c) if B.is_numeric(types[c]) else F.col(c)
        if isinstance(types[c], (B.T.ArrayType, B.T.MapType, B.T.StructType)):
            v = F.to_json(F.col(c))
        aggs += [F.min(v).alias(f"{c}__mn"), F.max(v).alias(f"{c}__mx")]
    if not aggs:
        return []
    r = df.agg(*aggs).first()
    return [c for c in cols if r[f"{c}__mn"] is None or r[f"{c}__mn"] == r[f"{c}__mx"]]


def remove_constant_columns(df: DataFrame):
    """B7 — drop columns with ≤ 1 distinct non-null value (fit = one aggregate)."""
    const = constant_columns(df)
    out = df.drop(*const) if const else df
    return out, CleaningAction("remove_constant_columns", f"removed {len(const)} constant columns",
                               df, out, {"constant_columns": const})


def drop_high_missing_columns(df: DataFrame, threshold: float = 0.5, target: str | None = None):
    """B8 — drop columns whose null share is above ``threshold`` (never the target)."""
    cols = [c for c in df.columns if c != target]
    if not cols:
        return df, CleaningAction("drop_high_missing_columns", "nothing to check", df, df)
    r = df.agg(*[F.avg(_null_flag(df, c)).alias(c) for c in cols]).first()
    drop = [c for c in cols if r[c] is not None and r[c] > threshold]
    out = df.drop(*drop) if drop else df
    return out, CleaningAction("drop_high_missing_columns", f"dropped {len(drop)} columns",
                               df, out, {"columns": drop, "threshold": threshold})


def iqr_bounds(df: DataFrame, k: float = 1.5, columns=None, approx: bool = False) -> dict:
    """Fit for B9/B10: {column: (lower, upper)} for numeric columns with IQR ≠ 0.

    One distributed quantile job; the collected result has one row per column."""
    if k <= 0:
        raise ValueError(f"iqr multiplier must be positive: {k}")
    types = B.field_types(df)
    cols = [c for c in (columns if columns is not None else B.numeric_columns(df))
            if c in df.columns and (B.is_numeric(types[c]))]
    if not cols:
        return {}
    q = {r["col_name"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, cols, [0.25, 0.75], approx=approx).collect()}
    out = {}
    for c in cols:
        q1, q3 = q.get(c, (None, None))
        if q1 is None or q3 - q1 == 0:
            continue
        out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def clip_outliers(df: DataFrame, iqr_multiplier: float = 1.5, columns=None, approx: bool = False):
    """B9 — clip each numeric column to [Q1 − k·IQR, Q3 + k·IQR]; skip IQR = 0.

    Fit: exact quartiles of all columns in one distributed job.  Transform: a
    projection with literal bounds (``least(greatest(c, lo), hi)``, NULL kept),
    so it pipelines inside whole-stage codegen.  The per-column clipped counts
    are in ``action.details['clipped_per_column']`` as a lazy frame (B10)."""
    bounds = iqr_bounds(df, iqr_multiplier, columns, approx)
    types = B.field_types(df)
    sel = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            v = B.as_double(c)
            clipped = F.when(v.isNull(), F.col(c).cast("double")).otherwise(
                F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))
            if not isinstance(types[c], B.FLOAT_TYPES):
                clipped = clipped  # integer columns become double when clipped, like pandas
            sel.append(clipped.alias(c))
        else:
            sel.append(F.col(c))
    out = df.select(*sel)
    return out, CleaningAction("clip_outliers", f"IQR×{iqr_multiplier} clipping of {len(bounds)} columns",
                               df, out, {"iqr_multiplier": iqr_multiplier, "bounds": bounds,
                                         "clipped_per_column": _outside_counts(df, bounds)})


def _outside_counts(df: DataFrame, bounds: dict) -> DataFrame | None:
    if not bounds:
        return None
    aggs = [F.sum(F.when((B.as_double(c) < lo) | (B.as_double(c) > hi), 1).otherwise(0)).cast("long").alias(c)
            for c, (lo, hi) in bounds.items()]
    row = df.agg(*aggs)
    st = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).alias("n_clipped")) for c in bounds])
    return row.select(F.inline(st))


def preview_outlier_impact(df: DataFrame, iqr_multiplier: float = 1.5, columns=None,
                           approx: bool = False) -> DataFrame:
    """B10 — values B9 would clip, per column, only columns with > 0."""
    bounds = iqr_bounds(df, iqr_multiplier, columns, approx)
    counts = _outside_counts(df, bounds)
    if counts is None:
        return df.sparkSession.createDataFrame([], "col_name string, n_clipped long")
    return counts.where(F.col("n_clipped") > 0)


def remove_duplicates(df: DataFrame, subset=None, keep: str | bool = "first", key: str | None = None):
    """B11 — keep the first / last (by ``key``) row of each duplicate group, or none.

    Skew-safe: the survivor is picked by ``min``/``max`` of a struct led by the
    key inside a ``groupBy`` — partial aggregation collapses a hot group of
    copies map-side, so no task ever receives a whole group.  ``keep='none'``
    keeps only groups of size one.  Without ``key`` only ``subset=None`` is
    allowed (whole-row duplicates are interchangeable)."""
    subset = [c for c in (subset or df.columns)]
    B.require_columns(df, subset)
    if keep is False:
        keep = "none"
    if keep not in ("first", "last", "none"):
        raise ValueError(f"keep must be first, last or none: {keep}")
    rest = [c for c in df.columns if c not in subset]
    if rest and not key:
        raise ValueError("a key column is needed to choose among duplicates on a column subset")
    if key and key not in subset:
        payload = F.struct(F.col(key).alias("_k"), *[F.col(c) for c in rest if c != key])
        fields = [key] + [c for c in rest if c != key]
    else:
        payload = F.struct(*[F.col(c) for c in rest]) if rest else None
        fields = rest
    if keep == "none":
        aggs = [F.count(F.lit(1)).alias("_n")]
        if payload is not None:
            aggs.append(F.first(payload).alias("_p"))
        g = df.groupBy(*subset).agg(*aggs).where(F.col("_n") == 1)
    else:
        pick = F.min if keep == "first" else F.max
        aggs = [pick(payload).alias("_p")] if payload is not None else [F.lit(1).alias("_one")]
        g = df.groupBy(*subset).agg(*aggs)
    names = {}
    if payload is not None:
        for i, f in enumerate(fields):
            names[f] = F.col("_p").getField("_k" if (key and key not in subset and f == key) else f)
    out = g.select(*[(F.col(c) if c in subset else names[c]).alias(c) for c in df.columns])
    return out, CleaningAction("remove_duplicates", f"keep={keep}", df, out, {"subset": subset, "keep": keep})


def cleaning_summary(df: DataFrame) -> DataFrame:
    """B12 — constant columns, duplicate rows, all-null columns, mean null share (one row)."""
    types = B.field_types(df)
    cols = list(df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        v = B.as_double(c) if B.is_numeric(types[c]) else F.col(c)
        aggs += [F.min(v).alias(f"{c}__mn"), F.max(v).alias(f"{c}__mx"), F.count(v).alias(f"{c}__nn")]
    row = df.agg(*aggs)
    const = reduce(lambda a, b: a + b, [F.when(F.col(f"{c}__mn").isNull() | (F.col(f"{c}__mn") == F.col(f"{c}__mx")), 1)
                                        .otherwise(0) for c in cols])
    allnull = reduce(lambda a, b: a + b, [F.when(F.col(f"{c}__nn") == 0, 1).otherwise(0) for c in cols])
    nullshare = reduce(lambda a, b: a + b, [(F.col("_n") - F.col(f"{c}__nn")) / F.col("_n") for c in cols]) / len(cols)
    const_names = F.filter(F.array(*[F.when(F.col(f"{c}__mn").isNull() | (F.col(f"{c}__mn") == F.col(f"{c}__mx")),
                                            F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    null_names = F.filter(F.array(*[F.when(F.col(f"{c}__nn") == 0, F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    distinct = df.groupBy(*cols).agg(F.lit(1).alias("_o")).agg(F.count(F.lit(1)).alias("_d"))
    return row.crossJoin(distinct).select(
        const.cast("long").alias("n_const_cols"), const_names.alias("const_cols"),
        (F.col("_n") - F.col("_d")).cast("long").alias("n_dup_rows"),
        allnull.cast("long").alias("n_all_missing_cols"), null_names.alias("all_missing_cols"),
        F.when(F.col("_n") > 0, nullshare).otherwise(F.lit(0.0)).alias("total_missing_rate"))


def data_quality_check(df: DataFrame, target: str, min_rows: int = 10, dup_warn: float = 0.05) -> list[str]:
    """B27 — raises below ``min_rows`` rows or with no target; returns warnings
    about target nulls and a duplicate share above 5 % (one aggregate + one distinct)."""
    if target not in df.columns:
        raise KeyError(f"target column '{target}' not found")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_null_flag(df, target)).alias("nulls")).first()
    if r["n"] < min_rows:
        raise ValueError(f"too few rows: {r['n']} < {min_rows}")
    warnings = []
    if r["nulls"]:
        warnings.append(f"target has {r['nulls']} missing values")
    d = df.groupBy(*df.columns).agg(F.lit(1).alias("_o")).count()
    if (r["n"] - d) / r["n"] > dup_warn:
        warnings.append(f"duplicate rows: {(r['n'] - d) / r['n']:.1%}")
    return warnings


def drop_unlabelled(df: DataFrame, target: str) -> DataFrame:
    """B26 — rows with a missing target are removed before training."""
    return df.where(_null_flag(df, target) == 0)
