"""Imputers, scalers, power/quantile transforms and encoders.

Every estimator's ``fit`` is one aggregate job over all its columns whose
result is small (one value per column, or one row per category) and is
collected; ``transform`` is a single ``select`` of column expressions with
those values as literals — pure Catalyst, codegen'd, and usable on a stream.
High-cardinality category maps stay a DataFrame and are joined (AQE decides
broadcast from the runtime size) instead of being inlined as CASE chains.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.functions.scalar import log_transform, periodic
from tabwright.functions.stats import norm_ppf
from tabwright.plans.ordering import exact_quantiles, global_row_number, stack_columns
from tabwright.session import cut_lineage

INLINE_CATEGORY_LIMIT = 256   # above this many categories a map is joined, not inlined


def _v(c: str) -> Column:
    return B.as_double(c)


def _wide(df: DataFrame, aggs: dict) -> dict:
    """Run one aggregate with named expressions; return {name: value}."""
    if not aggs:
        return {}
    return df.agg(*[e.alias(k) for k, e in aggs.items()]).first().asDict()


class Model:
    """Fitted transform: ``exprs(df)`` gives {output name: Column}."""
    inputs: list = []

    def exprs(self, df: DataFrame) -> dict:  # pragma: no cover - interface
        raise NotImplementedError

    def transform(self, df: DataFrame, keep_other: bool = True) -> DataFrame:
        ex = self.exprs(df)
        rest = [c for c in df.columns if c not in self.inputs and c not in ex] if keep_other else []
        return df.select(*rest, *[e.alias(n) for n, e in ex.items()])


# --- E1/E2/E5: imputers ------------------------------------------------------

@dataclass
class ImputerModel(Model):
    fills: dict
    inputs: list = field(default_factory=list)
    indicator: bool = False

    def exprs(self, df):
        out = {}
        for c in self.inputs:
            base = _v(c) if B.is_numeric(B.field_types(df)[c]) else F.col(c)
            out[c] = F.coalesce(base, F.lit(self.fills.get(c)))
        if self.indicator:
            for c in self.inputs:
                out[f"missingindicator_{c}"] = (_v(c) if B.is_numeric(B.field_types(df)[c]) else F.col(c)) \
                    .isNull().cast("double")
        return out


@dataclass
class Imputer:
    """E1/E2/E3 — mean | median | most_frequent | constant | knn (five neighbours; unknown strategy → mean).

    median is exact (value ladder); most_frequent ties go to the smallest value."""
    strategy: str = "mean"
    fill_value: object = None
    add_indicator: bool = False

    def fit(self, df: DataFrame, columns) -> Model:
        columns = list(columns)
        if self.strategy == "knn":
            from tabwright.plans.knn_impute import KnnImputer
            return KnnImputer(add_indicator=self.add_indicator).fit(df, columns)
        s = self.strategy if self.strategy in ("mean", "median", "most_frequent", "constant") else "mean"
        types = B.field_types(df)
        if s == "constant":
            fills = {c: (self.fill_value if self.fill_value is not None else
                         (0.0 if B.is_numeric(types[c]) else "missing_value")) for c in columns}
        elif s == "mean":
            r = _wide(df, {c: F.avg(_v(c)) for c in columns})
            fills = dict(r)
        elif s == "median":
            fills = {x["col_name"]: x["q0"] for x in exact_quantiles(df, columns, [0.5]).collect()}
        else:
            fills = most_frequent(df, columns)
        return ImputerModel(fills, columns, self.add_indicator)


def most_frequent(df: DataFrame, columns) -> dict:
    """Mode per column (smallest value among ties), one grouped job; result ≤ one row per column."""
    types = B.field_types(df)
    out = {}
    num = [c for c in columns if B.is_numeric(types[c])]
    oth = [c for c in columns if c not in num]
    for cols, vt in ((num, "double"), (oth, "string")):
        if not cols:
            continue
        long = stack_columns(df, cols, value_type=vt)
        counts = long.groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("col_name").agg(F.min(F.struct((-F.col("n")).alias("negn"), F.col("value"))).alias("b"))
        for r in best.collect():
            out[r["col_name"]] = r["b"]["value"]
    return out


# --- E6–E12: scalers and power transforms ------------------------------------

@dataclass
class ScalerModel(Model):
    kind: str
    params: dict
    inputs: list = field(default_factory=list)

    def exprs(self, df):
        out = {}
        for c in self.inputs:
            p = self.params[c]
            x = _v(c)
            if self.kind == "standard":
                out[c] = (x - F.lit(p[0])) / F.lit(p[1])
            elif self.kind == "minmax":
                out[c] = (x - F.lit(p[0])) / F.lit(p[1])
            elif self.kind == "maxabs":
                out[c] = x / F.lit(p[0])
            elif self.kind == "robust":
                out[c] = (x - F.lit(p[0])) / F.lit(p[1])
            elif self.kind == "log_standard":
                out[c] = (log_transform(x, p[2]) - F.lit(p[0])) / F.lit(p[1])
            elif self.kind == "none":
                out[c] = x
            else:
                raise ValueError(self.kind)
        return out


@dataclass
class Scaler:
    """E6 standard (ddof 0, std 0 → 1) · E7 minmax (range 0 → 1) / maxabs ·
    E8 robust (median, IQR; 0 → 1) · E11 log+standard · E12 none / auto (= standard)."""
    kind: str = "standard"
    log_offset: float = 1.0

    def fit(self, df: DataFrame, columns) -> ScalerModel:
        columns = list(columns)
        kind = "standard" if self.kind == "auto" else self.kind
        params = {}
        if kind == "standard":
            r = _wide(df, {**{f"{c}__m": F.avg(_v(c)) for c in columns},
                           **{f"{c}__s": F.stddev_pop(_v(c)) for c in columns}})
            params = {c: (r[f"{c}__m"] or 0.0, r[f"{c}__s"] or 1.0) for c in columns}
            params = {c: (m, s if s else 1.0) for c, (m, s) in params.items()}
        elif kind == "minmax":
            r = _wide(df, {**{f"{c}__lo": F.min(_v(c)) for c in columns}, **{f"{c}__hi": F.max(_v(c)) for c in columns}})
            params = {c: (r[f"{c}__lo"] or 0.0, (r[f"{c}__hi"] - r[f"{c}__lo"]) if r[f"{c}__hi"] is not None and
                          r[f"{c}__hi"] != r[f"{c}__lo"] else 1.0) for c in columns}
        elif kind == "maxabs":
            r = _wide(df, {c: F.max(F.abs(_v(c))) for c in columns})
            params = {c: (r[c] if r[c] else 1.0,) for c in columns}
        elif kind == "robust":
            q = {x["col_name"]: (x["q0"], x["q1"], x["q2"]) for x in
                 exact_quantiles(df, columns, [0.25, 0.5, 0.75]).collect()}
            params = {c: (q[c][1], (q[c][2] - q[c][0]) or 1.0) for c in columns}
        elif kind == "log_standard":
            lx = {c: log_transform(_v(c), self.log_offset) for c in columns}
            r = _wide(df, {**{f"{c}__m": F.avg(e) for c, e in lx.items()},
                           **{f"{c}__s": F.stddev_pop(e) for c, e in lx.items()}})
            params = {c: (r[f"{c}__m"] or 0.0, r[f"{c}__s"] or 1.0, self.log_offset) for c in columns}
        elif kind == "none":
            params = {c: () for c in columns}
        else:
            raise ValueError(f"unknown scaler: {self.kind}")
        return ScalerModel(kind, params, columns)


def _yj(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform for a fixed λ."""
    pos = (F.pow(x + 1.0, lam) - 1.0) / lam if abs(lam) > 1e-12 else F.log1p(x)
    neg = -(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam) if abs(lam - 2.0) > 1e-12 else -F.log1p(-x)
    return F.when(x >= 0, pos).otherwise(neg)


def _power(method: str, x: Column, lam: float, side: int, centre: float) -> Column:
    """The transform for a fixed λ, up to a linear map that standardising takes out again.

    On a column of one sign the transform is (exp(e·u) − 1)/e of a logarithm u, which drowns in rounding where u is large
    against its spread (years, ids, prices with an offset); taken about the mean of u it keeps its digits at any λ."""
    if side == 0:
        return _yj(x, lam)
    u = F.log(x) if method == "box-cox" else F.log1p(F.abs(x))
    e = lam if side > 0 else 2.0 - lam
    flat = abs(e) <= 1e-12
    inside = side * (u - F.lit(centre) if flat else F.expm1(e * (u - F.lit(centre))) / e)
    if method == "box-cox":
        return inside
    k = F.lit(-e * centre)
    beyond = _yj(x, lam) * F.exp(k) + side * (F.lit(-centre) if flat else F.expm1(k) / e)
    return F.when(x * side >= 0, inside).otherwise(beyond)


@dataclass
class PowerModel(Model):
    method: str
    lambdas: dict
    centres: dict
    moments: dict
    inputs: list = field(default_factory=list)

    def exprs(self, df):
        return {c: (_power(self.method, _v(c), self.lambdas[c], *self.centres[c]) - F.lit(self.moments[c][0])) / F.lit(self.moments[c][1])
                for c in self.inputs}


@dataclass
class PowerTransformer:
    """E9 — Yeo-Johnson / Box-Cox, λ by maximum likelihood, then standardised.

    λ search: every pass evaluates a grid of λ for all open columns in ONE aggregate (one centred variance per λ).  While
    the best λ lies at an end of its bracket the bracket moves on and widens, so λ has no bounds; then it is refined
    for ``passes`` rounds.  A column without two different values keeps λ = 1.  Box-Cox needs strictly positive data
    (raises)."""
    method: str = "yeo-johnson"
    grid: int = 21
    passes: int = 4
    lo: float = -4.0
    hi: float = 4.0

    def fit(self, df: DataFrame, columns) -> PowerModel:
        columns = list(columns)
        if self.method not in ("yeo-johnson", "box-cox"):
            raise ValueError(self.method)
        log = (lambda x: F.log(x)) if self.method == "box-cox" else (lambda x: F.signum(x) * F.log1p(F.abs(x)))
        seen = _wide(df, {f"{k}{i}": f(_v(c)) for i, c in enumerate(columns) for k, f in (
            ("lo", F.min), ("hi", F.max), ("n", F.count), ("u", lambda x: F.avg(log(x))))})
        stats = {c: tuple(seen[f"{k}{i}"] for k in ("lo", "hi", "n", "u")) for i, c in enumerate(columns)}
        if self.method == "box-cox":
            bad = [c for c in columns if stats[c][0] is not None and stats[c][0] <= 0]
            if bad:
                raise ValueError(f"box-cox needs strictly positive data: {bad}")
        best, centres, todo = {c: 1.0 for c in columns}, {c: (0, 0.0) for c in columns}, {}
        for c, (lo, hi, n, u) in stats.items():
            if n:
                side = 1 if self.method == "box-cox" or lo >= 0 else -1 if hi <= 0 else 0
                centres[c] = (side, side * u)
                if lo < hi:
                    todo[c] = (self.lo, self.hi, self.passes)
        while todo:
            grids = {c: [lo + (hi - lo) * i / (self.grid - 1) for i in range(self.grid)] for c, (lo, hi, _) in todo.items()}
            r = _wide(df, {f"v{ci}_{gi}": F.var_pop(_power(self.method, _v(c), lam, *centres[c]))
                           for ci, c in enumerate(grids) for gi, lam in enumerate(grids[c])})
            for ci, c in enumerate(grids):
                (lo, hi, left), grid, (side, _), (_, _, n, u) = todo.pop(c), grids[c], centres[c], stats[c]
                scores = []                  # per row; on one sign the Jacobian cancels against the centre
                for gi, lam in enumerate(grid):
                    v = r[f"v{ci}_{gi}"]
                    fine = v is not None and math.isfinite(v) and v > 0
                    scores.append((-0.5 * math.log(v) + ((lam - 1.0) * u if side == 0 else 0.0)) if fine else -math.inf)
                gi = max(range(len(scores)), key=lambda i: scores[i])
                if scores[gi] == -math.inf:
                    continue
                best[c], step, edge = grid[gi], grid[1] - grid[0], gi in (0, self.grid - 1)
                if edge and left == self.passes:
                    back, on = (hi - lo) / 2, 2 * (hi - lo)          # half a bracket back, so that it can't end at the other end
                    todo[c] = (best[c] - on, best[c] + back, left) if gi == 0 else (best[c] - back, best[c] + on, left)
                elif left > 1:
                    todo[c] = (best[c] - step, best[c] + step, left - 1)
        done = {c: _power(self.method, _v(c), best[c], *centres[c]) for c in columns}
        mom = _wide(df, {**{f"{c}__m": F.avg(e) for c, e in done.items()}, **{f"{c}__s": F.stddev_pop(e) for c, e in done.items()}})
        moments = {c: (mom[f"{c}__m"] or 0.0, mom[f"{c}__s"] or 1.0) for c in columns}
        return PowerModel(self.method, best, centres, moments, columns)


@dataclass
class QuantileModel(Model):
    knots: dict
    output: str
    inputs: list = field(default_factory=list)

    def exprs(self, df):
        import numpy as np
        import pandas as pd
        out = {}
        for c in self.inputs:
            q = np.asarray(self.knots[c], dtype="float64")
            refs = np.linspace(0.0, 1.0, len(q))
            normal = self.output == "normal"

            @F.pandas_udf("double")
            def interp(s: pd.Series, q=q, refs=refs, normal=normal) -> pd.Series:
                x = s.to_numpy(dtype="float64")
                u = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
                u = np.clip(u, 0.0, 1.0)
                if normal:
                    u = np.clip(u, 1e-7, 1 - 1e-7)
                    u = np.array([norm_ppf(v) if not np.isnan(v) else np.nan for v in u])
                res = pd.Series(u)
                res[s.isna().to_numpy()] = np.nan
                return res
            out[c] = interp(_v(c))
        return out


@dataclass
class QuantileTransformer:
    """E10 — map through ``n_quantiles`` exact quantiles to uniform or normal.

    Fit: one distributed quantile job; transform: Arrow-batched piecewise-linear
    interpolation (numpy ``interp``) — the only Python step, vectorised."""
    n_quantiles: int = 1000
    output_distribution: str = "uniform"

    def fit(self, df: DataFrame, columns) -> QuantileModel:
        columns = list(columns)
        n = df.count()
        k = max(2, min(self.n_quantiles, n))
        probs = [i / (k - 1) for i in range(k)]
        q = exact_quantiles(df, columns, probs).collect()
        knots = {r["col_name"]: [r[f"q{i}"] for i in range(k)] for r in q}
        return QuantileModel(knots, self.output_distribution, columns)


@dataclass
class PeriodicModel(Model):
    periods: dict
    means: dict
    inputs: list = field(default_factory=list)

    def exprs(self, df):
        out = {}
        for c in self.inputs:
            s, co = periodic(F.coalesce(_v(c), F.lit(self.means[c])), self.periods.get(c, 2 * math.pi))
            out[f"{c}_sin"], out[f"{c}_cos"] = s, co
        return out


def fit_periodic(df: DataFrame, columns, periods: dict | None = None) -> PeriodicModel:
    """E21 — mean impute + sin/cos of the period (default 2π)."""
    columns = list(columns)
    means = _wide(df, {c: F.avg(_v(c)) for c in columns})
    return PeriodicModel(dict(periods or {}), {c: means[c] or 0.0 for c in columns}, columns)


# --- E13–E19: encoders ------------------------------------------------------

def category_levels(df: DataFrame, columns, with_counts: bool = False) -> dict:
    """Sorted distinct non-null values per column (one grouped job)."""
    long = stack_columns(df, columns, value_type="string")
    g = long.groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("n"))
    out = {c: [] for c in columns}
    for r in g.collect():
        out[r["col_name"]].append((r["value"], r["n"]))
    return {c: sorted(v) if with_counts else sorted(x for x, _ in v) for c, v in out.items()}


@dataclass
class OneHotModel(Model):
    levels: dict
    drop_first: bool
    infrequent: dict
    inputs: list = field(default_factory=list)

    def exprs(self, df):
        out = {}
        for c in self.inputs:
            lv = self.levels[c]
            x = F.col(c).cast("string")
            keep = lv[1:] if self.drop_first and len(lv) > 1 else lv
            for v in keep:
                out[f"{c}_{v}"] = F.coalesce((x == F.lit(v)).cast("double"), F.lit(0.0))
            if self.infrequent.get(c):
                out[f"{c}_infrequent_sklearn"] = F.coalesce(x.isin(self.infrequent[c]).cast("double"), F.lit(0.0))
        return out


@dataclass
class WideOneHotModel(Model):
    """One-hot columns as they are, plus a sparse vector ``<column>_onehot`` for each column of many levels: the level's
    position comes from a dictionary by a join, so levels are neither collected nor inlined.  Unknown levels and nulls
    are zero vectors, as is the first level if it is dropped."""
    dense: OneHotModel
    tables: dict           # column -> DataFrame(value string, code double); code < size
    sizes: dict            # column -> length of its vector
    inputs: list = field(default_factory=list)

    def codes(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the position of the row's level in the vector; its length stands for none."""
        t = self.tables[column].select(F.col("value").alias("_tw_k"), F.col("code").alias("_tw_c"))
        got = df.join(t, F.col(column).cast("string") == F.col("_tw_k"), "left")
        return got.withColumn(name, F.coalesce("_tw_c", F.lit(float(self.sizes[column])))).drop("_tw_k", "_tw_c")

    def transform(self, df: DataFrame, keep_other: bool = True) -> DataFrame:
        from pyspark.ml.feature import OneHotEncoder as Indicator
        out, wide = df, list(self.tables)
        for c in wide:
            out = self.codes(out, c, f"_tw_at_{c}")
        spark = df.sparkSession
        for c in wide:
            top = spark.createDataFrame([(float(self.sizes[c] - 1),)], f"`_tw_at_{c}` double")
            out = Indicator(inputCol=f"_tw_at_{c}", outputCol=f"{c}_onehot", handleInvalid="keep", dropLast=True).fit(top).transform(out)
        ex = self.dense.exprs(out)
        names = [f"{c}_onehot" for c in wide]
        rest = [x for x in df.columns if x not in self.inputs and x not in ex and x not in names] if keep_other else []
        return out.select(*rest, *[e.alias(n) for n, e in ex.items()], *names)


@dataclass
class OneHotEncoder:
    """E13 — sorted levels, drop first (or none), unknown → all zeros;
    ``max_categories`` keeps the most frequent (ties by value) and buckets the
    rest as ``infrequent``, the last position.  Above ``inline_limit``
    levels a column becomes one sparse vector (:class:`WideOneHotModel`)."""
    drop: str | None = "first"
    max_categories: int | None = None
    inline_limit: int = INLINE_CATEGORY_LIMIT

    def _wide(self, levels: DataFrame, c: str) -> tuple[DataFrame, int]:
        """(value, code) of the levels of one column and the length of the vector."""
        mine = levels.where(F.col("col_name") == c)
        if self.max_categories:
            many = mine.count()
            by_count = global_row_number(mine, [F.desc("n"), "value"], "_tw_r")
            kept = by_count.where(F.col("_tw_r") < self.max_categories) if many > self.max_categories else by_count
        else:
            kept = mine
        skip = 1 if self.drop == "first" else 0
        codes = global_row_number(kept, ["value"], "_tw_p").select("value", (F.col("_tw_p") - 1 - skip).cast("double").alias("code"))
        size = kept.count() - skip
        if self.max_categories and many > self.max_categories:
            codes = codes.unionAll(by_count.where(F.col("_tw_r") >= self.max_categories).select("value", F.lit(float(size)).alias("code")))
            size += 1
        return cut_lineage(codes.where(F.col("code") >= 0)), size

    def fit(self, df: DataFrame, columns) -> Model:
        columns = list(columns)
        every = cut_lineage(stack_columns(df, columns, value_type="string").groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("n")))
        many = {r["col_name"]: r["count"] for r in every.groupBy("col_name").count().collect()}
        wide = [c for c in columns if many.get(c, 0) > self.inline_limit]
        if wide:
            narrow = [c for c in columns if c not in wide]
            found = {c: self._wide(every, c) for c in wide}
            return WideOneHotModel(self.fit(df, narrow) if narrow else OneHotModel({}, self.drop == "first", {}, []),
                                   {c: t for c, (t, _) in found.items()}, {c: n for c, (_, n) in found.items()}, columns)
        lv = {c: [] for c in columns}
        for r in every.collect():                       # at most inline_limit rows a column
            lv[r["col_name"]].append((r["value"], r["n"]))
        lv = {c: sorted(v) for c, v in lv.items()}
        levels, infrequent = {}, {}
        for c, pairs in lv.items():
            if self.max_categories and len(pairs) > self.max_categories:
                top = sorted(pairs, key=lambda p: (-p[1], p[0]))[: self.max_categories - 1]
                keep = sorted(p[0] for p in top)
                infrequent[c] = sorted(p[0] for p in pairs if p[0] not in set(keep))
                levels[c] = keep
            else:
                levels[c] = [p[0] for p in pairs]
        return OneHotModel(levels, self.drop == "first", infrequent, columns)


@dataclass
class MapModel(Model):
    """Category → value(s) via a fitted table; small maps inline, large ones joined."""
    tables: dict           # column -> DataFrame(value string, <outputs...>)
    outputs: dict          # column -> list of (output name, table column)
    defaults: dict         # output name -> default for unseen/NULL
    inline: dict           # column -> {value: tuple} when small
    inputs: list = field(default_factory=list)

    def exprs(self, df):
        out = {}
        for c in self.inputs:
            if c in self.inline:
                m = self.inline[c]
                for j, (name, _) in enumerate(self.outputs[c]):
                    if m:
                        mp = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v[j]))])
                        e = mp[F.col(c).cast("string")]
                    else:
                        e = F.lit(None)
                    out[name] = F.coalesce(e.cast("double"), F.lit(self.defaults[name]))
            else:
                for name, _ in self.outputs[c]:
                    out[name] = F.coalesce(F.col(f"_tw_{name}"), F.lit(self.defaults[name]))
        return out

    def transform(self, df, keep_other=True):
        joined = df
        for c in self.inputs:
            if c not in self.inline:
                t = self.tables[c].select(F.col("value").alias(f"_tw_k_{c}"),
                                          *[F.col(tc).alias(f"_tw_{n}") for n, tc in self.outputs[c]])
                joined = joined.join(t, F.col(c).cast("string") == F.col(f"_tw_k_{c}"), "left")
        ex = self.exprs(joined)
        rest = [x for x in df.columns if x not in self.inputs and x not in ex] if keep_other else []
        return joined.select(*rest, *[e.alias(n) for n, e in ex.items()])


def _map_model(tables: dict, outputs: dict, defaults: dict, columns) -> MapModel:
    inline = {}
    for c, t in tables.items():
        n = t.count()
        if n <= INLINE_CATEGORY_LIMIT:
            cols = [tc for _, tc in outputs[c]]
            inline[c] = {r["value"]: tuple(r[x] for x in cols) for r in t.collect()}
    return MapModel(tables, outputs, defaults, inline, list(columns))


def _ordinal_table(df: DataFrame, c: str) -> DataFrame:
    levels = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("value")).distinct()
    # codes are positions of the sorted distinct values, numbered without a one-task window
    return global_row_number(levels, ["value"], "_tw_pos").select("value", (F.col("_tw_pos") - 1).cast("double").alias("code"))


def fit_ordinal(df: DataFrame, columns) -> MapModel:
    """E14 — sorted categories → 0..k−1, unknown/NULL → −1."""
    columns = list(columns)
    tables = {c: _ordinal_table(df, c) for c in columns}
    return _map_model(tables, {c: [(c, "code")] for c in columns}, {c: -1.0 for c in columns}, columns)


def fit_target_encoder(df: DataFrame, columns, target: str) -> MapModel:
    """E15 — empirical-Bayes shrinkage (smooth='auto'): λ = nσ²/(nσ² + s²_c),
    enc = λ·mean_c + (1−λ)·mean; σ² global and s²_c within-category population
    variances.  Unseen → global mean."""
    columns = list(columns)
    g = df.agg(F.avg(_v(target)).alias("m"), F.var_pop(_v(target)).alias("v")).first()
    gm, gv = g["m"], g["v"] or 0.0
    tables = {}
    for c in columns:
        st = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
              .agg(F.count(_v(target)).alias("n"), F.avg(_v(target)).alias("mc"), F.var_pop(_v(target)).alias("vc")))
        lam = F.when(F.col("n") * gv + F.col("vc") == 0, F.lit(1.0)).otherwise(
            F.col("n") * gv / (F.col("n") * gv + F.col("vc")))
        tables[c] = st.select("value", (lam * F.col("mc") + (1 - lam) * F.lit(gm)).alias("enc"))
    return _map_model(tables, {c: [(c, "enc")] for c in columns}, {c: gm for c in columns}, columns)


def cross_fit_target_encode(df: DataFrame, columns, target: str, fold: str, suffix: str = "_enc") -> DataFrame:
    """E15, training side — every row gets the encoding learnt from the other folds (column ``fold``), so its own
    target never reaches it.  One aggregate per column holds n, Σ and Σ² (centred on the overall mean) per category and
    fold; total minus fold gives what the other folds say, the same for the mean and variance of all rows.  A category
    that only this fold has, and a null, get the mean of the other folds.  Rows with a null target are encoded too."""
    columns = list(columns)
    centre = df.agg(F.avg(_v(target))).first()[0] or 0.0
    y = _v(target) - F.lit(centre)
    sums = [F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias("q")]
    less = lambda c: (F.col(f"t.{c}") - F.coalesce(F.col(f"f.{c}"), F.lit(0))).alias(c)
    mean, var = F.col("s") / F.col("n"), F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    base = df.select(F.col(fold).alias("_tw_f"), *[F.col(c).cast("string").alias(f"_tw_{i}") for i, c in enumerate(columns)], _v(target).alias(target))
    folds = cut_lineage(base.groupBy("_tw_f").agg(*sums))                              # one row per fold
    everyone = folds.agg(*[F.sum(c).alias(c) for c in "nsq"])
    rest = folds.alias("f").crossJoin(F.broadcast(everyone.alias("t"))).select("f._tw_f", *[less(c) for c in "nsq"])      # one row per fold
    rest = rest.select("_tw_f", mean.alias("_tw_m"), var.alias("_tw_v"))
    out = df.join(F.broadcast(rest.withColumnRenamed("_tw_f", "_tw_g")), F.col(fold).eqNullSafe(F.col("_tw_g")), "left")
    for i, c in enumerate(columns):
        cells = cut_lineage(base.where(F.col(f"_tw_{i}").isNotNull()).groupBy(F.col(f"_tw_{i}").alias("value"), "_tw_f").agg(*sums))
        total = cells.groupBy("value").agg(*[F.sum(x).alias(x) for x in "nsq"])
        other = (cells.alias("f").join(total.alias("t"), "value").select("value", F.col("f._tw_f").alias("_tw_f"), *[less(x) for x in "nsq"])
                 .where("n > 0").select(F.col("value").alias("_tw_k"), F.col("_tw_f").alias("_tw_h"), F.col("n").alias("_tw_n"), mean.alias("_tw_mc"), var.alias("_tw_vc")))
        out = out.join(cut_lineage(other), (F.col(c).cast("string") == F.col("_tw_k")) & F.col(fold).eqNullSafe(F.col("_tw_h")), "left")
        weight = F.col("_tw_n") * F.col("_tw_v") + F.col("_tw_vc")
        lam = F.when(weight == 0, F.lit(1.0)).otherwise(F.col("_tw_n") * F.col("_tw_v") / weight)
        enc = F.coalesce(lam * F.col("_tw_mc") + (1 - lam) * F.col("_tw_m"), F.col("_tw_m")) + F.lit(centre)
        out = out.withColumn(c + suffix, enc).drop("_tw_k", "_tw_h", "_tw_n", "_tw_mc", "_tw_vc")
    return out.drop("_tw_g", "_tw_m", "_tw_v")


def fit_binary_encoder(df: DataFrame, columns) -> MapModel:
    """E16 — binary digits of the (1-based, sorted) ordinal code; unknown → zeros."""
    columns = list(columns)
    tables, outputs, defaults = {}, {}, {}
    for c in columns:
        t = _ordinal_table(df, c)
        k = t.count()
        digits = max(1, int(math.floor(math.log2(k))) + 1) if k else 1
        code = (F.col("code") + 1).cast("long")
        t = t.select("value", *[F.shiftright(code, digits - 1 - i).bitwiseAND(F.lit(1)).cast("double").alias(f"b{i}")
                                for i in range(digits)])
        tables[c] = t
        outputs[c] = [(f"{c}_{i}", f"b{i}") for i in range(digits)]
        defaults.update({f"{c}_{i}": 0.0 for i in range(digits)})
    return _map_model(tables, outputs, defaults, columns)


def hashing_encode(df: DataFrame, columns, n_components: int = 8) -> DataFrame:
    """E17 — one-hot of pmod(xxhash64(value), n) over ``columns`` summed into
    col_0..col_{n−1} (stateless; a different hash than other libraries)."""
    columns = list(columns)
    buckets = [F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n_components)) for c in columns]
    outs = []
    for i in range(n_components):
        s = F.lit(0.0)
        for b, c in zip(buckets, columns):
            s = s + F.when(F.col(c).isNotNull() & (b == i), 1.0).otherwise(0.0)
        outs.append(s.alias(f"col_{i}"))
    return df.select(*[x for x in df.columns if x not in columns], *outs)


@dataclass
class HashingModel:
    """E17 as a fitted step: stateless, so fitting only keeps the columns."""
    columns: list
    n_components: int = 8

    def transform(self, df: DataFrame, keep_other: bool = True) -> DataFrame:
        return hashing_encode(df if keep_other else df.select(*self.columns), self.columns, self.n_components)


def fit_hashing(df: DataFrame, columns, n_components: int = 8) -> HashingModel:
    return HashingModel(list(columns), n_components)


def fit_leave_one_out(df: DataFrame, columns, target: str) -> MapModel:
    """E18 — transform side: category mean (unseen → global mean).  For the
    training rows use :func:`leave_one_out_train` ((Σy − y)/(n − 1))."""
    columns = list(columns)
    gm = df.agg(F.avg(_v(target))).first()[0]
    tables = {c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
              .agg(F.avg(_v(target)).alias("enc")) for c in columns}
    return _map_model(tables, {c: [(c, "enc")] for c in columns}, {c: gm for c in columns}, columns)


def leave_one_out_train(df: DataFrame, columns, target: str) -> DataFrame:
    """E18 — training-row encoding (Σ_c y − y)/(n_c − 1); singletons → global mean.

    Category sums come from a ``groupBy`` joined back (AQE broadcasts it when
    small); a hot category only makes that join's probe side large."""
    gm = df.agg(F.avg(_v(target))).first()[0]
    out = df
    for c in columns:
        st = out.groupBy(c).agg(F.sum(_v(target)).alias(f"_tw_s_{c}"), F.count(_v(target)).alias(f"_tw_n_{c}"))
        out = out.join(st, c, "left")
        enc = F.when(F.col(f"_tw_n_{c}") > 1, (F.col(f"_tw_s_{c}") - _v(target)) / (F.col(f"_tw_n_{c}") - 1)) \
            .otherwise(F.lit(gm))
        out = out.withColumn(f"{c}_loo", enc).drop(f"_tw_s_{c}", f"_tw_n_{c}")
    return out


def fit_woe(df: DataFrame, columns, target: str, regularization: float = 1.0) -> MapModel:
    """E19 — weight of evidence for a 0/1 target:
    ln(((pos_c + a)/(P + 2a)) / ((neg_c + a)/(N + 2a)))."""
    columns = list(columns)
    tot = df.agg(F.sum(F.when(_v(target) == 1, 1).otherwise(0)).alias("p"),
                 F.sum(F.when(_v(target) == 0, 1).otherwise(0)).alias("n")).first()
    P, N, a = float(tot["p"]), float(tot["n"]), regularization
    tables = {}
    for c in columns:
        st = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
              .agg(F.sum(F.when(_v(target) == 1, 1).otherwise(0)).alias("pos"),
                   F.sum(F.when(_v(target) == 0, 1).otherwise(0)).alias("neg")))
        tables[c] = st.select("value", F.log(((F.col("pos") + a) / (P + 2 * a)) /
                                             ((F.col("neg") + a) / (N + 2 * a))).alias("woe"))
    return _map_model(tables, {c: [(c, "woe")] for c in columns}, {c: 0.0 for c in columns}, columns)
