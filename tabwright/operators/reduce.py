"""Dimension reduction and feature selection.

PCA is fitted from ONE aggregate of all pairwise covariances (p(p+1)/2 sums);
the p×p eigen-decomposition runs on the driver (p is the number of columns,
not rows); scores and reconstruction errors are column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.session import cut_lineage


def covariance_matrix(df: DataFrame, columns, ddof: int = 1) -> DataFrame:
    """Long (col_a, col_b, cov) for all ordered pairs, one aggregate (pairwise complete)."""
    cols = list(columns)
    f = F.covar_samp if ddof == 1 else F.covar_pop
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[f(B.as_double(a), B.as_double(b)).alias(f"_c{k}") for k, (a, b) in enumerate(pairs)])
    st = []
    for k, (a, b) in enumerate(pairs):
        st.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_c{k}").alias("cov")))
        if a != b:
            st.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"_c{k}").alias("cov")))
    return row.select(F.inline(F.array(*st)))


@dataclass
class PCAModel:
    columns: list
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray          # k × p
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    whiten: bool = False

    def _z(self, c_idx) -> Column:
        c = self.columns[c_idx]
        return (B.as_double(c) - F.lit(float(self.mean[c_idx]))) / F.lit(float(self.scale[c_idx]))

    def transform(self, df: DataFrame, keep=(), prefix: str = "PC") -> DataFrame:
        outs = []
        for k in range(self.components.shape[0]):
            e = F.lit(0.0)
            for j in range(len(self.columns)):
                e = e + F.lit(float(self.components[k, j])) * self._z(j)
            if self.whiten:
                e = e / F.lit(float(math.sqrt(max(self.explained_variance[k], 1e-300))))
            outs.append(e.alias(f"{prefix}{k + 1}"))
        return df.select(*keep, *outs)

    def reconstruction_error(self, df: DataFrame, keep=()) -> DataFrame:
        """E29 — ‖z − ẑ‖ per row in the standardised/centred space."""
        scores = [F.lit(0.0) for _ in range(self.components.shape[0])]
        for k in range(self.components.shape[0]):
            for j in range(len(self.columns)):
                scores[k] = scores[k] + F.lit(float(self.components[k, j])) * self._z(j)
        err = F.lit(0.0)
        for j in range(len(self.columns)):
            rec = F.lit(0.0)
            for k in range(self.components.shape[0]):
                rec = rec + scores[k] * F.lit(float(self.components[k, j]))
            d = self._z(j) - rec
            err = err + d * d
        return df.select(*keep, F.sqrt(err).alias("reconstruction_error"))

    def loadings(self, spark) -> DataFrame:
        rows = [(f"PC{k + 1}", c, float(self.components[k, j]), float(self.explained_variance_ratio[k]))
                for k in range(self.components.shape[0]) for j, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "component string, feature string, loading double, explained_ratio double")

    def explained(self, spark) -> DataFrame:
        """W9 — explained ratio and its running sum over component index."""
        rows = [(k + 1, float(r)) for k, r in enumerate(self.explained_variance_ratio)]
        df = spark.createDataFrame(rows, "component int, explained_ratio double")
        # one row per component: the running window is over p rows
        return df.withColumn("cumulative", F.sum("explained_ratio").over(
            Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))


def fit_pca(df: DataFrame, columns, n_components: int = 2, scale: bool = True, whiten: bool = False) -> PCAModel:
    """E28 — centred (optionally standardised) PCA, n = min(k, p); components'
    signs fixed so the largest-|loading| entry is positive."""
    cols = list(columns)
    p = len(cols)
    row = df.agg(*[F.avg(B.as_double(c)).alias(f"m{j}") for j, c in enumerate(cols)],
                 *[F.stddev_pop(B.as_double(c)).alias(f"s{j}") for j, c in enumerate(cols)],
                 *[F.covar_samp(B.as_double(a), B.as_double(b)).alias(f"c{i}_{j}")
                   for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]).first()
    mean = np.array([row[f"m{j}"] for j in range(p)], dtype=float)
    sd = np.array([row[f"s{j}"] or 1.0 for j in range(p)], dtype=float)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    if scale:
        # correlation-type matrix of standardised columns (ddof 0 scaling like a standard scaler)
        cov = cov / np.outer(sd, sd)
    else:
        sd = np.ones(p)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    k = min(n_components, p)
    comps = vecs[:, :k].T.copy()
    for r in range(k):
        j = int(np.argmax(np.abs(comps[r])))
        if comps[r, j] < 0:
            comps[r] = -comps[r]
    ratio = vals / vals.sum() if vals.sum() > 0 else np.zeros_like(vals)
    return PCAModel(cols, mean, sd, comps, vals[:k], ratio[:k], whiten)


def f_scores(df: DataFrame, features, target: str, task: str = "regression") -> DataFrame:
    """E30 — univariate F statistic per feature: regression F = r²/(1−r²)·(n−2);
    classification one-way ANOVA F = (SSB/(k−1)) / (SSW/(n−k)).  One aggregate
    (regression) or one grouped aggregate over classes (classification)."""
    feats = list(features)
    if task == "regression":
        row = df.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.corr(B.as_double(c), B.as_double(target)).alias(c) for c in feats])
        st = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in feats])
        out = row.select("_n", F.inline(st))
        return out.select("feature", (F.col("r") * F.col("r") / (1 - F.col("r") * F.col("r")) * (F.col("_n") - 2)).alias("f_score"))
    g = df.groupBy(F.col(target).alias("_y")).agg(F.count(F.lit(1)).alias("_n"),
                                                   *[F.sum(B.as_double(c)).alias(f"s_{c}") for c in feats],
                                                   *[F.sum(B.as_double(c) * B.as_double(c)).alias(f"q_{c}") for c in feats])
    tot = g.agg(F.sum("_n").alias("N"), F.count(F.lit(1)).alias("K"),
                *[F.sum(f"s_{c}").alias(f"S_{c}") for c in feats], *[F.sum(f"q_{c}").alias(f"Q_{c}") for c in feats],
                *[F.sum(F.col(f"s_{c}") * F.col(f"s_{c}") / F.col("_n")).alias(f"B_{c}") for c in feats])
    sts = []
    for c in feats:
        ssb = F.col(f"B_{c}") - F.col(f"S_{c}") * F.col(f"S_{c}") / F.col("N")
        ssw = F.col(f"Q_{c}") - F.col(f"B_{c}")
        sts.append(F.struct(F.lit(c).alias("feature"), ((ssb / (F.col("K") - 1)) / (ssw / (F.col("N") - F.col("K")))).alias("f_score")))
    return tot.select(F.inline(F.array(*sts)))


def select_k_best(scores: DataFrame, k: int | None = None, percentile: float | None = None,
                  score_col: str = "f_score") -> DataFrame:
    """E30/E31 — keep the k best (or the top percentile) features by score."""
    w = Window.orderBy(F.desc_nulls_last(score_col), "feature")
    out = scores.withColumn("rank", F.row_number().over(w))
    if k is not None:
        return out.where(F.col("rank") <= k)
    if percentile is not None:
        n = scores.count()
        return out.where(F.col("rank") <= max(1, int(math.ceil(n * percentile / 100.0))))
    return out


def mutual_information(df: DataFrame, features, target: str, bins: int = 10, target_bins: int | None = None) -> DataFrame:
    """E31 — binned mutual information I(X; Y) per feature (nats): equal-width
    bins over [min, max] for each feature (and for a numeric target when
    ``target_bins`` is given), contingency counts from one grouped aggregate
    per feature, MI = Σ p(x,y)·ln(p(x,y) / (p(x)p(y))).  A binned estimator, not
    the k-nearest-neighbour one."""
    feats = list(features)
    mm = df.agg(*[x for c in feats for x in (F.min(B.as_double(c)).alias(f"{c}__lo"), F.max(B.as_double(c)).alias(f"{c}__hi"))],
                *([F.min(B.as_double(target)).alias("_tlo"), F.max(B.as_double(target)).alias("_thi")] if target_bins else [])).first()

    def binexpr(c, lo, hi, b):
        if lo is None or hi is None or hi == lo:
            return F.lit(0)
        return F.least(F.floor((B.as_double(c) - F.lit(lo)) / F.lit(hi - lo) * b), F.lit(b - 1)).cast("int")
    y = binexpr(target, mm["_tlo"], mm["_thi"], target_bins).cast("string") if target_bins else F.col(target).cast("string")
    parts = [df.select(F.lit(c).alias("feature"), binexpr(c, mm[f"{c}__lo"], mm[f"{c}__hi"], bins).alias("bx"),
                       y.alias("by")).where(B.as_double(c).isNotNull() & F.col(target).isNotNull()) for c in feats]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    cell = u.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("nxy"))
    wf = Window.partitionBy("feature")
    # cell has ≤ features × bins × classes rows: these windows run over that small table
    cell = (cell.withColumn("n", F.sum("nxy").over(wf))
            .withColumn("nx", F.sum("nxy").over(Window.partitionBy("feature", "bx")))
            .withColumn("ny", F.sum("nxy").over(Window.partitionBy("feature", "by"))))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return cell.groupBy("feature").agg(F.sum(term).alias("mi"))


def select_from_model(importances: dict, threshold="mean", max_features: int | None = None) -> list:
    """E32 — features whose |coefficient| / importance ≥ threshold ('mean' or a number)."""
    vals = {k: abs(v) for k, v in importances.items()}
    thr = (sum(vals.values()) / len(vals)) if threshold == "mean" else float(threshold)
    keep = sorted([k for k, v in vals.items() if v >= thr], key=lambda k: (-vals[k], k))
    return keep[:max_features] if max_features else keep


def greedy_non_redundant(df: DataFrame, target: str, features, top_n: int | None = None,
                         max_inter_corr: float = 0.9, first: int = 200) -> list:
    """T6 — by |r| with the target (desc), skip a feature whose |corr| with an
    already chosen one exceeds 0.9; cap min(n/5, 50) among the first 200.
    Two aggregates (target correlations, pairwise correlations of ≤ 200 columns)."""
    feats = list(features)
    r = df.agg(*[F.corr(B.as_double(c), B.as_double(target)).alias(c) for c in feats]).first().asDict()
    ranked = sorted([c for c in feats if r[c] is not None and not math.isnan(r[c])], key=lambda c: (-abs(r[c]), c))[:first]
    n = df.count()
    cap = top_n or min(max(1, n // 5), 50)
    pairs = [(a, b) for i, a in enumerate(ranked) for b in ranked[i + 1:]]
    pc = df.agg(*[F.corr(B.as_double(a), B.as_double(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else {}
    corr = {}
    for i, (a, b) in enumerate(pairs):
        corr[(a, b)] = corr[(b, a)] = abs(pc[f"{i}"] or 0.0)
    chosen = []
    for c in ranked:
        if len(chosen) >= cap:
            break
        if all(corr.get((c, x), 0.0) <= max_inter_corr for x in chosen):
            chosen.append(c)
    return chosen


def maximin_selection(df: DataFrame, key: str, vector_cols, n_select: int, checkpoint_every: int = 5) -> list:
    """T7 — start at the smallest key, repeatedly take the row farthest (Euclidean)
    from the chosen set.  Each round is one distributed job: update the running
    ``least(min_dist, dist(new))`` and take ``max_by``; the state column is
    checkpointed every few rounds so lineage stays short."""
    cols = list(vector_cols)
    cur = df.select(key, *[B.as_double(c).alias(c) for c in cols])
    first = cur.orderBy(key).first()
    chosen = [first[key]]
    point = [first[c] for c in cols]
    cur = cur.withColumn("_tw_d", F.lit(float("inf")))
    for r in range(1, n_select):
        d = F.lit(0.0)
        for c, v in zip(cols, point):
            d = d + (F.col(c) - F.lit(float(v))) ** 2
        cur = cur.withColumn("_tw_d", F.least(F.col("_tw_d"), F.sqrt(d)))
        if r % checkpoint_every == 0:
            cur = cut_lineage(cur)
        best = cur.agg(F.max_by(F.struct(key, *cols), F.struct("_tw_d", (-F.col(key)).alias("_k"))).alias("b")).first()["b"]
        chosen.append(best[key])
        point = [best[c] for c in cols]
    return chosen


def hat_diagonal(df: DataFrame, features, keep=(), ridge: float = 0.0) -> DataFrame:
    """L1 — leverage h_ii = x_iᵀ (XᵀX + λI)⁻¹ x_i of standardised rows; XᵀX from one
    aggregate, the p×p inverse on the driver, h_ii as an expression (|h| ≤ 1)."""
    feats = list(features)
    p = len(feats)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(B.as_double(c)).alias(f"m{j}") for j, c in enumerate(feats)],
                 *[F.stddev_pop(B.as_double(c)).alias(f"s{j}") for j, c in enumerate(feats)]).first()
    z = [(B.as_double(c) - F.lit(row[f"m{j}"])) / F.lit(row[f"s{j}"] or 1.0) for j, c in enumerate(feats)]
    xtx_row = df.agg(*[F.sum(z[i] * z[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    xtx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            xtx[i, j] = xtx[j, i] = xtx_row[f"x{i}_{j}"]
    n = row["_n"]
    lam = ridge if ridge else (1e-6 if n <= p else 0.0)
    m = np.linalg.inv(xtx + lam * np.eye(p))
    h = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            h = h + F.lit(float(m[i, j])) * z[i] * z[j]
    return df.select(*keep, F.least(F.greatest(F.abs(h), F.lit(0.0)), F.lit(1.0)).alias("leverage"))
