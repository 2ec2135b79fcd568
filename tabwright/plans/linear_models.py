"""Models fitted from sufficient statistics (M9 PLS, M10 Bayesian ridge, E4
iterative imputation): XᵀX, Xᵀy, yᵀy and n come from ONE aggregate; the p×p
algebra runs on the driver; predictions are column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B


def sufficient_stats(df: DataFrame, features, target: str | None = None, weight: str | None = None):
    """(n, mean_x, mean_y, Sxx (centred), sxy (centred), syy) from one aggregate."""
    feats = list(features)
    p = len(feats)
    w = B.as_double(weight) if weight else F.lit(1.0)
    xs = [B.as_double(c) for c in feats]
    y = B.as_double(target) if target else F.lit(0.0)
    aggs = [F.sum(w).alias("n"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy")]
    aggs += [F.sum(w * x).alias(f"s{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(w * xs[i] * xs[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(w * x * y).alias(f"r{i}") for i, x in enumerate(xs)]
    r = df.agg(*aggs).first()
    n = r["n"]
    mx = np.array([r[f"s{i}"] / n for i in range(p)])
    my = r["sy"] / n
    S = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            S[i, j] = S[j, i] = r[f"q{i}_{j}"] - n * mx[i] * mx[j]
    sxy = np.array([r[f"r{i}"] - n * mx[i] * my for i in range(p)])
    syy = r["syy"] - n * my * my
    return n, mx, my, S, sxy, syy


@dataclass
class LinearExprModel:
    features: list
    coef: np.ndarray
    intercept: float

    def predict_expr(self) -> Column:
        e = F.lit(float(self.intercept))
        for c, b in zip(self.features, self.coef):
            e = e + F.lit(float(b)) * B.as_double(c)
        return e

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.predict_expr())


def fit_pls(df: DataFrame, features, target: str, n_components: int = 2, scale: bool = True) -> LinearExprModel:
    """M9 — PLS1 by NIPALS in covariance form (S ← S − (tᵀt)ppᵀ, s ← s − p·wᵀs)."""
    feats = list(features)
    n, mx, my, S, s, _ = sufficient_stats(df, feats, target)
    sd = np.sqrt(np.diag(S) / n) if scale else np.ones(len(feats))
    sd[sd == 0] = 1.0
    S = S / np.outer(sd, sd)
    s = s / sd
    W, P, Q = [], [], []
    for _ in range(min(n_components, len(feats))):
        w = s / (np.linalg.norm(s) or 1.0)
        tt = float(w @ S @ w)
        if tt <= 1e-300:
            break
        p_ = S @ w / tt
        q = float(w @ s) / tt
        S = S - tt * np.outer(p_, p_)
        s = s - p_ * float(w @ s)
        W.append(w), P.append(p_), Q.append(q)
    W, P, Q = np.array(W).T, np.array(P).T, np.array(Q)
    beta_z = W @ np.linalg.solve(P.T @ W, Q)
    coef = beta_z / sd
    return LinearExprModel(feats, coef, float(my - mx @ coef))


def fit_bayesian_ridge(df: DataFrame, features, target: str, n_iter: int = 300, tol: float = 1e-3,
                       alpha_1=1e-6, alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6) -> LinearExprModel:
    """M10 — evidence maximisation of noise precision α and weight precision λ
    (the standard fixed-point updates) on the centred statistics."""
    feats = list(features)
    n, mx, my, S, sxy, syy = sufficient_stats(df, feats, target)
    eig = np.clip(np.linalg.eigvalsh(S), 0, None)
    alpha = 1.0 / (syy / n + 1e-12)
    lam = 1.0
    coef = np.zeros(len(feats))
    for _ in range(n_iter):
        coef_new = np.linalg.solve(S + (lam / alpha) * np.eye(len(feats)), sxy)
        sse = syy - 2 * coef_new @ sxy + coef_new @ S @ coef_new
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2 * lambda_1) / (float(coef_new @ coef_new) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (max(sse, 1e-300) + 2 * alpha_2)
        done = np.sum(np.abs(coef - coef_new)) < tol
        coef = coef_new
        if done:
            break
    return LinearExprModel(feats, coef, float(my - mx @ coef))


def fit_ard(df: DataFrame, features, target: str, n_iter: int = 300, tol: float = 1e-3, alpha_1=1e-6, alpha_2=1e-6,
            lambda_1=1e-6, lambda_2=1e-6, prune_above: float = 1e4) -> LinearExprModel:
    """M10 — automatic relevance determination: a precision per coefficient, updated by the evidence; coefficients whose
    precision reaches ``prune_above`` are 0 from then on.  All rounds work on the centred statistics of one aggregate."""
    feats = list(features)
    n, mx, my, S, sxy, syy = sufficient_stats(df, feats, target)
    alpha, lam, keep, coef = 1.0 / (syy / n + np.finfo(float).eps), np.ones(len(feats)), np.ones(len(feats), bool), np.zeros(len(feats))

    def posterior():
        cov = np.linalg.pinv(np.diag(lam[keep]) + alpha * S[np.ix_(keep, keep)], hermitian=True)
        out = np.zeros(len(feats))
        out[keep] = alpha * cov @ sxy[keep]
        return cov, out
    for _ in range(n_iter):
        cov, now = posterior()
        sse = max(float(syy - 2 * now @ sxy + now @ S @ now), 0.0)
        known = 1.0 - lam[keep] * np.diag(cov)                      # how far the data, not the prior, fix each coefficient
        lam[keep] = (known + 2 * lambda_1) / (now[keep] ** 2 + 2 * lambda_2)
        alpha = (n - known.sum() + 2 * alpha_1) / (sse + 2 * alpha_2)
        keep = lam < prune_above
        now[~keep] = 0.0
        done = np.abs(coef - now).sum() < tol
        coef = now
        if done or not keep.any():
            break
    if keep.any():
        coef = posterior()[1]
    return LinearExprModel(feats, coef, float(my - mx @ coef))


def iterative_impute(df: DataFrame, columns, n_iter: int = 10) -> DataFrame:
    """E4 — round-robin regression imputation: every round, for each column with
    NULLs, fit OLS on the other columns (one aggregate per column: the
    statistics of rows where it is observed, others currently filled), then
    replace its NULLs by the prediction.  Starts from the mean; the filled
    values are column expressions over the original columns, so the plan stays
    a projection."""
    cols = list(columns)
    means = df.agg(*[F.avg(B.as_double(c)).alias(c) for c in cols]).first().asDict()
    cur = {c: F.coalesce(B.as_double(c), F.lit(means[c])) for c in cols}
    has_null = [c for c in cols if df.where(B.as_double(c).isNull()).limit(1).count() > 0]
    for _ in range(n_iter):
        for c in has_null:
            others = [o for o in cols if o != c]
            if not others:
                continue
            tmp = df.select(B.as_double(c).alias("_y"), *[cur[o].alias(o) for o in others]).where(F.col("_y").isNotNull())
            n, mx, my, S, sxy, _ = sufficient_stats(tmp, others, "_y")
            coef = np.linalg.lstsq(S + 1e-9 * np.eye(len(others)), sxy, rcond=None)[0]
            pred = F.lit(float(my - mx @ coef))
            for o, b in zip(others, coef):
                pred = pred + F.lit(float(b)) * cur[o]
            cur[c] = F.coalesce(B.as_double(c), pred)
    return df.select(*[cur[c].alias(c) if c in cur else F.col(c) for c in df.columns])
