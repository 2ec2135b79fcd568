"""Surrogate on random Fourier features (O5, O6, O12): Bayesian linear regression on
√(2/D)·cos(ωᵀx/ℓ + b), which has an RBF kernel with length scale ℓ in the limit.

All that a fit needs of the observations is one Gram matrix of (features, 1, targets): every task sums its rows,
the partial matrices are added row by row in two grouped steps, and (D + 1 + targets)² numbers reach the driver,
whatever the number of observations.  Several targets share it.  Noise and length scale maximise the evidence, which
is a closed form of the Gram's eigenvalues.  A believed observation is a rank-one addition.

Rows with a null in a feature or a target are not learnt from; a candidate with a null in a feature gets null
predictions.  Constant features count as 0.  No complete observation raises ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import boundary as B

NOISES = tuple(10.0 ** e for e in np.arange(-6.0, 0.6, 0.5))
FAN_IN = 256                                    # partial matrices that one task of the first step adds
BLOCK = 1024                                    # rows whose features are held at a time


@dataclass
class FourierBasis:
    """ω/ℓ and b for each length scale, on standardised inputs."""
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray                           # D × p, before the length scale
    phase: np.ndarray

    def __call__(self, X: np.ndarray, length: float) -> np.ndarray:
        Z = (X - self.mean) / self.scale
        return np.sqrt(2.0 / len(self.phase)) * np.cos(Z @ self.omega.T / length + self.phase)


def _sums(basis: FourierBasis, lengths, n_targets: int, shift: np.ndarray, width: np.ndarray):
    """Gram rows of a task, one matrix per length scale; rows are taken in blocks that stay in the processor's cache."""
    def run(batches):
        import pandas as pd
        from pyspark import TaskContext
        total, d = None, len(basis.phase)
        E, Z = np.ones((BLOCK, d + 1 + n_targets)), np.empty((BLOCK, d))
        for pdf in batches:
            V = pdf.to_numpy(float)
            total = np.zeros((len(lengths), E.shape[1], E.shape[1])) if total is None else total
            for lo in range(0, len(V), BLOCK):
                v = V[lo:lo + BLOCK]
                e, z = E[:len(v)], Z[:len(v)]
                e[:, d + 1:] = (v[:, v.shape[1] - n_targets:] - shift) / width
                angle = ((v[:, : v.shape[1] - n_targets] - basis.mean) / basis.scale) @ basis.omega.T
                for s, length in enumerate(lengths):
                    np.divide(angle, length, out=z)
                    z += basis.phase
                    np.cos(z, out=e[:, :d])
                    total[s] += e.T @ e
        if total is not None:
            total[:, :d] *= np.sqrt(2.0 / d)
            total[:, :, :d] *= np.sqrt(2.0 / d)
            part = TaskContext.get().partitionId()
            for s in range(len(lengths)):
                yield pd.DataFrame({"s": s, "i": range(len(total[s])), "part": part, "row": list(total[s])})
    return run


def _added(keys):
    def add(pdf):
        import pandas as pd
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "row": np.sum(np.stack(pdf["row"].to_numpy()), axis=0)}])
    return add


def gram(rows: DataFrame, basis: FourierBasis, lengths, n_targets: int, shift, width) -> np.ndarray:
    """(scales, m, m) sums of outer products of (features, 1, standardised targets) over ``rows``."""
    parts = rows.mapInPandas(_sums(basis, lengths, n_targets, shift, width), "s int, i int, part int, row array<double>")
    parts = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
    some = parts.groupBy("s", "i", "part").applyInPandas(_added(["s", "i", "part"]), "s int, i int, part int, row array<double>")
    got = some.groupBy("s", "i").applyInPandas(_added(["s", "i"]), "s int, i int, row array<double>").collect()
    m = len(basis.phase) + 1 + n_targets
    out = np.zeros((len(lengths), m, m))
    for r in got:
        out[r["s"], r["i"]] = r["row"]
    return out


@dataclass
class FourierSurrogate:
    """Posterior of one target: mean zᵀw and variance zᵀA⁻¹z, z = (features, 1)."""
    basis: FourierBasis
    length: float
    noise: float
    precision: np.ndarray                       # A
    moment: np.ndarray                          # Zᵀy / noise
    shift: float
    width: float

    def __post_init__(self):
        L = np.linalg.cholesky(self.precision)
        self.root = np.linalg.inv(L)
        self.weights = self.root.T @ (self.root @ self.moment)

    def _z(self, X):
        return np.hstack([self.basis(X, self.length), np.ones((len(X), 1))])

    def predict(self, X):
        Z = self._z(np.asarray(X, float))
        return Z @ self.weights * self.width + self.shift, np.sqrt(((Z @ self.root.T) ** 2).sum(1)) * self.width

    def believe(self, x, y: float) -> "FourierSurrogate":
        """The posterior after one more observation."""
        z = self._z(np.asarray([x], float))[0]
        return replace(self, precision=self.precision + np.outer(z, z) / self.noise,
                       moment=self.moment + z * ((y - self.shift) / self.width) / self.noise)


def _evidence(values, c, yy, n, noise):
    """Log marginal likelihood under unit prior variance; ``c`` = Vᵀ Zᵀy."""
    fit = yy - (c * c / (values + noise)).sum()
    return -0.5 * (n * np.log(2 * np.pi * noise) + np.log1p(values / noise).sum() + fit / noise)


def fit_fourier(observed: DataFrame, features, targets, n_features: int = 256, length_scale: float | None = None,
                scales=(0.25, 0.5, 1.0), noise: float | None = None, seed: int = 42) -> list[FourierSurrogate]:
    """One surrogate per target.  The length scale is ``length_scale``, or the best of ``scales`` times the root of the
    mean squared distance of two rows; the noise variance (of the standardised target) is ``noise`` or the best of ``NOISES``."""
    feats, targets = list(features), list(targets)
    rows = observed.select(*[B.as_double(c).alias(f"x{i}") for i, c in enumerate(feats)],
                           *[B.as_double(c).alias(f"y{i}") for i, c in enumerate(targets)]).dropna()
    st = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(k + c) for c in rows.columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = st["n"]
    if not n:
        raise ValueError("no complete observation to learn from")
    mean = {c: st["m" + c] for c in rows.columns}
    dev = {c: st["s" + c] if st["s" + c] and st["s" + c] > 1e-12 * max(1.0, abs(st["m" + c])) else 0.0 for c in rows.columns}
    xs = [f"x{i}" for i in range(len(feats))]
    ys = [f"y{i}" for i in range(len(targets))]
    live = sum(1 for c in xs if dev[c])
    rng = np.random.RandomState(seed)
    basis = FourierBasis(np.array([mean[c] for c in xs]), np.array([dev[c] or np.inf for c in xs]),
                         rng.standard_normal((n_features, len(xs))), rng.uniform(0, 2 * np.pi, n_features))
    lengths = [length_scale] if length_scale else [s * np.sqrt(2.0 * max(live, 1)) for s in scales]
    shift, width = np.array([mean[c] for c in ys]), np.array([dev[c] or 1.0 for c in ys])
    G = gram(rows, basis, lengths, len(ys), shift, width)
    m = n_features + 1
    best = [None] * len(ys)
    for s, length in enumerate(lengths):
        values, V = np.linalg.eigh(G[s, :m, :m])
        values = np.maximum(values, 0.0)
        for t in range(len(ys)):
            zy, yy = G[s, :m, m + t], G[s, m + t, m + t]
            for v in ((noise,) if noise else NOISES):
                e = _evidence(values, V.T @ zy, yy, n, v)
                if best[t] is None or e > best[t][0]:
                    best[t] = (e, s, length, v, zy)
    return [FourierSurrogate(basis, length, v, G[s, :m, :m] / v + np.eye(m), zy / v, float(shift[t]), float(width[t]))
            for t, (_, s, length, v, zy) in enumerate(best)]


def fit_fourier_sets(observed: DataFrame, features, sets, **kw) -> list[list[FourierSurrogate]]:
    """:func:`fit_fourier` for several lists of targets.  Where all learn from the same rows, because no target is missing
    in a row that another list learns from, one Gram matrix serves them all; else each has its own."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    has = lambda cols: reduce(and_, [B.as_double(c).isNotNull() for c in [*features, *cols]])
    seen = observed.agg(*[F.count(F.when(has(s), 1)).alias(f"n{i}") for i, s in enumerate([names, *sets])]).first()
    if len(set(seen)) > 1:
        return [fit_fourier(observed, features, s, **kw) for s in sets]
    models = dict(zip(names, fit_fourier(observed, features, names, **kw)))
    return [[models[c] for c in s] for s in sets]


def predict_fourier(cands: DataFrame, models: list[FourierSurrogate], features, names) -> DataFrame:
    """``names`` holds a (mean column, deviation column or None) pair per model; the models (D² numbers each) are broadcast."""
    feats = list(features)
    held = cands.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scored(x):
        import pandas as pd
        X = np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), len(feats))
        got = np.hstack([np.stack(m.predict(X), axis=1) for m in held.value])
        return pd.Series([None if np.isnan(r).any() else r for r in got], dtype=object)

    out = cands.withColumn("_tw_f", scored(F.array(*[B.as_double(c) for c in feats])))
    for t, (mu, sigma) in enumerate(names):
        out = out.withColumn(mu, F.get("_tw_f", F.lit(2 * t)))
        out = out if sigma is None else out.withColumn(sigma, F.get("_tw_f", F.lit(2 * t + 1)))
    return out.drop("_tw_f")
