"""Surrogate-model suggestion (F14, O5, O6, O12) and the genetic inverse search.

The surrogate is a Bayesian linear model on random Fourier features (:mod:`tabwright.plans.fourier`): any number of
observations is one distributed aggregate, and the candidates are scored in Arrow batches, so both tables may be
arbitrarily large.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import boundary as B
from tabwright.plans.fourier import FourierSurrogate, fit_fourier, predict_fourier


def _phi(z):
    return 0.5 * (1.0 + np.vectorize(math.erf)(z / math.sqrt(2.0)))


def _pdf(z):
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def acquisition_values(mu, sigma, kind="ei", best=0.0, xi=0.01, kappa=2.0, lo=None, hi=None,
                       objective="maximize"):
    """F14 — EI / PI / UCB / PTR on numpy arrays; σ < 1e-9 gives 0 for EI/PI/PTR."""
    mu = np.asarray(mu, dtype=float)
    raw = np.asarray(sigma, dtype=float)
    sigma = np.maximum(raw, 1e-9)
    kind = kind.lower()
    if kind in ("ei", "pi"):
        imp = (mu - best - xi) if objective == "maximize" else (best - mu - xi)
        z = imp / sigma
        out = imp * _phi(z) + sigma * _pdf(z) if kind == "ei" else _phi(z)
    elif kind == "ucb":
        return (mu + kappa * sigma) if objective == "maximize" else (-mu + kappa * sigma)
    elif kind == "ptr":
        if lo is None or hi is None:
            raise ValueError("PTR needs a target interval")
        out = _phi((hi - mu) / sigma) - _phi((lo - mu) / sigma)
    else:
        raise ValueError(f"unknown acquisition: {kind}")
    out = np.where(raw < 1e-9, 0.0, out)
    return out


def acquisition(df: DataFrame, mu: str, sigma: str, kind="ei", best=0.0, xi=0.01, kappa=2.0, lo=None, hi=None,
                objective="maximize", name: str = "acquisition") -> DataFrame:
    """F14 as a vectorised pandas UDF column (no erf in Spark SQL)."""
    @F.pandas_udf(T.DoubleType())
    def acq(m, s):
        import pandas as pd
        return pd.Series(acquisition_values(m.to_numpy(), s.to_numpy(), kind, best, xi, kappa, lo, hi, objective))
    return df.withColumn(name, acq(B.as_double(mu), B.as_double(sigma)))


def fit_surrogate(observed: DataFrame, features, target: str, **kw) -> FourierSurrogate:
    return fit_fourier(observed, features, [target], **kw)[0]


def score_with_surrogate(cands: DataFrame, model: FourierSurrogate, features, kind="ei", best=None, objective="maximize",
                         **acq_kw) -> DataFrame:
    """O5 — distributed mu / sigma / acquisition for every candidate (null where a feature is null)."""
    got = predict_fourier(cands, [model], features, [("mu", "sigma")])
    got = acquisition(got, "mu", "sigma", kind, 0.0 if best is None else best, objective=objective, **acq_kw)
    return got.withColumn("acquisition", F.when(F.col("mu").isNotNull(), F.col("acquisition")))


def suggest(observed: DataFrame, cands: DataFrame, features, target: str, n: int = 5, kind: str = "ei",
            objective: str = "maximize", strategy: str = "top_n", key: str = "grid_index", model_options: dict | None = None,
            model: FourierSurrogate | None = None, **acq_kw) -> DataFrame:
    """O5 — batch suggestion of ``n`` candidates; equal acquisitions go by the smaller ``key``.  ``model`` is a surrogate already
    fitted to these observations.

    * ``top_n``: the highest acquisitions.
    * ``kriging_believer``: take the best, add its predicted mean as an observation (a rank-one step), repeat.
    * ``doe_then_bo``: 3n candidates spread by maximin distance, of these the n highest acquisitions.
    * ``bo_then_doe``: the 3n highest acquisitions, of these n spread by maximin distance.
    """
    from tabwright.operators.reduce import maximin_selection
    feats = list(features)
    up = objective == "maximize"
    best = observed.agg((F.max if up else F.min)(B.as_double(target))).first()[0]
    model = model or fit_surrogate(observed, feats, target, **(model_options or {}))
    if strategy == "doe_then_bo":
        cands = cands.where(F.col(key).isin(maximin_selection(cands, key, feats, min(3 * n, cands.count()))))
    elif strategy not in ("top_n", "kriging_believer", "bo_then_doe"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy != "kriging_believer":
        top = score_with_surrogate(cands, model, feats, kind, best, objective, **acq_kw) \
            .orderBy(F.desc("acquisition"), key).limit(n if strategy != "bo_then_doe" else 3 * n)
        if strategy != "bo_then_doe":
            return top
        rows = top.collect()                                                            # 3n rows
        few = cands.sparkSession.createDataFrame(rows, top.schema) if rows else top
        return few.where(F.col(key).isin(maximin_selection(few, key, feats, min(n, len(rows))) if rows else []))
    picked = []
    for _ in range(n):
        top = score_with_surrogate(cands.where(~F.col(key).isin(picked)) if picked else cands, model, feats, kind, best,
                                   objective, **acq_kw).where(F.col("mu").isNotNull()).orderBy(F.desc("acquisition"), key).limit(1).first()
        if top is None:
            break
        picked.append(top[key])
        best = (max if up else min)(best, top["mu"])
        model = model.believe([float(top[c]) for c in feats], top["mu"])
    return cands.where(F.col(key).isin(picked))


def dirichlet_weights(n: int, objectives, seed: int = 42) -> list[dict]:
    """``n`` weight vectors, uniform on the simplex."""
    rng = np.random.RandomState(seed)
    return [dict(zip(objectives, map(float, rng.dirichlet(np.ones(len(objectives)))))) for _ in range(n)]


def parego_select(predicted: DataFrame, objectives: dict, bounds: dict, weights: list[dict], key: str, rho: float = 0.05) -> DataFrame:
    """O6 — one candidate per weight vector, in the order of ``weights``: the least max(w·f) + ρ Σ w·f among those not
    taken before (then the smallest ``key``), f being the column scaled to 0..1 by ``bounds`` and turned round if maximised.

    Every weight's best ``len(weights)`` candidates are enough to settle who was taken before; a task keeps that many of a
    weight while it reads, so its memory doesn't grow with its rows and nothing else is sorted or shuffled.  Candidates with a null objective are left out.
    ``objectives`` maps column → 'min' | 'max', ``bounds`` column → (low, high).  Returns weight_no (from 1), key, score."""
    scaled = []
    for c, d in objectives.items():
        lo, hi = bounds[c]
        f = (B.as_double(c) - F.lit(float(lo))) / F.lit(float(hi - lo) if hi - lo >= 1e-9 else 1.0)
        scaled.append((f if d == "min" else F.lit(1.0) - f).alias(f"f{len(scaled)}"))
    f = predicted.select(F.col(key).alias("key"), *scaled).dropna()
    scores = []
    for w in weights:
        terms = [F.lit(float(w[c])) * F.col(f"f{i}") for i, c in enumerate(objectives)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        scores.append((F.greatest(*terms) if len(terms) > 1 else terms[0]) + F.lit(float(rho)) * total)
    per = [f.select(F.lit(no).alias("weight_no"), "key", s.alias("score")).orderBy("score", "key").limit(len(weights)) for no, s in enumerate(scores)]
    rows = reduce(DataFrame.unionAll, per).orderBy("weight_no", "score", "key").collect() if per else []
    taken, out = set(), []
    for no in range(len(weights)):
        for r in rows:                                                                  # at most len(weights)² rows
            if r["weight_no"] == no and r["key"] not in taken:
                taken.add(r["key"])
                out.append((no + 1, r["key"], r["score"]))
                break
    schema = T.StructType([T.StructField("weight_no", T.IntegerType()), T.StructField(key, predicted.schema[key].dataType),
                           T.StructField("score", T.DoubleType())])
    return predicted.sparkSession.createDataFrame(out, schema)


def parego_suggest(observed: DataFrame, cands: DataFrame, features, objectives: dict, n: int = 5, rho: float = 0.05,
                   weights: list[dict] | None = None, key: str = "grid_index", seed: int = 42,
                   models: list[FourierSurrogate] | None = None, **model_options) -> DataFrame:
    """O6 — ``n`` candidates for several objectives (column → 'min' | 'max'): one surrogate per objective from one shared
    Gram matrix, Dirichlet weight vectors unless ``weights`` are given, predictions scaled by the observed range of each
    objective.  ``models`` are surrogates of the objectives already fitted to these observations.  Returns weight_no, key, score, the features and the predicted objectives."""
    from tabwright.session import cut_lineage
    names = list(objectives)
    models = models or fit_fourier(observed, features, names, **model_options)
    seen = observed.agg(*[f(B.as_double(c)).alias(k + c) for c in names for k, f in (("lo_", F.min), ("hi_", F.max))]).first()
    bounds = {c: (seen["lo_" + c], seen["hi_" + c]) for c in names}
    pred = cut_lineage(predict_fourier(cands.select(key, *features), models, features, [(c, None) for c in names]))
    chosen = parego_select(pred, objectives, bounds, weights or dirichlet_weights(n, names, seed), key, rho)
    return pred.join(F.broadcast(chosen), key).select("weight_no", key, "score", *features, *names)


def genetic_search(spark, space, predict, n_pop: int = 200, generations: int = 20, seed: int = 42,
                   mutation_rate: float = 0.1, eta: float = 20.0, direction: str = "maximize") -> DataFrame:
    """O4 — tournament selection, SBX crossover (η), Gaussian mutation (10 % of
    the range), elitism; the population is a DataFrame and each generation is
    one distributed scoring job.  Parents are paired by hash rank (a join on the
    rank), so no driver-side loop over individuals."""
    from tabwright.operators.search import random_candidates
    from tabwright.session import cut_lineage
    pop = random_candidates(spark, space, n_pop, seed).withColumnRenamed("grid_index", "ind")

    def score(df):
        out = df.withColumn("prediction", predict) if isinstance(predict, Column) else predict.transform(df)
        return out.withColumn("fitness", F.col("prediction") if direction == "maximize" else -F.col("prediction"))

    pop = score(pop)
    for g in range(generations):
        # tournament: each slot compares two hashed individuals
        ranked = pop.withColumn("_r", F.row_number().over(Window.orderBy(F.xxhash64("ind", F.lit(seed), F.lit(g)))) - 1)
        a = ranked.select(*[F.col(c).alias(f"a_{c}") for c in ranked.columns])
        b = ranked.select(*[F.col(c).alias(f"b_{c}") for c in ranked.columns])
        pairs = a.join(b, (F.col("a__r") + 1) % n_pop == F.col("b__r"))
        win = pairs.select(F.col("a__r").alias("slot"),
                           *[F.when(F.col("a_fitness") >= F.col("b_fitness"), F.col(f"a_{v.name}")).otherwise(F.col(f"b_{v.name}")).alias(v.name)
                             for v in space])
        # crossover partner: the next slot; SBX on numeric genes, then mutation
        w2 = win.select(*[F.col(c).alias(f"p_{c}") for c in win.columns])
        mate = win.join(w2, (F.col("slot") + 1) % n_pop == F.col("p_slot"))
        cols = []
        for j, v in enumerate(space):
            u = (F.pmod(F.xxhash64("slot", F.lit(seed), F.lit(g), F.lit(j)), F.lit(1 << 30)) / float(1 << 30))
            if v.kind == "categorical":
                cols.append(F.when(u < 0.5, F.col(v.name)).otherwise(F.col(f"p_{v.name}")).alias(v.name))
                continue
            beta = F.when(u <= 0.5, F.pow(2 * u, 1.0 / (eta + 1))).otherwise(F.pow(1 / (2 * (1 - u) + 1e-12), 1.0 / (eta + 1)))
            child = 0.5 * ((1 + beta) * F.col(v.name) + (1 - beta) * F.col(f"p_{v.name}"))
            m = (F.pmod(F.xxhash64("slot", F.lit(seed), F.lit(g), F.lit(100 + j)), F.lit(1 << 30)) / float(1 << 30))
            gauss = F.sqrt(-2 * F.log(m + 1e-12)) * F.cos(2 * math.pi * u)
            child = F.when(m < mutation_rate, child + gauss * 0.1 * (v.hi - v.lo)).otherwise(child)
            child = F.least(F.greatest(child, F.lit(v.lo)), F.lit(v.hi))
            if v.kind == "discrete":
                child = F.lit(v.lo) + F.round((child - v.lo) / v.step) * v.step
            cols.append(child.alias(v.name))
        kids = mate.select(F.col("slot").alias("ind"), *cols)
        kids = score(kids.withColumn("ind", F.col("ind") + (g + 1) * n_pop))
        # elitism: keep the best n_pop of parents ∪ children
        both = pop.unionByName(kids.select(*pop.columns))
        # the population is n_pop rows: materialise it each generation so the
        # plan does not grow with the number of generations
        pop = cut_lineage(both.orderBy(F.desc("fitness"), "ind").limit(n_pop))
    return pop.orderBy(F.desc("fitness"), "ind")
