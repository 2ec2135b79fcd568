"""Model-based feature selection (E32–E35) and boosting (M8).

Group lasso works on sufficient statistics (XᵀX, Xᵀy from one aggregate; the
proximal-gradient iterations are p×p algebra on the driver).  Boruta and
AdaBoost fit Spark ML forests/trees; shadow features are hash-permuted copies
re-attached by a rank join, boosting weights are a column updated per round
with the lineage cut by a checkpoint.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.plans.linear_models import LinearExprModel, sufficient_stats
from tabwright.session import cut_lineage


def group_lasso(df: DataFrame, features, target: str, groups: list, alpha: float = 0.05, n_iter: int = 500,
                tol: float = 1e-8) -> tuple[LinearExprModel, list]:
    """E35 — min ½n⁻¹‖y − Xb‖² + α Σ_g sqrt(|g|)‖b_g‖ on standardised X by
    proximal gradient (block soft-thresholding).  Returns the model and the
    features of the non-zero groups; features in no group form singleton groups."""
    feats = list(features)
    n, mx, my, S, sxy, _ = sufficient_stats(df, feats, target)
    sd = np.sqrt(np.diag(S) / n)
    sd[sd == 0] = 1.0
    Sz = S / np.outer(sd, sd) / n
    bz = sxy / sd / n
    idx = {c: i for i, c in enumerate(feats)}
    gl = [[idx[c] for c in g if c in idx] for g in groups]
    covered = {i for g in gl for i in g}
    gl += [[i] for i in range(len(feats)) if i not in covered]
    L = max(np.linalg.eigvalsh(Sz).max(), 1e-12)
    b = np.zeros(len(feats))
    for _ in range(n_iter):
        grad = Sz @ b - bz
        z = b - grad / L
        nb = np.zeros_like(b)
        for g in gl:
            nrm = np.linalg.norm(z[g])
            thr = alpha * math.sqrt(len(g)) / L
            if nrm > thr:
                nb[g] = (1 - thr / nrm) * z[g]
        done = np.abs(nb - b).max() < tol
        b = nb
        if done:
            break
    coef = b / sd
    kept = [feats[i] for g in gl if np.linalg.norm(b[g]) > 0 for i in g]
    return LinearExprModel(feats, coef, float(my - mx @ coef)), kept


def boruta(df: DataFrame, key: str, features, target: str, task: str = "regression", n_rounds: int = 20,
           seed: int = 42, num_trees: int = 50) -> DataFrame:
    """E34 — each round adds a hash-permuted shadow copy of every feature, fits a
    Spark ML forest, and counts a hit when a feature's importance beats the best
    shadow.  Decision by a two-sided binomial test at 5 % (confirmed /
    rejected / tentative)."""
    from pyspark.ml.feature import VectorAssembler

    from tabwright.plans.models import get_model
    from tabwright.plans.ordering import global_row_number
    feats = list(features)
    base = global_row_number(df.select(key, target, *feats), [F.col(key)], "_tw_r")
    hits = {c: 0 for c in feats}
    for r in range(n_rounds):
        cur = base
        for j, c in enumerate(feats):
            sh = global_row_number(df.select(key, F.col(c).alias("_v")),
                                   [F.xxhash64(key, F.lit(seed), F.lit(r), F.lit(j)), F.col(key)], "_tw_r")
            cur = cur.join(sh.select("_tw_r", F.col("_v").alias(f"shadow_{c}")), "_tw_r")
        cols = feats + [f"shadow_{c}" for c in feats]
        data = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(
            cur.withColumn("label", F.col(target).cast("double")))
        m = get_model("random_forest", task, numTrees=num_trees, seed=seed + r).fit(data)
        imp = m.featureImportances.toArray()
        best_shadow = max(imp[len(feats):])
        for j, c in enumerate(feats):
            hits[c] += int(imp[j] > best_shadow)
    rows = []
    for c, h in hits.items():
        # two-sided binomial p-values with p = 0.5
        p_hi = sum(math.comb(n_rounds, k) for k in range(h, n_rounds + 1)) / 2 ** n_rounds
        p_lo = sum(math.comb(n_rounds, k) for k in range(0, h + 1)) / 2 ** n_rounds
        dec = "confirmed" if p_hi < 0.025 else ("rejected" if p_lo < 0.025 else "tentative")
        rows.append((c, h, dec))
    return df.sparkSession.createDataFrame(rows, "feature string, hits int, decision string")


def adaboost_classifier(data: DataFrame, n_estimators: int = 20, max_depth: int = 1, label: str = "label",
                        n_classes: int | None = None, seed: int = 42):
    """M8 — SAMME boosting of Spark ML decision trees through ``weightCol``.
    Each round: fit on the current weights, weighted error e, stage weight
    a = ln((1−e)/e) + ln(K−1), multiply weights of misclassified rows by e^a
    and renormalise.  The weight column is materialised each round."""
    from pyspark.ml.classification import DecisionTreeClassifier
    K = n_classes or int(data.agg(F.max(label)).first()[0]) + 1
    cur = cut_lineage(data.withColumn("_tw_w", F.lit(1.0)))
    stages = []
    for r in range(n_estimators):
        m = DecisionTreeClassifier(labelCol=label, maxDepth=max_depth, weightCol="_tw_w", seed=seed + r).fit(cur)
        p = m.transform(cur).withColumn("_miss", (F.col("prediction") != F.col(label)).cast("double"))
        s = p.agg(F.sum(F.col("_tw_w") * F.col("_miss")).alias("e"), F.sum("_tw_w").alias("t")).first()
        err = s["e"] / s["t"]
        if err >= 1 - 1.0 / K:
            break
        a = math.log((1 - err) / max(err, 1e-12)) + math.log(K - 1)
        stages.append((m, a))
        if err <= 0:
            break
        nw = p.select(*data.columns, (F.col("_tw_w") * F.exp(F.lit(a) * F.col("_miss"))).alias("_tw_w"))
        tot = nw.agg(F.sum("_tw_w")).first()[0]
        cur = cut_lineage(nw.withColumn("_tw_w", F.col("_tw_w") / F.lit(tot) * F.lit(float(s["t"]))))
    return AdaBoostModel(stages, K)


class AdaBoostModel:
    def __init__(self, stages, n_classes):
        self.stages, self.n_classes = stages, n_classes

    def transform(self, df: DataFrame) -> DataFrame:
        """Class with the largest Σ a_m · [h_m(x) = k]."""
        out = df
        for i, (m, _) in enumerate(self.stages):
            out = m.setPredictionCol(f"_p{i}").setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_prob{i}") \
                .transform(out).drop(f"_raw{i}", f"_prob{i}")
        votes = [sum((F.col(f"_p{i}") == F.lit(float(k))).cast("double") * F.lit(a)
                     for i, (_, a) in enumerate(self.stages)) for k in range(self.n_classes)]
        arr = F.array(*votes)
        best = F.array_position(arr, F.array_max(arr)) - 1
        return out.withColumn("prediction", best.cast("double")).drop(*[f"_p{i}" for i in range(len(self.stages))])


def relieff(df: DataFrame, key: str, features, label: str, n_neighbors: int = 100, keep: int = 10) -> DataFrame:
    """E33 — ReliefF feature weights with exact nearest hits and misses.

    Features are min-max scaled; for every class c the exact k nearest rows of
    class c are found for every row (:func:`tabwright.plans.knn.knn`, self
    excluded).  W_f = mean over rows of [ −mean_hits |Δf| + Σ_{c ≠ y}
    P(c)/(1 − P(y)) · mean_misses_c |Δf| ].  Returns (feature, weight, rank,
    selected) with the ``keep`` best selected."""
    from tabwright.plans.knn import knn
    feats = list(features)
    mm = df.agg(*[F.min(B.as_double(c)).alias(f"lo{i}") for i, c in enumerate(feats)],
                *[F.max(B.as_double(c)).alias(f"hi{i}") for i, c in enumerate(feats)]).first()
    scaled = [((B.as_double(c) - F.lit(mm[f"lo{i}"])) / F.lit((mm[f"hi{i}"] - mm[f"lo{i}"]) or 1.0)) for i, c in enumerate(feats)]
    base = df.select(F.col(key), F.col(label).cast("string").alias("_y"),
                     F.array(*[F.coalesce(s, F.lit(0.0)) for s in scaled]).alias("_x"))
    prior = {r["_y"]: r["n"] for r in base.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = float(sum(prior.values()))
    parts = []
    for c, nc in prior.items():
        refc = base.where(F.col("_y") == c)
        nb = knn(refc, base, key, "_x", k=min(n_neighbors, max(1, nc - 1)), exclude_self=True)
        q = base.select(F.col(key).alias("query"), F.col("_y").alias("_qy"), F.col("_x").alias("_qx"))
        r = refc.select(F.col(key).alias("neighbor"), F.col("_x").alias("_nx"))
        j = nb.join(q, "query").join(r, "neighbor")
        diffs = [F.abs(F.col("_qx")[i] - F.col("_nx")[i]) for i in range(len(feats))]
        per_q = j.groupBy("query", "_qy").agg(*[F.avg(d).alias(f"d{i}") for i, d in enumerate(diffs)])
        # hit (same class): −mean diff ; miss: prior-weighted mean diff
        p_y = F.create_map(*[x for kk, v in prior.items() for x in (F.lit(kk), F.lit(v / total))])[F.col("_qy")]
        w_miss = F.lit(nc / total) / (1 - p_y)
        sign = F.when(F.col("_qy") == F.lit(c), F.lit(-1.0)).otherwise(w_miss)
        parts.append(per_q.select("query", *[(sign * F.col(f"d{i}")).alias(f"d{i}") for i in range(len(feats))]))
    u = parts[0]
    for p_ in parts[1:]:
        u = u.unionByName(p_)
    row = u.groupBy("query").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(len(feats))]) \
        .agg(*[F.avg(f"d{i}").alias(f"d{i}") for i in range(len(feats))]).first()
    ranked = sorted([(f, float(row[f"d{i}"] or 0.0)) for i, f in enumerate(feats)], key=lambda t: -t[1])
    rows = [(f, w, i + 1, i < keep) for i, (f, w) in enumerate(ranked)]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double, rank int, selected boolean")
