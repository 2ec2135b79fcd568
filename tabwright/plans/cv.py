"""Cross-validated closed-form linear fits: every fold's training statistics
are the table totals minus that fold's sums, so all folds of all candidate
models are fitted from ONE grouped aggregate (no per-fold pass over the data).
The rows are read twice whatever the number of models, and the scores, a row per
model and fold, are written down: who reads them several times starts no new pass.
Used for fold-score tables (V1 for linear models, V12–V14 inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import cut_lineage


def fold_ols_scores(df: DataFrame, fold_col: str, features, target: str) -> DataFrame:
    """(model, split_id, score=rmse, r2, n_test) — one single-feature OLS per
    feature ("model"), trained on all folds but one, scored on the held-out fold."""
    feats = list(dict.fromkeys(features))
    rows = df.select(F.col(fold_col).alias("split_id"), F.col(target).cast("double").alias("y"),
                     *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(feats)])
    stats = {"n": lambda x, y: F.lit(1), "sx": lambda x, y: x, "sy": lambda x, y: y, "sxx": lambda x, y: x * x, "sxy": lambda x, y: x * y}

    def of(i, value):
        """``value`` in the rows that model i can use."""
        x, y = F.col(f"x{i}"), F.col("y")
        return F.when(x.isNotNull() & y.isNotNull(), value(x, y))

    def long(wide, names):
        """A row per model and fold from columns name_i."""
        return wide.select("split_id", F.inline(F.array(*[F.struct(F.lit(f).alias("model"), *[F.col(f"{k}_{i}").alias(k) for k in names])
                                                          for i, f in enumerate(feats)])))

    sums = rows.groupBy("split_id").agg(*[(F.count if k == "n" else F.sum)(of(i, v)).alias(f"{k}_{i}")
                                          for i in range(len(feats)) for k, v in stats.items()])
    s = cut_lineage(long(sums, stats).where("n > 0"))
    t = s.groupBy("model").agg(*[F.sum(c).alias(f"t_{c}") for c in stats])
    c = s.join(t, "model")
    n, sx, sy, sxx, sxy = [(F.col(f"t_{k}") - F.col(k)) for k in stats]
    den = n * sxx - sx * sx
    slope = F.when(den != 0, (n * sxy - sx * sy) / den).otherwise(F.lit(0.0))
    coef = c.select("model", "split_id", slope.alias("b"), ((sy - slope * sx) / n).alias("a"))
    # coefficient table: a row per fold → broadcast
    coef = coef.groupBy("split_id").agg(*[F.max(F.when(F.col("model") == f, F.col(k))).alias(f"{k}_{i}") for i, f in enumerate(feats) for k in "ab"])
    j = rows.join(F.broadcast(coef), "split_id")
    left = [lambda x, y, i=i: y - (F.col(f"a_{i}") + F.col(f"b_{i}") * x) for i in range(len(feats))]
    wide = j.groupBy("split_id").agg(*[e for i in range(len(feats)) for e in (
        F.sqrt(F.avg(of(i, left[i]) * of(i, left[i]))).alias(f"score_{i}"),
        (1 - F.sum(of(i, left[i]) * of(i, left[i])) / F.nullif(F.var_pop(of(i, lambda x, y: y)) * F.count(of(i, lambda x, y: y)), F.lit(0.0))).alias(f"r2_{i}"),
        F.count(of(i, lambda x, y: F.lit(1))).alias(f"n_test_{i}"))])
    return cut_lineage(long(wide, ["score", "r2", "n_test"]).where("n_test > 0").select("model", "split_id", "score", "r2", "n_test"))
