"""Evaluation (V4–V9, V12–V16, V19): metrics as aggregates over prediction
tables, model comparison over fold-score tables.

Prediction tables are ``(y_true, y_pred[, scores...][, group cols])``; fold-score
tables are ``(model, split_id, score)``.  Everything is one aggregate or a
grouped aggregate; exact ROC AUC uses average ranks from a running total over
*distinct* scores (skew-free), never a sort of all rows in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.stats import t_two_sided_p
from tabwright.plans.ordering import running_totals


def _d(c) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if isinstance(c, str) else c


def regression_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by=None) -> DataFrame:
    """V4 — rmse, mae, r2 (1 − SSE/SST; SST from the mean of y) per group."""
    e = _d(y_true) - _d(y_pred)
    y = F.when(e.isNotNull(), _d(y_true))                      # rows where both values are there; centred sums
    sst = F.var_pop(y) * F.count(e)
    aggs = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
            F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"), F.count(e).alias("n")]
    by = [by] if isinstance(by, str) else list(by or [])
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion_counts(df: DataFrame, y_true="y_true", y_pred="y_pred", by=()) -> DataFrame:
    """V7 — (true, pred, n) over the union of labels (strings)."""
    return (df.groupBy(*by, F.col(y_true).cast("string").alias("true_label"),
                       F.col(y_pred).cast("string").alias("pred_label"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """V7 — one row per true label, one column per label (pivot over the union)."""
    cc = confusion_counts(df, y_true, y_pred)
    labels = sorted({r[0] for r in cc.select("true_label").distinct().collect()} |
                    {r[0] for r in cc.select("pred_label").distinct().collect()})
    allt = df.sparkSession.createDataFrame([(x,) for x in labels], "true_label string")
    piv = cc.groupBy("true_label").pivot("pred_label", labels).agg(F.sum("n"))
    return allt.join(piv, "true_label", "left").select("true_label", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in labels])


def class_report(df: DataFrame, y_true="y_true", y_pred="y_pred", by=()) -> DataFrame:
    """V5 — per class: support, precision, recall, f1 (0 on zero division)."""
    by = list(by)
    cc = confusion_counts(df, y_true, y_pred, by)
    tp = cc.where(F.col("true_label") == F.col("pred_label")).groupBy(*by, F.col("true_label").alias("label")) \
        .agg(F.sum("n").alias("tp"))
    sup = cc.groupBy(*by, F.col("true_label").alias("label")).agg(F.sum("n").alias("support"))
    pp = cc.groupBy(*by, F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    j = sup.join(pp, by + ["label"], "full").join(tp, by + ["label"], "left").na.fill(0, ["support", "predicted", "tp"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.select(*by, "label", F.col("support").cast("long").alias("support"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"))


def classification_metrics(df: DataFrame, y_true="y_true", y_pred="y_pred", by=()) -> DataFrame:
    """V5 — accuracy and support-weighted precision / recall / f1."""
    by = list(by)
    rep = class_report(df, y_true, y_pred, by)
    w = rep.groupBy(*by).agg(
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))
    acc = df.groupBy(*by).agg(F.avg((F.col(y_true).cast("string") == F.col(y_pred).cast("string")).cast("double"))
                              .alias("accuracy"))
    return acc.join(w, by) if by else acc.crossJoin(w)


def roc_auc(df: DataFrame, y_true: str = "y_true", score: str = "score", positive=1) -> DataFrame:
    """V6 — exact binary ROC AUC with tied scores counted half.

    Distinct scores carry (pos, neg) counts; a running total of negatives over
    the score order (range-partitioned, distributed) gives, for each score, the
    negatives strictly below it.  AUC = Σ pos·(neg_below + neg/2) / (P·N)."""
    y = (F.col(y_true).cast("string") == F.lit(str(positive))).cast("double")
    s = df.select(_d(score).alias("_s"), y.alias("_y")).where(F.col("_s").isNotNull() & F.col(y_true).isNotNull())
    cells = s.groupBy("_s").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    run = running_totals(cells, ["_s"], ["neg"], ["_cum_neg"])
    return run.agg(
        (F.sum(F.col("pos") * (F.col("_cum_neg") - F.col("neg") + F.col("neg") / 2))
         / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"),
        F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"))


def roc_auc_ovr(df: DataFrame, y_true: str, score_cols: dict) -> DataFrame:
    """V6 — multi-class: prevalence-weighted one-vs-rest AUC; ``score_cols`` maps
    class label → probability column."""
    parts = []
    for label, col in score_cols.items():
        a = roc_auc(df, y_true, col, label).select(F.lit(str(label)).alias("label"), "roc_auc", "n_pos")
        parts.append(a)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg((F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos")).alias("roc_auc_weighted"))


def residual_analysis(df: DataFrame, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """V8 — MAPE (over y ≠ 0), max |r|, mean and std of residuals, share beyond
    ±2σ, and the Jarque–Bera normality statistic from skewness/kurtosis."""
    r = _d(y_true) - _d(y_pred)
    base = df.select(r.alias("r"), _d(y_true).alias("y"))
    st = base.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("n"),
                  F.max(F.abs("r")).alias("max_abs"),
                  F.avg(F.when(F.col("y") != 0, F.abs(F.col("r") / F.col("y")))).alias("mape"),
                  F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    j = base.crossJoin(st)
    flags = j.agg(F.avg((F.abs(F.col("r") - F.col("mean")) > 2 * F.col("std")).cast("double")).alias("share_beyond_2sd"))
    return st.crossJoin(flags).select(
        "n", "mean", "std", "max_abs", "mape", "share_beyond_2sd",
        (F.col("n") / 6.0 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4.0)).alias("jarque_bera"))


def leaderboard(scores: DataFrame, model="model", score="score", higher_is_better=True, fit_time=None) -> DataFrame:
    """V12 — per model mean, std (ddof 0), n folds, optional mean fit time, rank by mean."""
    aggs = [F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n_folds")]
    if fit_time:
        aggs.append(F.avg(fit_time).alias("fit_time"))
    g = scores.groupBy(model).agg(*aggs)
    order = F.desc("mean") if higher_is_better else F.asc("mean")
    # one row per model: the rank window runs over the small model table
    return g.withColumn("rank", F.row_number().over(Window.orderBy(order, F.asc(model))))


def paired_model_test(scores: DataFrame, model="model", split="split_id", score="score",
                      higher_is_better=True) -> DataFrame:
    """V13 — best model (by mean) vs each other model on the same splits: paired
    t, two-sided p, Cohen's d (mean diff / sd of diffs) and its size label
    (> .8 large, > .5 medium, else small).  Skipped when split sets differ or
    fewer than three splits."""
    lb = leaderboard(scores, model, score, higher_is_better)
    best = lb.where(F.col("rank") == 1).select(F.col(model).alias("_best"))
    b = scores.join(F.broadcast(best), F.col(model) == F.col("_best")).select(split, F.col(score).alias("_bs"), "_best")
    o = scores.select(F.col(model).alias("vs_model"), split, F.col(score).alias("_os"))
    j = o.join(b, split).where(F.col("vs_model") != F.col("_best"))
    n_best = scores.join(F.broadcast(best), F.col(model) == F.col("_best")).agg(F.count(F.lit(1)).alias("_nb"))
    d = F.col("_bs") - F.col("_os")
    g = j.groupBy("_best", "vs_model").agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"),
                                           F.stddev_samp(d).alias("sd_diff"))
    n_other = o.groupBy("vs_model").agg(F.count(F.lit(1)).alias("_no"))
    g = g.join(n_other, "vs_model").crossJoin(n_best).where((F.col("n") >= 3) & (F.col("_no") == F.col("_nb"))
                                                             & (F.col("n") == F.col("_nb")))
    t = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n")))
    dcoh = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / F.col("sd_diff")).otherwise(0.0)
    out = g.select(F.col("_best").alias("best_model"), "vs_model", "n", "mean_diff", t.alias("t_stat"),
                   dcoh.alias("cohens_d"))

    @F.pandas_udf(T.DoubleType())
    def pval(ts, ns):
        import pandas as pd
        return pd.Series([t_two_sided_p(float(a), float(b) - 1) if a == a and a is not None else float("nan")
                          for a, b in zip(ts, ns)])

    return out.select("*", pval("t_stat", F.col("n").cast("double")).alias("p_value"),
                      F.when(F.abs("cohens_d") > 0.8, "large").when(F.abs("cohens_d") > 0.5, "medium")
                      .otherwise("small").alias("effect"))


def score_stability(scores: DataFrame, model="model", score="score") -> DataFrame:
    """V19 — coefficient of variation std/|mean| (ddof 0) per model and its band:
    < 5 % stable, < 15 % moderate, else unstable."""
    g = scores.groupBy(model).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.abs("mean"))
    return g.select(model, "mean", "std", cv.alias("cv"),
                    F.when(cv < 0.05, "stable").when(cv < 0.15, "moderate").otherwise("unstable").alias("band"))


def cv_bias_tibshirani(curves: DataFrame, split="split_id", param="param_id", score="score",
                       higher_is_better=True) -> DataFrame:
    """V14 — Tibshirani bias: θ̂ = best mean over folds; per fold the own-best
    score minus the score of θ̂; bias = mean over folds; corrected = raw ∓ bias.
    A single parameter gives bias 0.  Ties go to the lowest parameter id."""
    means = curves.groupBy(param).agg(F.avg(score).alias("m"))
    order = F.desc("m") if higher_is_better else F.asc("m")
    # one row per parameter value: tiny window
    best = means.withColumn("_r", F.row_number().over(Window.orderBy(order, F.asc(param)))).where("_r = 1") \
        .select(F.col(param).alias("_best"), F.col("m").alias("raw_score"))
    own = curves.groupBy(split).agg((F.max(score) if higher_is_better else F.min(score)).alias("_own"))
    at_best = curves.join(F.broadcast(best), F.col(param) == F.col("_best")).select(split, F.col(score).alias("_atb"), "raw_score")
    term = (F.col("_own") - F.col("_atb")) if higher_is_better else (F.col("_atb") - F.col("_own"))
    per = own.join(at_best, split)
    n_par = curves.agg(F.countDistinct(param).alias("_np"))
    res = per.agg(F.avg(term).alias("_b"), F.first("raw_score").alias("raw_score"),
                  F.count(F.lit(1)).alias("n_folds")).crossJoin(n_par)
    bias = F.when(F.col("_np") < 2, F.lit(0.0)).otherwise(F.col("_b"))
    corrected = (F.col("raw_score") - bias) if higher_is_better else (F.col("raw_score") + bias)
    return res.select(F.lit("tibshirani").alias("method"), "raw_score", bias.alias("bias_estimate"),
                      corrected.alias("corrected_score"), "n_folds", F.col("_np").alias("n_params"))


def cv_bias_bootstrap(oof: DataFrame, key="row_key", config="config", y_true="y_true", y_pred="y_pred",
                      n_bootstrap: int = 200, metric: str = "rmse", seed: int = 42) -> DataFrame:
    """V15 — bootstrap bias correction (BBC): for each resample b, pick the
    configuration with the best weighted metric; bias = mean(best_b) − raw best;
    2.5/97.5 % percentiles of best_b minus bias.  Resampling is Poisson(1)
    weights from a hash of (key, b) — every (row, b) weight is computed where
    the row lives, and all resamples are one ``groupBy(b, config)``."""
    bs = F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))).alias("b")
    ex = oof.select(key, config, _d(y_true).alias("y"), _d(y_pred).alias("p"), bs)
    u = (F.abs(F.xxhash64(F.col(key), F.col("b"), F.lit(seed))) % 1000003) / 1000003.0
    # Poisson(1) by inverse CDF on a hashed uniform (P(k) = e^-1 / k!)
    cdf, terms = [], []
    acc, p = 0.0, math.exp(-1.0)
    for k in range(12):
        acc += p
        cdf.append(acc)
        p /= (k + 1)
    w = F.lit(12)
    for k in reversed(range(12)):
        w = F.when(u < F.lit(cdf[k]), F.lit(k)).otherwise(w)
    ex = ex.withColumn("w", w.cast("double"))
    hib = metric in ("r2", "accuracy")
    if metric == "rmse":
        m = F.sqrt(F.sum(F.col("w") * (F.col("y") - F.col("p")) ** 2) / F.sum("w"))
    elif metric == "mae":
        m = F.sum(F.col("w") * F.abs(F.col("y") - F.col("p"))) / F.sum("w")
    elif metric == "accuracy":
        m = F.sum(F.col("w") * (F.col("y") == F.col("p")).cast("double")) / F.sum("w")
    else:
        raise ValueError(f"unsupported metric {metric}")
    per = ex.groupBy("b", config).agg(m.alias("v"))
    best_b = per.groupBy("b").agg((F.max("v") if hib else F.min("v")).alias("best"))
    raw_all = oof.groupBy(config).agg(
        (F.sqrt(F.avg((_d(y_true) - _d(y_pred)) ** 2)) if metric == "rmse" else
         F.avg(F.abs(_d(y_true) - _d(y_pred))) if metric == "mae" else
         F.avg((_d(y_true) == _d(y_pred)).cast("double"))).alias("v"))
    raw = raw_all.agg((F.max("v") if hib else F.min("v")).alias("raw_score"), F.count(F.lit(1)).alias("_nc"))
    s = best_b.agg(F.avg("best").alias("_mb"), F.percentile("best", 0.025).alias("_lo"),
                   F.percentile("best", 0.975).alias("_hi"))
    out = raw.crossJoin(s)
    bias = F.when(F.col("_nc") < 2, F.lit(0.0)).otherwise(F.col("_mb") - F.col("raw_score"))
    return out.select(F.lit("bootstrap").alias("method"), "raw_score", bias.alias("bias_estimate"),
                      (F.col("raw_score") - bias).alias("corrected_score"),
                      (F.col("_lo") - bias).alias("ci_low"), (F.col("_hi") - bias).alias("ci_high"))


def evaluation_by_mode(preds: DataFrame, mode="mode", y_true="y_true", y_pred="y_pred") -> DataFrame:
    """V9 — regression metrics side by side for each evaluation mode (oof / full / holdout)."""
    return regression_metrics(preds, y_true, y_pred, by=[mode])


def bias_report(res: DataFrame) -> DataFrame:
    """V16 — one text line per bias result."""
    return res.select(F.format_string("%s: raw=%.4f bias=%.4f corrected=%.4f", "method", "raw_score",
                                      "bias_estimate", "corrected_score").alias("report"))
