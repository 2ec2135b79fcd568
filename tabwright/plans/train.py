"""Training drivers (V1–V3, V10, V11, V18, V20): cross-validation over fold
tables, automatic modelling, tuning, benchmarks and learning curves.

The data is assembled once (one projection), persisted, and every fold fit is
a distributed Spark ML fit on a filter of it; out-of-fold predictions are the
union of per-fold transforms.  Only scores (one row per model × fold) reach
the driver.
"""

from __future__ import annotations

import itertools
import random
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators import evaluate as EV
from tabwright.operators import split as S
from tabwright.operators.autoprep import AutoPreprocessor, PreprocessConfig
from tabwright.operators.clean import data_quality_check, drop_unlabelled
from tabwright.operators.kinds import detect_column_types
from tabwright.operators.profile import infer_task
from tabwright.plans.models import default_models, get_model


FOLD = "_tw_fold"


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def _score(pred: DataFrame, task: str, label: str = "label") -> float:
    if task == "regression":
        r = EV.regression_metrics(pred, label, "prediction").first()
        return float(r["r2"]) if r["r2"] is not None else float("nan")
    r = pred.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0]
    return float(r)


def cross_validate(data: DataFrame, key: str, folds: DataFrame, model_key: str, task: str,
                   label: str = "label", params: dict | None = None, return_oof: bool = False):
    """V1 — per split fit on the training rows and predict the held-out rows;
    all folds' predictions are scored in ONE grouped metric job (r2 for
    regression, accuracy for classification).  ``data`` holds key, label and
    ``features``; ``folds`` is (key, fold).  With ``return_oof`` the same
    held-out predictions are returned (no refit)."""
    j = data.join(folds, key)
    splits = [r[0] for r in folds.select("fold").distinct().where("fold >= 0").orderBy("fold").collect()]
    preds, fit_times = [], {}
    for k in splits:
        t0 = time.time()
        m = get_model(model_key, task, label=label, **(params or {})).fit(j.where(F.col("fold") != k))
        fit_times[int(k)] = time.time() - t0
        preds.append(m.transform(j.where(F.col("fold") == k)).select(
            key, F.col(label).cast("double").alias("y_true"), F.col("prediction").cast("double").alias("y_pred"),
            F.lit(int(k)).alias("split_id")))
    oof = preds[0]
    for p in preds[1:]:
        oof = oof.unionByName(p)
    if task == "regression":
        sc = EV.regression_metrics(oof, by=["split_id"]).select("split_id", F.col("r2").alias("score"))
    else:
        sc = oof.groupBy("split_id").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("score"))
    rows = [(model_key, int(r["split_id"]), float(r["score"]) if r["score"] is not None else float("nan"),
             fit_times[int(r["split_id"])]) for r in sc.collect()]
    scores = data.sparkSession.createDataFrame(rows, "model string, split_id int, score double, fit_time double")
    return (scores, oof) if return_oof else scores


@dataclass
class AutoMLResult:
    task: str
    leaderboard: DataFrame
    scores: DataFrame
    best_model_key: str
    best_model: object = None
    oof: DataFrame | None = None
    feature_names: list = field(default_factory=list)
    preprocess: object = None
    left_out: dict = field(default_factory=dict)      # model → why it has no score


def cross_validate_fitted(df: DataFrame, key: str, folds: DataFrame, models, task: str, build, time_budget: float | None = None):
    """Cross-validation whose preprocessing never sees held-out rows.

    ``df`` holds key, label and the raw columns; ``build(train)`` fits on a fold's
    training rows and returns a function that maps a frame to (frame, features).
    The fold number joins the rows once; each fold's transformed rows are kept
    while all models use them.  Returns the scores, each model's held-out
    predictions, and why a model has no score."""
    base = df.join(folds.select(key, F.col("fold").alias(FOLD)), key).persist(StorageLevel.MEMORY_AND_DISK)
    splits = [r[0] for r in base.where(F.col(FOLD) >= 0).select(FOLD).distinct().orderBy(FOLD).collect()]
    start, kept = time.time(), [base]
    preds, took, left_out = {m: [] for m in models}, {}, {}
    for k in splits:
        x, feats = build(base.where(F.col(FOLD) != k))(base)
        data = assemble(x, feats).select(key, FOLD, "label", "features").persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(data)
        for m in models:
            if m in left_out:
                continue
            if time_budget is not None and time.time() - start > time_budget:
                left_out[m] = "time budget used up"
                continue
            t0 = time.time()
            try:
                fitted = get_model(m, task, label="label").fit(data.where(F.col(FOLD) != k))
            except Exception as e:  # noqa: BLE001 — reported with its reason
                left_out[m] = f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"
                continue
            took[m, int(k)] = time.time() - t0
            preds[m].append(fitted.transform(data.where(F.col(FOLD) == k)).select(
                key, F.col("label").cast("double").alias("y_true"), F.col("prediction").cast("double").alias("y_pred"),
                F.lit(int(k)).alias("split_id")))
    oofs, rows = {}, []
    for m in models:
        if m in left_out:
            continue
        oof = preds[m][0]
        for q in preds[m][1:]:
            oof = oof.unionByName(q)
        oofs[m] = oof
        if task == "regression":
            sc = EV.regression_metrics(oof, by=["split_id"]).select("split_id", F.col("r2").alias("score"))
        else:
            sc = oof.groupBy("split_id").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("score"))
        rows += [(m, int(r["split_id"]), float("nan") if r["score"] is None else float(r["score"]), took[m, int(r["split_id"])])
                 for r in sc.collect()]
    for f in kept:
        f.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, split_id int, score double, fit_time double"), oofs, left_out


def with_label(df: DataFrame, target: str, task: str) -> DataFrame:
    """``label`` as a double; classes are numbered in the order of their names."""
    if task != "classification":
        return df.withColumn("label", F.col(target).cast("double"))
    from pyspark.ml.feature import StringIndexer
    y = df.withColumn("_tw_class", F.col(target).cast("string"))
    return StringIndexer(inputCol="_tw_class", outputCol="label", stringOrderType="alphabetAsc").fit(y).transform(y).drop("_tw_class")


def choose_folds(df: DataFrame, key: str, task: str, n_splits: int, seed: int, group: str | None = None) -> DataFrame:
    """Group folds when groups are given (as many as there are groups at most), class-balanced folds for a
    classification, plain ones otherwise."""
    if group is not None:
        n_splits, grouped = S.guard_group_folds(df, group, n_splits)
        if grouped:
            return S.group_kfold(df, key, group, n_splits)
    if task == "classification":
        return S.stratified_kfold(df, key, "label", n_splits, True, seed)
    return S.kfold(df.select(key), key, n_splits, shuffle=True, seed=seed)


def automl(df: DataFrame, target: str, key: str, models=None, n_splits: int = 5, time_budget: float = 600.0,
           config: PreprocessConfig | None = None, seed: int = 42, group: str | None = None) -> AutoMLResult:
    """V2 — quality check → drop unlabelled → detect kinds → infer task →
    k-fold CV with the preprocessing fitted per fold → leaderboard →
    refit the best on all rows → out-of-fold predictions of the best.  Models
    that fail or don't fit the time budget are named in ``left_out``."""
    data_quality_check(df, target)
    df = drop_unlabelled(df, target)
    task = infer_task(df, target, "automl")
    skip = {key, target, *([group] if group else [])}
    profile = detect_column_types(df, key=key, columns=[c for c in df.columns if c not in skip])
    df = with_label(df, target, task)
    keep = [key, target, "label"]

    def build(train):
        also = [c for c in (FOLD, group) if c and c in train.columns]
        prep = AutoPreprocessor(config).fit(train, target, profile=profile, key=key, keep=[*keep, *also])

        def apply(rows):
            x = prep.transform(rows)
            return x, [c for c in x.columns if c not in {*keep, *also}]
        apply.prep = prep
        return apply

    folds = choose_folds(df, key, task, n_splits, seed, group)
    scores, oofs, left_out = cross_validate_fitted(df, key, folds, list(models or default_models(task)), task, build, time_budget)
    if not oofs:
        raise RuntimeError(f"no model could be evaluated: {left_out}")
    lb = EV.leaderboard(scores, fit_time="fit_time")
    best = lb.where("rank = 1").first()["model"]
    apply = build(df)
    x, feats = apply(df)
    final = get_model(best, task, label="label").fit(assemble(x, feats).select(key, "label", "features"))
    return AutoMLResult(task, lb, scores, best, final, oofs[best], feats, apply.prep, left_out)


def tune(data: DataFrame, key: str, folds: DataFrame, model_key: str, task: str, space: dict,
         method: str = "grid", n_iter: int = 10, seed: int = 42, label: str = "label") -> DataFrame:
    """V3 — grid / random search (bayes/optuna fall back to random on the same
    space); halving-grid / halving-random keep the best third each round on a
    growing hash-ordered share of the rows.  Returns (params, mean, std, rank)."""
    combos = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    if method in ("random", "bayes", "optuna", "halving_random"):
        rnd = random.Random(seed)
        combos = rnd.sample(combos, min(n_iter, len(combos)))
    rounds = [1.0]
    if method.startswith("halving"):
        rounds = [1 / 3, 2 / 3, 1.0]
    alive = combos
    spark = data.sparkSession
    for frac in rounds:
        sub = data if frac >= 1.0 else data.where(
            (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) < int(frac * 1000)))
        res = []
        for i, p in enumerate(alive):
            sc = cross_validate(sub, key, folds, model_key, task, label, params=p)
            agg = sc.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
            res.append((str(p), float(agg["m"]), float(agg["s"] or 0.0), p))
        res.sort(key=lambda r: -r[1])
        if frac < 1.0:
            alive = [r[3] for r in res[:max(1, len(res) // 3)]]
    rows = [(r[0], r[1], r[2], i + 1) for i, r in enumerate(res)]
    return spark.createDataFrame(rows, "params string, mean double, std double, rank int")


def benchmark_models(train: DataFrame, test: DataFrame, models, task: str, label: str = "label") -> DataFrame:
    """V10 — fit each model on train, score on test (failures skipped), best first."""
    rows = []
    for mk in models:
        try:
            m = get_model(mk, task, label=label).fit(train)
            p = m.transform(test)
            if task == "regression":
                r = EV.regression_metrics(p, label, "prediction").first()
                rows.append((mk, float(r["r2"]), float(r["rmse"]), float(r["mae"])))
            else:
                r = EV.classification_metrics(p, label, "prediction").first()
                rows.append((mk, float(r["f1_weighted"]), float(r["accuracy"]), float("nan")))
        except Exception:  # noqa: BLE001
            continue
    rows.sort(key=lambda r: -r[1])
    return train.sparkSession.createDataFrame(rows, "model string, score double, metric_2 double, metric_3 double")


def learning_curve(data: DataFrame, key: str, model_key: str, task: str, n_splits: int = 5,
                   sizes=(0.1, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 1.0), seed: int = 42, label: str = "label") -> DataFrame:
    """V11 — CV score mean/std at growing nested shares of the rows (hash-order
    prefixes, so each smaller set is contained in the larger)."""
    rows = []
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100000)) / 100000.0
    for s in sizes:
        sub = data.where(h < s)
        folds = S.kfold(sub.select(key), key, n_splits, True, seed)
        sc = cross_validate(sub, key, folds, model_key, task, label)
        a = sc.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
        rows.append((float(s), float(a["m"]), float(a["s"] or 0.0)))
    return data.sparkSession.createDataFrame(rows, "train_share double, mean double, std double")


def batch_predict(model, df: DataFrame, target: str, n_classes: int | None = None) -> DataFrame:
    """V18 — predictions (and class probabilities) for new rows."""
    p = model.transform(df).withColumnRenamed("prediction", f"_predicted_{target}")
    if n_classes and "probability" in p.columns:
        arr = vector_to_array(F.col("probability"))
        p = p.select("*", *[arr[i].alias(f"_proba_class_{i}") for i in range(n_classes)]).drop("probability")
    return p
