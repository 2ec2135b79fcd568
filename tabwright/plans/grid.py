"""Pipeline grids (E26, E27, V17) and multi-set runs.

The grid is the product of small axis lists (driver-side specs); each
combination is evaluated with the same persisted data and fold table, and the
preprocessing fit is shared by all combinations with the same prefix."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PipelineGridConfig:
    numeric_imputers: list = field(default_factory=lambda: ["mean"])
    scalers: list = field(default_factory=lambda: ["standard"])
    cat_imputers: list = field(default_factory=lambda: ["most_frequent"])
    low_encoders: list = field(default_factory=lambda: ["onehot"])
    high_encoders: list = field(default_factory=lambda: ["ordinal"])
    binary_imputers: list = field(default_factory=lambda: ["most_frequent"])
    generators: list = field(default_factory=lambda: [("none", 1)])
    selectors: list = field(default_factory=lambda: ["none"])
    estimators: list = field(default_factory=lambda: ["linear"])
    max_combinations: int | None = None


AXES = ["numeric_imputer", "scaler", "cat_imputer", "low_encoder", "high_encoder", "binary_imputer",
        "generator", "selector", "estimator"]


def pipeline_grid(cfg: PipelineGridConfig) -> list[dict]:
    """E27 — every combination (generator "none" appears once, not per degree),
    cut to the first ``max_combinations`` if that is given; each has a label naming *every* axis."""
    gens = []
    for g in cfg.generators:
        if g[0] == "none":
            if ("none", 1) not in gens:
                gens.append(("none", 1))
        else:
            gens.append(tuple(g))
    axes = [cfg.numeric_imputers, cfg.scalers, cfg.cat_imputers, cfg.low_encoders, cfg.high_encoders,
            cfg.binary_imputers, gens, cfg.selectors, cfg.estimators]
    out = []
    for combo in itertools.product(*axes):
        d = dict(zip(AXES, combo))
        gen = d["generator"]
        d["label"] = "|".join([d["numeric_imputer"], d["scaler"], d["cat_imputer"], d["low_encoder"],
                               d["high_encoder"], d["binary_imputer"],
                               "none" if gen[0] == "none" else f"{gen[0]}{gen[1]}", d["selector"], d["estimator"]])
        out.append(d)
        if cfg.max_combinations is not None and len(out) >= cfg.max_combinations:
            break
    return out


def count_grid(cfg: PipelineGridConfig) -> int:
    """E27 — number of combinations without building them."""
    n_gen = len({("none", 1) if g[0] == "none" else tuple(g) for g in cfg.generators})
    total = 1
    for ax in (cfg.numeric_imputers, cfg.scalers, cfg.cat_imputers, cfg.low_encoders, cfg.high_encoders,
               cfg.binary_imputers, cfg.selectors, cfg.estimators):
        total *= len(ax)
    return total * n_gen if cfg.max_combinations is None else min(total * n_gen, cfg.max_combinations)


SELECTORS = ("none", "kbest", "mutual_info", "lasso", "random_forest")


def _select(x: DataFrame, feats: list, name: str, task: str, k: int) -> list:
    """The features that a selector keeps, fitted on the given (training) rows."""
    from tabwright.operators import reduce as R
    from tabwright.plans.train import assemble
    if name == "none" or not feats:
        return feats
    if name == "kbest":
        rows = R.select_k_best(R.f_scores(x, feats, "label", task), k=k).select("feature").collect()
        return [c for c in feats if c in {r[0] for r in rows}]
    if name == "mutual_info":
        mi = R.mutual_information(x, feats, "label", target_bins=10 if task == "regression" else None)
        rows = R.select_k_best(mi, k=k, score_col="mi").select("feature").collect()
        return [c for c in feats if c in {r[0] for r in rows}]
    data = assemble(x, feats).select("label", "features")
    if name == "lasso":
        from tabwright.plans.models import get_model
        model = get_model("lasso", "regression", label="label").fit(data)
        weights = dict(zip(feats, model.coefficients.toArray().tolist()))
    else:
        from tabwright.plans.models import get_model
        weights = dict(zip(feats, get_model("random_forest", task, label="label").fit(data).featureImportances.toArray().tolist()))
    kept = R.select_from_model(weights)
    return [c for c in feats if c in set(kept)] or feats


def _check(cfg: PipelineGridConfig, task: str) -> None:
    from tabwright.operators.autoprep import ENCODERS
    from tabwright.plans.models import REGISTRY
    known = {"selector": (cfg.selectors, SELECTORS), "encoder": ([*cfg.low_encoders, *cfg.high_encoders], ENCODERS),
             "estimator": (cfg.estimators, [k.split("/")[0] for k in REGISTRY if k.endswith("/" + task)]),
             "generator": ([g[0] for g in cfg.generators], ("none", "polynomial", "interaction"))}
    for what, (asked, names) in known.items():
        for x in asked:
            if x not in names:
                raise ValueError(f"unknown {what} {x!r}")


def grid_search(df: DataFrame, target: str, key: str, cfg: PipelineGridConfig, n_splits: int = 5, seed: int = 42,
                k_best: int = 10):
    """V17 — CV score of every pipeline, all its steps (imputers, scaler, encoders, generator, selector) fitted
    on each fold's training rows; failures are kept with a status; sorted by mean score.  Estimators that share
    all other steps share their fitted folds.  Unknown names raise."""
    from tabwright.operators.autoprep import AutoPreprocessor, PreprocessConfig
    from tabwright.operators.profile import infer_task
    from tabwright.plans.train import FOLD, choose_folds, cross_validate_fitted, with_label
    task = infer_task(df, target, "pipeline")
    _check(cfg, task)
    df = with_label(df, target, task)
    folds = choose_folds(df, key, task, n_splits, seed)
    keep = [key, target, "label"]
    groups: dict = {}
    for spec in pipeline_grid(cfg):
        groups.setdefault(tuple(spec[a] for a in AXES[:-1]), []).append(spec)
    rows = []
    for specs in groups.values():
        spec = specs[0]
        pc = PreprocessConfig(numeric_scaler=spec["scaler"], numeric_imputer=spec["numeric_imputer"],
                              categorical_imputer=spec["cat_imputer"], cat_low_encoder=spec["low_encoder"],
                              cat_high_encoder=spec["high_encoder"], binary_imputer=spec["binary_imputer"])

        def build(train, spec=spec, pc=pc):
            also = [FOLD] if FOLD in train.columns else []
            m = AutoPreprocessor(pc).fit(train, target, key=key, keep=[*keep, *also])

            def features(rows):
                x = m.transform(rows)
                feats = [c for c in x.columns if c not in {*keep, *also}]
                gen = spec["generator"]
                if gen[0] != "none" and feats:
                    x = x.select(*keep, *also, *[F.col(c) for c in feats], *[c.alias(n) for n, c in _poly_terms(feats, int(gen[1]), gen[0])])
                    feats = [c for c in x.columns if c not in {*keep, *also}]
                return x, feats
            x, feats = features(train)
            chosen = _select(x, feats, spec["selector"], task, k_best)
            return lambda rows: (features(rows)[0], chosen)

        try:
            scores, _, left_out = cross_validate_fitted(df, key, folds, [s["estimator"] for s in specs], task, build)
            got = {r["model"]: r for r in scores.groupBy("model").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
        except Exception as e:  # noqa: BLE001 — reported with its reason
            got, left_out = {}, {s["estimator"]: f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}" for s in specs}
        for s in specs:
            r = got.get(s["estimator"])
            rows.append((s["label"], float(r["m"]), float(r["s"] or 0.0), "ok") if r else
                        (s["label"], None, None, f"failed: {left_out.get(s['estimator'], 'no score')}"))
    out = df.sparkSession.createDataFrame(rows, "pipeline string, mean double, std double, status string")
    return out.orderBy(F.desc_nulls_last("mean"), "pipeline")


def _poly_terms(feats, degree, kind):
    from tabwright.operators.features import _term_name, polynomial_terms
    for t in polynomial_terms(feats, degree, interaction_only=(kind == "interaction")):
        if len(t) < 2:
            continue
        e = F.lit(1.0)
        for i in t:
            e = e * F.col(feats[i])
        yield _term_name(feats, t), e


def automl_over_sets(df: DataFrame, target: str, key: str, column_sets: dict, **kw) -> DataFrame:
    """V20 — run automl for every named column set; failures kept as NULL;
    sorted by score (best set first)."""
    from tabwright.plans.train import automl
    rows = []
    for name, cols in column_sets.items():
        try:
            res = automl(df.select(key, target, *cols), target, key, **kw)
            best = res.leaderboard.where("rank = 1").first()
            rows.append((name, res.best_model_key, float(best["mean"])))
        except Exception:  # noqa: BLE001
            rows.append((name, None, None))
    return df.sparkSession.createDataFrame(rows, "column_set string, best_model string, score double") \
        .orderBy(F.desc_nulls_last("score"))


def full_analysis(df: DataFrame, target: str, key: str, models=None, n_splits: int = 5, pca: bool = True,
                  importances: bool = True) -> dict:
    """V21 — profile → kinds → automl → evaluation → 2-component PCA →
    importances; each phase may fail on its own and becomes a warning."""
    from tabwright.operators.kinds import detect_column_types
    from tabwright.operators.profile import column_stats, table_summary
    from tabwright.operators.reduce import fit_pca
    from tabwright.plans.train import automl
    out, warnings = {}, []
    for name, fn in (("summary", lambda: table_summary(df)), ("stats", lambda: column_stats(df)),
                     ("kinds", lambda: detect_column_types(df, key=key))):
        try:
            out[name] = fn()
        except Exception as e:  # noqa: BLE001
            warnings.append(f"{name}: {e}")
    try:
        res = automl(df, target, key, models=models, n_splits=n_splits)
        out["automl"] = res
        from tabwright.operators import evaluate as EV
        out["evaluation"] = (EV.regression_metrics(res.oof) if res.task == "regression"
                             else EV.classification_metrics(res.oof))
        if pca:
            num = [c for c in df.columns if c not in (key, target) and dict(df.dtypes)[c] in ("double", "int", "bigint", "float")]
            if len(num) >= 2:
                out["pca"] = fit_pca(df, num, 2)
        if importances and hasattr(res.best_model, "featureImportances"):
            imp = res.best_model.featureImportances.toArray()
            out["importances"] = sorted(zip(res.feature_names, map(float, imp)), key=lambda t: -abs(t[1]))
        elif importances and hasattr(res.best_model, "coefficients"):
            co = res.best_model.coefficients.toArray()
            out["importances"] = sorted(zip(res.feature_names, map(float, co)), key=lambda t: -abs(t[1]))
    except Exception as e:  # noqa: BLE001
        warnings.append(f"automl: {e}")
    out["warnings"] = warnings
    return out


def suggest_experiments(observed: DataFrame, features, target: str, n: int = 5, constraints=(), bounds: dict | None = None,
                        method: str = "random_lhs", n_max: int = 10_000, kind: str = "ptr", target_range=None,
                        objective: str = "maximize", seed: int = 42) -> DataFrame:
    """O12 — space from the observed table → user bounds → candidates →
    constraints (one pass) → surrogate → top n.  The default target range
    for PTR is the observed quartiles of the target."""
    from tabwright.operators.constrain import apply_constraints
    from tabwright.operators.search import generate_candidates, space_from_table
    from tabwright.operators.surrogate import suggest
    from tabwright.plans.ordering import exact_quantiles
    space = space_from_table(observed, list(features))
    space = [replace(v, lo=bounds[v.name][0], hi=bounds[v.name][1]) if bounds and v.name in bounds else v for v in space]
    cands = generate_candidates(observed.sparkSession, space, method, n_max=n_max, seed=seed)
    if constraints:
        cands, _ = apply_constraints(cands, list(constraints))
    kw = {}
    if kind == "ptr":
        if target_range is None:
            q = exact_quantiles(observed, [target], [0.25, 0.75]).first()
            target_range = (q["q0"], q["q1"])
        kw = {"lo": target_range[0], "hi": target_range[1]}
    return suggest(observed, cands, list(features), target, n=n, kind=kind, objective=objective, **kw)
