import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import search as SR
from tabwright.operators import setops as U
from tabwright.operators import surrogate as G
from tabwright.plans import grid as PG
from tabwright.plans import linear_models as LM


def _lin(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    y = 1.5 * X[:, 0] - 2.0 * X[:, 1] + 0.5 * X[:, 2] + 3 + rng.normal(scale=0.1, size=n)
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double"), X, y


def test_pls_full_rank_equals_ols(spark):
    df, X, y = _lin(spark)
    m = LM.fit_pls(df, ["a", "b", "c"], "y", n_components=3)
    ols = np.linalg.lstsq(np.c_[X, np.ones(len(X))], y, rcond=None)[0]
    assert np.allclose(m.coef, ols[:3], atol=1e-8) and m.intercept == pytest.approx(ols[3], abs=1e-8)


def test_bayesian_ridge_close_to_ols(spark):
    df, X, y = _lin(spark)
    m = LM.fit_bayesian_ridge(df, ["a", "b", "c"], "y")
    assert np.allclose(m.coef, [1.5, -2.0, 0.5], atol=0.05)


def test_iterative_impute_recovers_relation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    rows = [(float(v), None if i % 5 == 0 else float(2 * v + 1)) for i, v in enumerate(x)]
    out = LM.iterative_impute(spark.createDataFrame(rows, "x double, z double"), ["x", "z"]).collect()
    for i, r in enumerate(out):
        if i % 5 == 0:
            assert r["z"] == pytest.approx(2 * x[i] + 1, abs=1e-6)


def test_acquisition_zero_sigma():
    v = G.acquisition_values([1.0, 2.0], [0.0, 1.0], "ei", best=1.5)
    assert v[0] == 0.0 and v[1] > 0
    with pytest.raises(ValueError):
        G.acquisition_values([1.0], [1.0], "ptr")


def test_gp_suggest_prefers_optimum(spark):
    obs = spark.createDataFrame([(float(x), float(-(x - 3) ** 2)) for x in np.linspace(0, 6, 12)], "x double, y double")
    sp = [SR.between("x", 0, 6)]
    cands = SR.grid_candidates(spark, sp, 61)
    top = G.suggest(obs, cands, ["x"], "y", n=3, kind="ucb", kappa=0.1).collect()
    assert all(abs(r["x"] - 3) < 0.6 for r in top)
    kb = G.suggest(obs, cands, ["x"], "y", n=2, kind="ei", strategy="kriging_believer").count()
    assert kb == 2


def test_genetic_search_improves(spark):
    sp = [SR.between("x", -5, 5), SR.between("y", -5, 5)]
    pred = -(F.col("x") ** 2 + F.col("y") ** 2)
    best = G.genetic_search(spark, sp, pred, n_pop=40, generations=6).first()
    assert best["prediction"] > -1.0


def test_pipeline_grid_labels():
    cfg = PG.PipelineGridConfig(scalers=["standard", "robust"], high_encoders=["ordinal", "target"],
                                generators=[("none", 1), ("none", 2), ("poly", 2)], estimators=["linear", "ridge"])
    grid = PG.pipeline_grid(cfg)
    assert len(grid) == PG.count_grid(cfg) == 2 * 2 * 2 * 2
    assert len({g["label"] for g in grid}) == len(grid)


def test_setops(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    b = spark.createDataFrame([(3, 3.0)], "k long, v double")
    assert U.append_tagged({"obs": a, "cand": b}).count() == 3
    rs = U.real_vs_shuffled(a.unionByName(b), "k", ["v"])
    assert rs.where("is_real = 0").agg(F.sort_array(F.collect_list("v"))).first()[0] == [1.0, 2.0, 3.0]
    w = U.poisson_weights(spark.range(2000).withColumnRenamed("id", "k"), "k", 0)
    assert abs(w.agg(F.avg("w")).first()[0] - 1.0) < 0.1


def test_group_lasso_drops_noise_group(spark):
    from tabwright.plans.selection import group_lasso
    df, X, y = _lin(spark)
    rng = np.random.default_rng(9)
    noise = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=300))], "id long, d double")
    m, kept = group_lasso(df.join(noise, "id"), ["a", "b", "c", "d"], "y", [["a", "b"], ["c"], ["d"]], alpha=0.05)
    assert "d" not in kept and "a" in kept


def test_adaboost_separates(spark):
    from pyspark.ml.feature import VectorAssembler
    from tabwright.plans.selection import adaboost_classifier
    rows = [(float(i % 10), float((i * 7) % 10), float((i % 10 > 4) ^ ((i * 7) % 10 > 4))) for i in range(200)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "a double, b double, label double"))
    m = adaboost_classifier(df, n_estimators=15, max_depth=2)
    acc = m.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9


def test_linear_tree_fits_piecewise_linear(spark):
    from tabwright.plans.linear_tree import LinearTreeRegressor
    rng = np.random.default_rng(4)
    x = rng.uniform(-5, 5, 400)
    z = rng.uniform(0, 1, 400)
    y = np.where(x < 0, 3 * x + 1, -2 * x + 1) + 0.01 * rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y)], "x double, z double, y double")
    m = LinearTreeRegressor(max_depth=2, alpha=1e-6).fit(df, ["x", "z"], "y")
    pred = m.transform(df)
    rmse = pred.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert rmse < 0.5 and m.n_leaves >= 2
    assert abs(m.nodes[0].threshold) < 0.5 and m.nodes[0].feature == 0


def test_linear_forest_and_boost(spark):
    from tabwright.plans.linear_tree import LinearBoostRegressor, LinearForestRegressor
    rng = np.random.default_rng(5)
    x = rng.uniform(-3, 3, 200)
    y = np.abs(x) * 2 + 0.05 * rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    f = LinearForestRegressor(n_trees=3, max_depth=2).fit(df, "id", ["x"], "y")
    b = LinearBoostRegressor(n_rounds=2, max_depth=1).fit(df, ["x"], "y")
    for m in (f, b):
        rmse = m.transform(df).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
        assert rmse < 0.6


def test_relieff_finds_signal(spark):
    from tabwright.plans.selection import relieff
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal()), float(rng.normal()), 0) for i in range(60)]
    rows = [(i, a + (3.0 if i % 2 else 0.0), b, i % 2) for i, a, b, _ in rows]
    df = spark.createDataFrame(rows, "id long, signal double, noise double, y int")
    out = relieff(df, "id", ["signal", "noise"], "y", n_neighbors=5, keep=1).collect()
    assert out[0]["feature"] == "signal" and out[0]["weight"] > out[1]["weight"]


def test_monotone_soft_constraint_reduces_violation(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    from tabwright.plans.monotone import MonotoneRegressor
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 300)
    y = x + np.sin(3 * x) * 2 + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    m = MonotoneRegressor(lambda w: DecisionTreeRegressor(labelCol="label", weightCol=w, maxDepth=5), {"x": 1}).fit(df, ["x"], "y")
    assert m.history[0] > 0.05 and min(m.history[1:]) < m.history[0]


def test_isotonic_is_the_closest_monotone_sequence():
    from tabwright.plans.monotone import isotonic
    assert isotonic([1, 3, 2, 4]).tolist() == [1, 2.5, 2.5, 4]
    assert isotonic([3, 2, 1]).tolist() == [2, 2, 2] and isotonic([3, 2, 1], False).tolist() == [3, 2, 1]
