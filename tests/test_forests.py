import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabwright.plans import extra_trees as X
from tabwright.plans import models as M
from tabwright.plans import rgf as R


def data(spark, n=240, p=5, classes=0, seed=1, gaps=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).round(2)
    y = (x[:, 0] > 0) * 2.0 + x[:, 1] ** 2 + 0.1 * rng.normal(size=n)
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    if gaps:
        x[rng.random((n, p)) < 0.05] = np.nan
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, x array<double>, label double")
    return df.repartition(4).select("id", array_to_vector("x").alias("features"), "label"), x, y


def plain_tree(x, y, seed, tree, depth, wanted, classes, least):
    """The same tree grown on one array, nodes numbered breadth first; gives each row's label sums."""
    sums = lambda rows: X._label_sums(y[rows], classes).sum(0)
    out, queue, count = np.zeros((len(x), classes or 2)), [(0, np.arange(len(x)), 0)], 1
    while queue:
        node, rows, level = queue.pop(0)
        total, best = sums(rows), None
        pure = classes and (total > 0).sum() < 2
        if level < depth and len(rows) >= max(2, 2 * least) and not pure:
            with np.errstate(all="ignore"):
                lo = np.where(np.isnan(x[rows]).all(0), np.inf, np.nanmin(np.where(np.isnan(x[rows]), np.inf, x[rows]), 0))
                hi = np.nanmax(np.where(np.isnan(x[rows]), -np.inf, x[rows]), 0)
            for c, (j, cut) in enumerate(X.draw(seed, tree, node, lo, hi, wanted)):
                left = rows[x[rows, j] <= cut]
                g = X.gain(total, sums(left), classes, least)
                if g > 1e-12 and (best is None or (g, -c) > best[:2]):
                    best = (g, -c, j, cut)
        if best is None:
            out[rows] = total
            continue
        side = x[rows, best[2]] <= best[3]
        queue += [(count, rows[side], level + 1), (count + 1, rows[~side], level + 1)]
        count += 2
    return out


@pytest.mark.parametrize("classes,gaps,wanted", [(0, False, 1.0), (3, False, 1.0), (2, True, "sqrt"), (0, True, "sqrt")])
def test_extra_trees_against_one_array(spark, classes, gaps, wanted):
    df, x, y = data(spark, classes=classes, gaps=gaps)
    model = X.ExtraTrees("classification" if classes else "regression", n_trees=4, max_depth=4, min_leaf=3, max_features=wanted, seed=7).fit(df)
    got = {r.id: r for r in model.transform(df).collect()}
    m = x.shape[1] if wanted == 1.0 else int(x.shape[1] ** 0.5)
    sums = [plain_tree(x, y, 7, t, 4, m, classes, 3) for t in range(4)]
    want = np.mean([s / s.sum(1, keepdims=True) if classes else s[:, 1:] / s[:, :1] for s in sums], 0)
    for i, w in enumerate(want):
        if classes:
            assert np.allclose(got[i].probability.toArray(), w) and np.isclose(w[int(got[i].prediction)], w.max())
        else:
            assert np.isclose(got[i].prediction, w[0])


@pytest.mark.parametrize("l1", [0.0, 0.05])
def test_greedy_forest_solves_all_leaves(spark, l1):
    df, _, y = data(spark)
    model = R.GreedyForestRegressor(n_trees=4, max_leaves=8, l2=0.5, l1=l1, min_leaf=4).fit(df)
    rows = {r.id: r for r in model.leaves(df).withColumn("s", model.score()).collect()}
    phi = np.zeros((len(y), len(model.weights)))
    for i in range(len(y)):
        phi[i, rows[i]["_tw_ids"]] = 1
    w = np.linalg.solve(phi.T @ phi + 0.5 * np.eye(phi.shape[1]), phi.T @ (y - y.mean()))
    w = np.sign(w) * np.maximum(0, abs(w) - l1)
    assert np.allclose(model.weights, w) and (phi.sum(1) == 4).all()
    assert np.allclose([rows[i].s for i in range(len(y))], y.mean() + phi @ w)
    error = lambda m: m.transform(df).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    assert error(model) < 0.4 * y.var()


@pytest.mark.parametrize("key,task,options,least", [
    ("rgf", "classification", {"n_trees": 2, "max_leaves": 8}, 0.7), ("extra_trees", "classification", {"n_trees": 10, "max_features": 1.0}, 0.8),
    ("bagging", "classification", {"numTrees": 5}, 0.8), ("adaboost", "classification", {"n_estimators": 5, "max_depth": 2}, 0.6)])
def test_registered_classifiers(spark, key, task, options, least):
    df, _, _ = data(spark, classes=2)
    got = M.get_model(key, task, **options).fit(df).transform(df)
    assert got.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] >= least


@pytest.mark.parametrize("key,options,least", [("extra_trees", {"n_trees": 10, "max_features": 1.0}, 0.7), ("linear_tree", {"max_depth": 2}, 0.5),
                                               ("linear_forest", {"n_trees": 2, "max_depth": 2}, 0.5), ("linear_boost", {"n_rounds": 2}, 0.4),
                                               ("pls", {}, 0.2), ("bayesian_ridge", {}, 0.2)])
def test_registered_regressors(spark, key, options, least):
    df, _, y = data(spark)
    got = M.get_model(key, "regression", **options).fit(df).transform(df)
    assert set(df.columns) <= set(got.columns) and not [c for c in got.columns if c.startswith("_tw")]
    assert got.agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0] < (1 - least) * y.var()


def test_no_labelled_rows(spark):
    df, _, _ = data(spark)
    for key in ("extra_trees", "rgf"):
        with pytest.raises(ValueError):
            M.get_model(key, "regression").fit(df.limit(0))
