"""Long paths, extreme values and late characters: what used to depend on a limit."""

import numpy as np

from tabwright.operators import evaluate as EV
from tabwright.operators import leakage as L
from tabwright.operators import molecules as M
from tabwright.plans.ordering import exact_quantiles
from tabwright.sources.io import read_csv


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901), (901, 902), (902, 900)], "id_a long, id_b long")
    ids = spark.createDataFrame([(i,) for i in [*range(n + 1), 900, 901, 902, 950]], "id long")
    got = {r.id: r.group for r in L.connected_components(edges, ids).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 900: 900, 901: 900, 902: 900, 950: 950}


def test_quantiles_with_extremes_beyond_fifty_thousand_rows(spark):
    rng = np.random.default_rng(3)
    for extreme in ([1e300], [float("inf")], [float("-inf"), -1e300, 5e-324, 1e16]):
        v = np.concatenate([rng.normal(size=60_000).round(4), extreme])
        got = exact_quantiles(spark.createDataFrame([(float(x),) for x in v], "x double"), ["x"], [0.0, 0.01, 0.25, 0.5, 0.999]).first()
        s = np.sort(v)
        for i, p in enumerate([0.0, 0.01, 0.25, 0.5, 0.999]):
            h = (len(s) - 1) * p
            a, b = s[int(np.floor(h))], s[int(np.ceil(h))]
            want = a if a == b else a + (h - np.floor(h)) * (b - a)
            assert got[f"q{i}"] == want or abs(got[f"q{i}"] - want) < 1e-9


def test_encoding_is_decided_on_all_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("a,b\n".encode() + b"".join(f"{i},x\n".encode() for i in range(3000)) + "3000,テスト\n".encode("shift_jis"))
    assert read_csv(spark, str(path)).where("a = 3000").first().b == "テスト"


def test_r2_of_a_constant_prediction_far_from_zero(spark):
    rng = np.random.default_rng(1)
    y = 1e9 + rng.random(5000)
    df = spark.createDataFrame([(float(v), float(y.mean())) for v in y], "y_true double, y_pred double")
    assert abs(EV.regression_metrics(df).first().r2) < 1e-3


def test_nearest_reference_sees_equal_sets_and_keeps_every_candidate(spark):
    c = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["x"]), (4, ["a", "b", "c"]), (5, [])], "k long, tokens array<string>")
    r = spark.createDataFrame([(9, ["a", "b"]), (8, ["q"])], "k long, tokens array<string>")
    got = {x.k: x.max_jaccard for x in M.max_similarity_to_reference(c, r, "k", 0.6).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: 2 / 3, 5: None}


def test_folds_fit_their_own_preprocessing_and_grids_check_names(spark):
    import pytest
    from pyspark.sql import functions as F
    from tabwright.plans.grid import PipelineGridConfig, grid_search
    from tabwright.plans.train import automl
    df = spark.range(400).select(F.col("id"), F.concat(F.lit("c"), F.col("id")).alias("name"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("y"),
                                 (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)) / 7.0).alias("x"))
    # a category per row, target encoded: only a fit that saw the held-out rows could score well
    cfg = PipelineGridConfig(high_encoders=["target"], low_encoders=["target"], selectors=["none", "kbest"], estimators=["linear"])
    rows = grid_search(df, "y", "id", cfg, n_splits=3).collect()
    assert len(rows) == 2 and all(r.status == "ok" and r["mean"] < 0.2 for r in rows)
    with pytest.raises(ValueError, match="selector"):
        grid_search(df, "y", "id", PipelineGridConfig(selectors=["no_such"]))
    res = automl(df.drop("name"), "y", "id", models=["linear", "no_such_model"], n_splits=3)
    assert res.best_model_key == "linear" and "no_such_model" in res.left_out


def test_searched_and_sized_models(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F
    from tabwright.plans import models
    df = spark.range(300).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 50.0 - 1).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 50.0 - 1).alias("b"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    reg = df.withColumn("label", 3 * F.col("a") - F.col("b"))
    for key in ("ridge_cv", "lasso_cv", "elasticnet_cv"):
        m = models.get_model(key, "regression", n_splits=2, alphas=[0.001, 10.0]).fit(reg)
        assert EV.regression_metrics(m.transform(reg), "label", "prediction").first().r2 > 0.99
    cls = df.withColumn("label", (F.col("a") > F.col("b")).cast("double"))
    p = models.get_model("mlp", "classification", hidden=[4], maxIter=60).fit(cls).transform(cls)
    assert p.where("label = prediction").count() > 270


def test_permutation_importance_and_curves(spark):
    from pyspark.sql import functions as F
    from tabwright.operators import explain as X
    df = spark.range(500).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("a"),
                                 F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("double").alias("b"))
    df = df.withColumn("y", 2 * F.col("a"))
    predict = lambda d: d.withColumn("prediction", 2 * F.col("a"))
    imp = {r.feature: r.importance_mean for r in X.permutation_importance(df, "id", ["a", "b"], "y", predict, 2).collect()}
    sd = float(np.std([r.y for r in df.collect()])) * 2 ** 0.5
    assert imp["b"] == 0 and 0.8 * sd < imp["a"] < 1.2 * sd
    cls = df.withColumn("c", (F.col("a") > 50).cast("double"))
    vote = lambda d: d.withColumn("prediction", (F.col("a") > 50).cast("double"))
    acc = {r.feature: r.importance_mean for r in X.permutation_importance(cls, "id", ["a", "b"], "c", vote, 2, metric="accuracy").collect()}
    assert acc["b"] == 0 and 0.35 < acc["a"] < 0.65
    ice = X.individual_expectations(df, "a", predict, "id", grid_points=5, sample=7).collect()
    assert len(ice) == 35 and all(abs(r.prediction - 2 * r.grid_value) < 1e-9 for r in ice)
    pd = X.partial_dependence(df, "a", predict, 5).orderBy("grid_id").collect()
    assert [r.mean_prediction for r in pd] == [2 * r.grid_value for r in pd]
