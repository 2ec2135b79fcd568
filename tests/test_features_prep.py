import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import features as FE
from tabwright.operators import prep as P


def test_group_agg_a10(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0), ("A", 3.0, 4.0), ("A", 5.0, 6.0), ("B", 2.0, 1.0),
                                ("B", 4.0, 3.0), ("C", 7.0, 8.0), ("C", 9.0, 10.0)], "category string, val1 double, val2 double")
    m = FE.GroupAggFeatures("category", ["val1"], ["mean"]).fit(df)
    out = m.transform(df)
    assert out.where("category = 'A'").first()["grp_category_val1_mean"] == 3.0
    new = spark.createDataFrame([("Z", 0.0, 0.0)], df.schema)
    assert m.transform(new).first()["grp_category_val1_mean"] == 0.0
    with pytest.raises(KeyError):
        FE.GroupAggFeatures("nope", ["val1"]).fit(df)


@pytest.mark.parametrize("bucket", [3 + 5, 1_000_000])
def test_lag_rolling_matches_pandas(spark, bucket):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "t long, g long, v double")
    out = FE.lag_rolling_features(df, ["v"], ["t"], ["g"], lags=[1, 2], windows=[3], funcs=["mean", "std"],
                                  bucket_rows=bucket).toPandas().sort_values("t")
    pdf = pd.DataFrame(rows, columns=["t", "g", "v"]).sort_values("t")
    for g, part in pdf.groupby("g"):
        exp_lag = part["v"].shift(1).fillna(0).values
        got = out[out.g == g]["v_lag1"].values
        assert np.allclose(got, exp_lag)
        exp_std = part["v"].rolling(3, min_periods=1).std().fillna(0).values
        assert np.allclose(out[out.g == g]["v_roll3_std"].values, exp_std)


def test_no_future_leak(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "t long, v double")
    out = FE.lag_rolling_features(df, ["v"], ["t"], lags=[1], windows=[2], funcs=["mean"]).orderBy("t").collect()
    for r in out:
        assert r["v_lag1"] <= r["v"]


def test_datetime_parts(spark):
    df = spark.sql("SELECT timestamp_ntz'2023-01-01 05:00:00' + make_interval(0,0,0,0,h,0,0) AS ts FROM "
                   "(SELECT explode(sequence(0, 23)) AS h)")
    out = FE.datetime_features(df, "ts", ["dayofweek", "hour", "is_weekend"]).collect()
    assert out[0]["dayofweek"] == 6 and out[0]["is_weekend"] == 1   # 2023-01-01 is a Sunday
    assert "hour_sin" in out[0].asDict()


def test_polynomial_order_and_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    r = FE.polynomial_features(df, ["a", "b"], 2, interaction_only=False, include_bias=True).first().asDict()
    assert list(r) == ["1", "a", "b", "a^2", "a b", "b^2"]
    assert r["a b"] == 6.0 and r["b^2"] == 9.0


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    st = P.Scaler("standard").fit(df, ["x", "c"]).transform(df).collect()
    assert [round(r["x"], 6) for r in st] == [round(v, 6) for v in (np.array([1, 2, 3]) - 2) / np.std([1, 2, 3])]
    assert all(r["c"] == 0.0 for r in st)
    mm = P.Scaler("minmax").fit(df, ["c"]).transform(df).collect()
    assert all(r["c"] == 0.0 for r in mm)


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string")
    oh = P.OneHotEncoder("first").fit(df, ["k"]).transform(df)
    assert oh.columns == ["k_b", "k_c"]
    od = P.fit_ordinal(df, ["k"]).transform(df).collect()
    assert [r["k"] for r in od] == [1.0, 0.0, 2.0, -1.0]
    new = spark.createDataFrame([("zz",)], "k string")
    assert P.fit_ordinal(df, ["k"]).transform(new).first()["k"] == -1.0


def test_power_transform_standardised(spark):
    rng = np.random.default_rng(0)
    x = rng.exponential(2.0, 200)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    out = P.PowerTransformer("yeo-johnson").fit(df, ["x"]).transform(df)
    m = out.agg(F.avg("x"), F.stddev_pop("x"), F.skewness("x")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1] - 1) < 1e-9 and abs(m[2]) < 0.3
    with pytest.raises(ValueError):
        P.PowerTransformer("box-cox").fit(spark.createDataFrame([(-1.0,)], "x double"), ["x"])


def test_target_encoder_shrinks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 12.0)], "c string, y double")
    enc = P.fit_target_encoder(df, ["c"], "y")
    vals = {r["c"]: r["c"] for r in df.collect()}
    out = {r["y"]: r["c"] for r in enc.transform(df).collect()}
    assert out[1.0] < 6.5 and out[10.0] > 6.5
    assert vals
