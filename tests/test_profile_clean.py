import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import clean as C
from tabwright.operators import constrain as K
from tabwright.operators import profile as P


def test_column_stats_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,), (5.0,)], "x double")
    r = P.column_stats(df).first()
    assert r["n_total"] == 5 and r["n_null"] == 2 and r["n_unique"] == 3
    assert r["mean"] == 3.0 and r["p50"] == 3.0 and r["std"] == pytest.approx(2.0)
    assert r["kurt"] is None  # n = 3


def test_skew_kurt_bias_corrected(spark):
    rng = np.random.default_rng(42)
    x = rng.exponential(5, 60)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = P.column_stats(df).first()
    s = pd.Series(x)
    assert r["skew"] == pytest.approx(s.skew(), rel=1e-9)
    assert r["kurt"] == pytest.approx(s.kurtosis(), rel=1e-9)


def test_single_value_std_zero(spark):
    r = P.column_stats(spark.createDataFrame([(5.0,)], "x double")).first()
    assert r["std"] == 0.0 and r["skew"] is None


def test_correlation_needs_two_columns(spark):
    with pytest.raises(ValueError):
        P.correlation_matrix(spark.createDataFrame([(1.0,)], "x double"))


def test_detect_outliers_unknown_method(spark):
    with pytest.raises(ValueError):
        P.detect_outliers(spark.createDataFrame([(1.0,)], "x double"), method="nope")


def _fixture_a5(spark):
    rng = np.random.default_rng(0)
    x = list(rng.normal(0, 1, 95)) + [100, -100, 200, -200, 50]
    rows = [(i, float(x[i]), float(rng.normal()), 7.0) for i in range(100)]
    return spark.createDataFrame(rows, "row_key long, x double, y double, z double")


def test_clip_outliers_skips_constant(spark):
    df = _fixture_a5(spark)
    out, act = C.clip_outliers(df, 1.5, ["x", "z"])
    assert "z" not in act.details["bounds"]
    lo, hi = act.details["bounds"]["x"]
    mx = out.agg(F.max("x"), F.min("x")).first()
    assert mx[0] <= hi + 1e-12 and mx[1] >= lo - 1e-12
    with pytest.raises(ValueError):
        C.clip_outliers(df, 0)


def test_remove_duplicates_a6(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([1, 2, 3, 1, 2, 3, 4], [10, 20, 30, 10, 20, 30, 40]))],
                               "row_key long, a long, b long")
    first, _ = C.remove_duplicates(df, ["a", "b"], "first", key="row_key")
    assert sorted(r["row_key"] for r in first.collect()) == [0, 1, 2, 6]
    last, _ = C.remove_duplicates(df, ["a", "b"], "last", key="row_key")
    assert sorted(r["row_key"] for r in last.collect()) == [3, 4, 5, 6]
    none, _ = C.remove_duplicates(df, ["a", "b"], "none", key="row_key")
    assert [r["row_key"] for r in none.collect()] == [6]


def test_drop_rows_threshold_and_errors(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 3.0)], "a double, b double")
    out, _ = C.drop_rows_with_missing(df, 0.0)
    assert out.count() == 1
    out, _ = C.drop_rows_with_missing(df, 0.6)
    assert out.count() == 2
    with pytest.raises(ValueError):
        C.drop_rows_with_missing(df, 1.5)
    assert C.preview_missing_impact(df, 0.6).first()[0] == 1


def test_constant_and_all_null(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 5.0)], "ok int, all_nan double, c double")
    out, act = C.remove_constant_columns(df)
    assert out.columns == ["ok"]
    s = C.cleaning_summary(df).first()
    assert s["n_const_cols"] == 2 and s["n_all_missing_cols"] == 1


def test_constraints_a17(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.0), (2.0, 4.0, 1.0), (3.0, 3.0, 0.0), (4.0, 2.0, 1.0), (5.0, 1.0, 0.0)],
                               "A double, B double, C double")
    kept, rep = K.apply_constraints(df, [K.in_range("A", 2, 4), K.sum_near(["A", "B"], 6.0),
                                         K.linear({"A": 1, "B": -1}, 0, "le")])
    assert sorted(r["A"] for r in kept.collect()) == [2.0, 3.0]
    removed = {r["idx"]: r["removed"] for r in rep.collect()}
    assert removed == {1: 2, 2: 0, 3: 1}
    with pytest.raises(ValueError):
        K.linear({"A": 1}, 0, "bad")
    ex = K.count_rule(["A", "C"], "at_most_one", 0.5)
    assert df.where(ex.mask()).count() == 3


def test_validate_conflicts():
    res = K.validate_constraints([{"type": "range", "column": "A", "lo": 0, "hi": 1},
                                  {"type": "range", "column": "A", "lo": 2, "hi": 3}])
    assert len(res["conflicts"]) == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_kendall_matches_bruteforce(spark, parts):
    import itertools
    import random
    from tabwright.plans.kendall import kendall_tau_b
    rnd = random.Random(7)
    rows = [(float(rnd.randint(0, 12)), float(rnd.randint(0, 9))) for _ in range(150)]
    got = kendall_tau_b(spark.createDataFrame(rows, "x double, y double"), "x", "y", parts=parts)
    s = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        s += (a > c) - (a < c) if (b != d) else 0
        s = s
    conc = disc = 0
    n0 = len(rows) * (len(rows) - 1) // 2
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        sx, sy = (a > c) - (a < c), (b > d) - (b < d)
        conc += sx * sy
        tx += sx == 0
        ty += sy == 0
    exp = conc / ((n0 - tx) * (n0 - ty)) ** 0.5
    assert got == pytest.approx(exp, abs=1e-12)
