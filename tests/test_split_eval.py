import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import evaluate as EV
from tabwright.operators import split as S


def _ids(spark, n=100):
    return spark.createDataFrame([(i, i % 3, i % 7) for i in range(n)], "id long, y long, g long")


def test_kfold_partitions_keys(spark):
    df = _ids(spark)
    f = S.kfold(df, "id", 5, shuffle=True).collect()
    assert sorted(r["id"] for r in f) == list(range(100))
    sizes = np.bincount([r["fold"] for r in f])
    assert list(sizes) == [20] * 5


def test_walk_forward_a21(spark):
    df = _ids(spark)
    out = S.walk_forward(df, "id", "id", 5, gap=2).toPandas()
    prev_train = -1
    for s, part in out.groupby("split_id"):
        tr = part[part.role == "train"].id
        te = part[part.role == "test"].id
        assert tr.max() < te.min() and te.min() - tr.max() - 1 == 2
        assert len(tr) > prev_train
        prev_train = len(tr)
    with pytest.raises(ValueError):
        S.walk_forward(_ids(spark, 5), "id", "id", 5, gap=3)


def test_group_kfold_keeps_groups(spark):
    out = S.group_kfold(_ids(spark), "id", "g", 3).toPandas().merge(_ids(spark).toPandas(), on="id")
    assert (out.groupby("g").fold.nunique() == 1).all()


def test_stratified_balanced(spark):
    out = S.stratified_kfold(_ids(spark), "id", "y", 5).toPandas().merge(_ids(spark).toPandas(), on="id")
    counts = out.groupby(["fold", "y"]).size().unstack()
    assert counts.max().max() - counts.min().min() <= 1


def test_roc_auc_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 10))) for _ in range(200)]
    got = EV.roc_auc(spark.createDataFrame(rows, "y_true int, score double")).first()["roc_auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert got == pytest.approx(exp, abs=1e-12)


def test_regression_and_class_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y_true double, y_pred double")
    r = EV.regression_metrics(df).first()
    assert r["mae"] == pytest.approx(1 / 3) and r["r2"] == pytest.approx(1 - 0.5 / 2)
    c = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y_true int, y_pred int")
    m = EV.classification_metrics(c).first()
    assert m["accuracy"] == 0.75


def test_tibshirani_single_param_zero(spark):
    curves = spark.createDataFrame([(k, 0, 0.5 + 0.1 * k) for k in range(5)], "split_id int, param_id int, score double")
    assert EV.cv_bias_tibshirani(curves).first()["bias_estimate"] == 0.0
    two = curves.unionByName(spark.createDataFrame([(k, 1, 0.6 if k % 2 else 0.4) for k in range(5)],
                                                   "split_id int, param_id int, score double"))
    assert EV.cv_bias_tibshirani(two).first()["bias_estimate"] >= 0.0


def test_paired_test_and_bootstrap(spark):
    rows = [("a", k, 0.8 + 0.01 * k) for k in range(5)] + [("b", k, 0.7 + 0.02 * k) for k in range(5)]
    p = EV.paired_model_test(spark.createDataFrame(rows, "model string, split_id int, score double")).first()
    assert p["best_model"] == "a" and 0 <= p["p_value"] <= 1
    oof = spark.createDataFrame([(i, "c1", float(i), float(i) + 1) for i in range(30)],
                                "row_key long, config string, y_true double, y_pred double")
    assert EV.cv_bias_bootstrap(oof, n_bootstrap=20).first()["bias_estimate"] == 0.0


def test_group_kfold_is_the_plain_greedy_rule():
    rnd = random.Random(3)
    for _ in range(300):
        k, sizes = rnd.randint(2, 6), [rnd.choice([1, 1, 2, 3, 7, rnd.randint(1, 90)]) for _ in range(rnd.randint(6, 60))]
        sizes.sort(reverse=True)
        load, want = [0] * k, []
        for n in sizes:
            want.append(min(range(k), key=lambda i: (load[i], i)))
            load[want[-1]] += n
        got = []
        for n, first, runs in S._greedy_deal([(n, sizes.count(n)) for n in sorted(set(sizes), reverse=True)], k):
            assert first == len(got)
            for r in range(sizes.count(n)):
                start, folds = [x for x in runs if x[0] <= r][-1]
                got.append(folds[(r - start) % len(folds)])
        assert got == want


def test_group_kfold_has_one_rule_at_all_sizes(spark):
    """A group of 300 000 rows beside a million of one row has a fold for itself, as it has beside a few."""
    for n, hot in ((50, 20), (1_000_010, 300_000)):
        df = spark.range(n + hot).selectExpr("id", f"greatest(id - {hot - 1}, 0) AS g")
        got = {r.fold: r.n for r in S.group_kfold(df, "id", "g", 5).groupBy("fold").count().withColumnRenamed("count", "n").collect()}
        assert got[0] == hot and sum(got.values()) == n + hot and max(list(got.values())[1:]) <= hot


def test_leave_p_out_all_combinations(spark):
    df = spark.createDataFrame([(k * 3, f"g{k % 5}") for k in range(9)], "id long, g string")
    for p in (1, 2, 3, 4):
        for out, c, items in ((S.leave_p_out(df, "id", p), "id", [k * 3 for k in range(9)]), (S.leave_p_groups_out(df, "id", "g", p), "g", [f"g{k}" for k in range(5)])):
            assert out.columns == ["split_id", c]
            assert sorted(map(tuple, out.collect())) == sorted((i, x) for i, combo in enumerate(itertools.combinations(items, p)) for x in combo)
    assert S.leave_p_out(df.limit(1), "id", 2).count() == 0
    assert S.leave_p_out(spark.range(2100), "id", 2).count() == 2100 * 2099       # more than two million splits


@pytest.mark.parametrize("make", [lambda df: S.kfold(df, "id", 5), lambda df: S.stratified_kfold(df, "id", "y", 5)])
def test_fold_tables_are_not_sent_through_the_driver(spark, make):
    df = _ids(spark)
    joined = df.join(make(df).withColumnRenamed("fold", "part"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin [id" not in plan
    assert joined.count() == 100


def test_fold_scores_are_computed_once_and_right(spark):
    from tabwright.plans.cv import fold_ols_scores
    rnd = random.Random(5)
    rows = [(i % 4, rnd.random() if i % 7 else None, rnd.random(), rnd.random() if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, y double")
    out = fold_ols_scores(df, "fold", ["a", "b"], "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    got = {(r["model"], r["split_id"]): (r["score"], r["r2"], r["n_test"]) for r in out.collect()}
    want = {}
    for m, j in (("a", 1), ("b", 2)):
        ok = [(r[0], r[j], r[3]) for r in rows if r[j] is not None and r[3] is not None]
        for k in range(4):
            x, y = np.array([r[1:] for r in ok if r[0] != k]).T
            b, a = np.polyfit(x, y, 1)
            x, y = np.array([r[1:] for r in ok if r[0] == k]).T
            e = y - (a + b * x)
            want[m, k] = (np.sqrt((e * e).mean()), 1 - (e * e).sum() / ((y - y.mean()) ** 2).sum(), len(x))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
