import random

import pytest
from pyspark.sql import functions as F

from tabwright.operators import explain as X


def rows(spark, distinct):
    rnd = random.Random(distinct)
    kinds = [(float(rnd.randrange(9)), rnd.random(), None if rnd.random() < 0.1 else rnd.random()) for _ in range(distinct)]
    some = [(rnd.randrange(150), None if rnd.random() < 0.05 else rnd.randrange(4), *rnd.choice(kinds[:1] * 20 + kinds)) for _ in range(400)]
    return spark.createDataFrame(some, "k long, part int, a double, b double, c double").repartition(3)


def pred(frame):
    return frame.withColumn("prediction", F.col("a") * F.col("b") + F.coalesce("c", F.lit(2.0)) * F.col("a"))


def values(frame):
    return sorted(([(x is None, round(x, 9) if x is not None else 0) for x in r] for r in frame.collect()))


@pytest.mark.parametrize("distinct", [1, 7, 300])
def test_few_distinct_background_rows_give_what_all_rows_give(spark, monkeypatch, distinct):
    df = rows(spark, distinct)
    few = X.sampled_shap(df, ["k", "part"], ["a", "b", "c"], pred, n_samples=5)
    sage = X.sage(df.withColumn("y", F.col("a") + 1), ["k", "part"], ["a", "b", "c"], "y", pred, n_samples=3)
    got, got_sage = values(few), values(sage.drop("feature"))
    monkeypatch.setattr(X, "_TUPLES", -1)
    assert got == values(X.sampled_shap(df, ["k", "part"], ["a", "b", "c"], pred, n_samples=5)) and len(got) == 400
    assert got_sage == values(X.sage(df.withColumn("y", F.col("a") + 1), ["k", "part"], ["a", "b", "c"], "y", pred, n_samples=3).drop("feature"))


@pytest.mark.parametrize("most", [100, 1 << 17])
def test_samples_are_not_shuffled(spark, monkeypatch, most):
    """The rows are dealt by key once; their samples meet the background and are folded where they are."""
    monkeypatch.setattr(X, "_TASK_ROWS", most, raising=False)
    out = X.sampled_shap(rows(spark, 30), ["k", "part"], ["a", "b", "c"], pred, n_samples=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("BroadcastExchange")] + plan[plan.index("Window"):] if "BroadcastExchange" in plan else plan
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning(k") == 1 and top.count("hashpartitioning(_tw_bi") == 0


def test_the_empty_table_gives_no_rows(spark):
    assert X.sampled_shap(rows(spark, 3).where("k < 0"), ["k", "part"], ["a", "b", "c"], pred, n_samples=2).count() == 0
