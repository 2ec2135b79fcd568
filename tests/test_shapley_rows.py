import numpy as np

from tabwright.operators import explain as X


def test_an_order_keeps_its_coalitions_in_one_row(spark):
    """n features: n + 1 predictions a sample, and no row is multiplied or shuffled after the background joined."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(50, 4)))], "id long, a double, b double, c double, y double")
    calls = []

    def pred(fr):
        from pyspark.sql import functions as F
        calls.append(fr)
        return fr.withColumn("prediction", F.col("a") * F.col("b") - F.col("c"))
    design = X._coalition_rows(df, "id", ["a", "b", "c"], df, 4, 42)
    scored = X._prefix_predictions(design, ["a", "b", "c"], pred)
    assert len(calls) == 4 and scored.count() == 200
    for r in scored.collect():
        assert sorted(r[f"_tw_r_{c}"] for c in "abc") == [0, 1, 2]
        x, z = ([r[f"_tw_{s}_{c}"] for c in "abc"] for s in "xz")
        assert r["_tw_p0"] == z[0] * z[1] - z[2] and r["_tw_p3"] == x[0] * x[1] - x[2]
        j = r["_tw_r_c"]
        assert abs(r[f"_tw_p{j + 1}"] - r[f"_tw_p{j}"] - (z[2] - x[2])) < 1e-12
    again = X.sage(df, "id", ["a", "b", "c"], "y", pred, n_samples=4)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "_tw_side" not in plan and again.count() == 3
