import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.plans.ordering import average_ranks, exact_quantiles, global_row_number, running_totals


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_global_row_number_partition_invariant(spark, parts):
    rnd = random.Random(0)
    rows = [(i, rnd.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(parts)
    out = global_row_number(df, ["v", "k"], "rn", num_partitions=parts).orderBy("rn").collect()
    exp = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [r["k"] for r in out] == [r[0] for r in exp]
    assert [r["rn"] for r in out] == list(range(1, 201))


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_exact_quantiles_match_numpy(spark, parts):
    rnd = random.Random(1)
    vals = [rnd.gauss(0, 1) for _ in range(101)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(parts)
    q = exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9], num_partitions=parts).first()
    clean = np.array([v for v in vals if v is not None and not math.isnan(v)])
    for i, p in enumerate([0.1, 0.25, 0.5, 0.9]):
        assert q[f"q{i}"] == pytest.approx(float(np.quantile(clean, p)), abs=1e-12)


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    r = sorted(x["x_rank"] for x in average_ranks(df, ["x"]).collect())
    assert r == [1.0, 2.5, 2.5, 4.0]


def test_running_totals(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "k long, w double").repartition(7)
    out = running_totals(df, ["k"], ["w"], ["c"], num_partitions=5).orderBy("k").collect()
    assert [r["c"] for r in out] == list(np.cumsum(np.arange(50.0)))


def test_empty_and_single(spark):
    # an empty column yields NULL quantiles
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, ["x"], [0.5]).first()["q0"] is None
    one = spark.createDataFrame([(5.0,)], "x double")
    assert exact_quantiles(one, ["x"], [0.25, 0.75]).first()["q0"] == 5.0
