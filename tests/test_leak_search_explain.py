import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import explain as X
from tabwright.operators import leakage as L
from tabwright.operators import molecules as M
from tabwright.operators import search as SR


def test_leaky_feature_a15(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=50)
    rows = [(float(rng.normal()), float(v + rng.normal() * 0.001), float(v)) for v in y]
    out = L.check_feature_leakage(spark.createDataFrame(rows, "x_clean double, x_leaky double, y double"), "y").collect()
    assert out[0]["feature"] == "x_leaky" and out[0]["risk"] == "high"


def test_separator_a16(spark):
    rows = [(float(i % 5), 10.0 * (i < 25) + 0.001 * i, int(i < 25)) for i in range(50)]
    out = L.check_feature_leakage(spark.createDataFrame(rows, "x_normal double, x_separator double, label int"),
                                  "label").collect()
    assert [r["feature"] for r in out] == ["x_separator"]


def test_cosine_pairs_brute_force(spark):
    rnd = random.Random(1)
    base = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    vecs = []
    for i in range(60):
        b = base[i % 10]
        vecs.append((i, [x + rnd.gauss(0, 0.2) for x in b]))
    got = {(r["id_a"], r["id_b"]) for r in L.cosine_threshold_pairs(
        spark.createDataFrame(vecs, "id long, v array<double>"), "id", "v", 0.9).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    exp = {(a[0], b[0]) for a, b in itertools.combinations(vecs, 2) if cos(a[1], b[1]) >= 0.9}
    assert got == exp and exp


def test_jaccard_pairs_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(40):
        base = rnd.sample(words, 12) if i % 4 == 0 else docs[i - 1][1].split()[:11] + [rnd.choice(words)]
        docs.append((i, " ".join(base)))
    sets = M.token_sets(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in M.jaccard_threshold_pairs(sets, "id", 0.6).collect()}
    toks = {i: set(t.split()) for i, t in docs}
    rep = {}
    for i in sorted(toks):
        rep.setdefault(frozenset(toks[i]), i)
    reps = sorted(set(rep.values()))
    exp = {(a, b): len(toks[a] & toks[b]) / len(toks[a] | toks[b]) for a, b in itertools.combinations(reps, 2)
           if len(toks[a] & toks[b]) / len(toks[a] | toks[b]) >= 0.6}
    assert set(got) == set(exp)


def test_skyline_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, float(rnd.randint(0, 20)), float(rnd.randint(0, 20))) for i in range(80)]
    got = {r["id"] for r in SR.skyline_2d(spark.createDataFrame(pts, "id long, a double, b double"), "a", "b").collect()}
    exp = {p[0] for p in pts if not any(q[1] <= p[1] and q[2] <= p[2] and (q[1] < p[1] or q[2] < p[2]) for q in pts)}
    assert got == exp


def test_grid_and_lhs(spark):
    sp = [SR.between("x", 0, 1), SR.steps("k", 0, 4, 2), SR.one_of("c", ["u", "v"])]
    g = SR.grid_candidates(spark, sp, 5)
    assert g.count() == 5 * 3 * 2 == SR.grid_size(sp, 5)
    lhs = SR.lhs_candidates(spark, [SR.between("x", 0, 1)], 50).collect()
    strata = sorted(int(r["x"] * 50) for r in lhs)
    assert strata == list(range(50))


def test_linear_shap_and_sri(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    phi = X.linear_shap(df, {"a": 2.0, "b": -1.0}, keep=["id"])
    tot = phi.join(df, "id").select((F.col("phi_a") + F.col("phi_b") - (2 * F.col("a") - F.col("b"))).alias("d"))
    ds = [r["d"] for r in tot.collect()]
    assert max(ds) - min(ds) < 1e-9   # φ sums to prediction minus mean prediction
    summary, pairs = X.sri(phi, ["a", "b"])
    s = {r["feature"]: r for r in summary.collect()}
    assert s["a"]["independence"] >= 0 and s["b"]["independence"] >= 0
    assert pairs.count() == 1


def test_group_contribution(spark):
    counts = spark.createDataFrame([(1, 3, "g1", 2), (1, 3, "g2", 1), (2, 1, "g9", 1)],
                                   "mol_id long, n_atoms int, group_label string, n int")
    coef = spark.createDataFrame([("g1", 10.0, 5.0, 0.01, 0.001, 20.0, -5.0, -2.0, 1.0, 0.1, 0.0, 0.0),
                                  ("g2", 20.0, 1.0, 0.02, 0.002, 30.0, 2.0, 1.0, 2.0, 0.0, 0.0, 0.0)],
                                 "group_label string, dTb double, dTm double, dTc double, dPc double, dVc double, "
                                 "dHf double, dGf double, cp_a double, cp_b double, cp_c double, cp_d double")
    out = {r["mol_id"]: r for r in M.group_contribution_properties(counts, coef).collect()}
    assert out[1]["Tb"] == round(198.2 + 40.0, 2) and out[1]["n_groups"] == 3
    assert out[2]["Tb"] is None


def test_polymer_cap(spark):
    df = spark.createDataFrame([("*CC*",), ("[*:1]CC[*]",), ("CCO",)], "s string")
    out = [r["s_capped"] for r in M.polymer_rows(df, "s").collect()]
    assert out == ["[CH3]CC[CH3]", "[CH3]CC[CH3]", "CCO"]


def test_detect_leakage_grouped_points_a13(spark):
    rng = np.random.default_rng(42)
    centres = rng.normal(0, 10, size=(3, 5))
    rows = []
    for g in range(3):
        for i in range(10):
            x = centres[g] + rng.normal(0, 0.01, 5)
            rows.append((g * 10 + i, *map(float, x), float(g)))
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, x3 double, x4 double, g double")
    rep = L.detect_leakage(df, "id", ["x0", "x1", "x2", "x3", "x4"], threshold=0.95)
    assert rep["risk_level"] == "high" and rep["n_groups"] == 3
    grp = {r["id"]: r["group"] for r in rep["groups"].collect()}
    assert all(grp[g * 10 + i] == grp[g * 10] for g in range(3) for i in range(10))


def test_tree_rules_support_sums_to_one(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    rows = [(float(i % 10), float(i % 7), float((i % 10) * 2 + (i % 7))) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = DecisionTreeRegressor(labelCol="y", maxDepth=3).fit(data)
    rules = X.tree_rules(m, ["a", "b"], df).collect()
    assert abs(sum(r["support"] for r in rules) - 1.0) < 1e-9


def test_exact_knn_brute_force(spark):
    from tabwright.plans.knn import knn, knn_self
    rnd = random.Random(8)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(120)] + [(120 + i, [0.0, 0.0, 0.0]) for i in range(5)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = {}
    for r in knn_self(df, "id", "v", k=4, h0=2).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbor"]))

    def dist(a, b):
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    for i, v in pts:
        exp = sorted(((dist(v, w), j) for j, w in pts if j != i))[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in exp]
    q = spark.createDataFrame([(1000, [0.1, 0.0, 0.0])], "id long, v array<double>")
    near = knn(df, q, "id", "v", k=5).collect()
    assert sorted(r["neighbor"] for r in near) == [120, 121, 122, 123, 124]


def test_sampled_shap_efficiency_and_sage_null_feature(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(c), float(y)) for i, (a, b, c, y) in enumerate(rng.normal(size=(120, 4)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    bg = spark.createDataFrame([(0.5, -1.0, 2.0)], "a double, b double, c double")

    def pred(fr):   # non-linear in a, b; ignores c
        return fr.withColumn("prediction", F.col("a") * F.col("b") + F.col("a") * F.col("a") + 0.0 * F.col("c"))
    phi = X.sampled_shap(df, "id", ["a", "b", "c"], pred, background=bg, n_samples=6)
    d = phi.join(df, "id").select(
        (F.col("phi_a") + F.col("phi_b") + F.col("phi_c")
         - (F.col("a") * F.col("b") + F.col("a") ** 2 - (0.5 * -1.0 + 0.25))).alias("d"), "phi_c").collect()
    assert len(d) == 120
    assert max(abs(r["d"]) for r in d) < 1e-9      # φ adds up to f(x) − f(z) per sample
    assert max(abs(r["phi_c"]) for r in d) == 0.0  # unused feature
    s = {r["feature"]: r for r in X.sage(df, "id", ["a", "b", "c"], "y", pred, n_samples=4).collect()}
    assert s["c"]["sage_value"] == 0.0 and set(s) == {"a", "b", "c"}


def test_rbf_width_comes_from_all_rows(spark):
    """Mean squared distance of all pairs, equal rows included; a given gamma is used as it is."""
    import numpy as np
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(600, 3)) * [1, 5, 20], np.tile([[0.5, 9.0, -30.0]], (300, 1))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    _, gamma = L.rbf_threshold_pairs(df, "id", ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    d2 = ((z[:, None] - z[None]) ** 2).sum(-1)[np.triu_indices(len(z), 1)]
    assert gamma == pytest.approx(1 / (2 * d2.mean()), rel=1e-9)
    assert L.detect_leakage(df.where("id < 50"), "id", ["a", "b", "c"], gamma=2.0)["gamma"] == 2.0
    assert L.rbf_threshold_pairs(df.limit(1), "id", ["a", "b"])[1] == 0.5
