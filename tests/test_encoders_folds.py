import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabwright.operators import prep as P
from tabwright.operators import split as S
from tabwright.plans import linear_models as LM


@pytest.mark.parametrize("drop,most", [("first", None), (None, None), ("first", 300), (None, 10)])
def test_many_levels_become_sparse_vectors(spark, drop, most):
    rnd = random.Random(2)
    rows = [(i, f"v{rnd.randint(0, 700) if i % 3 else 7}", rnd.choice("ab")) for i in range(2500)] + [(9000, None, None)]
    df = spark.createDataFrame(rows, "id long, v string, w string")
    model = P.OneHotEncoder(drop, most).fit(df, ["v", "w"])
    count = Counter(v for _, v, _ in rows if v)
    kept = sorted(count) if not most else sorted(sorted(count, key=lambda v: (-count[v], v))[:most - 1])
    skip = 1 if drop else 0
    at = {v: k - skip for k, v in enumerate(kept)} | ({v: len(kept) - skip for v in count if v not in kept} if most else {})
    probe = df.unionAll(spark.createDataFrame([(9001, "unseen", "a")], df.schema))
    for r in model.transform(probe).collect():
        v = {9001: "unseen", 9000: None}.get(r.id) or (rows[r.id][1] if r.id < 9000 else None)
        want = at.get(v, -1)
        assert r.v_onehot.size == len(kept) - skip + bool(most) and list(r.v_onehot.indices) == ([want] if want >= 0 else [])
        assert r.w_b == float(r.id < 9000 and rows[r.id][2] == "b")


def test_few_levels_stay_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    assert [tuple(r) for r in P.OneHotEncoder().fit(df, ["v"]).transform(df).orderBy("id").collect()] == [(1, 0.0), (2, 1.0), (3, 0.0)]


def test_cross_fitted_encoding_never_sees_its_own_fold(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "c", None]) if i else "only", rnd.gauss(1e6, 3.0), i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, y double, fold int")
    got = {r.id: r.c_enc for r in P.cross_fit_target_encode(df, ["c"], "y", "fold").collect()}
    for i, c, _, f in rows:
        rest = [y for _, _, y, g in rows if g != f]
        mine = [y for _, d, y, g in rows if g != f and d == c and c is not None]
        m, v = np.mean(rest), np.var(rest)
        want = m if not mine else (lambda n, vc: (n * v * np.mean(mine) + vc * m) / (n * v + vc))(len(mine), np.var(mine))
        assert abs(got[i] - want) < 1e-6, (i, c)


@pytest.mark.parametrize("k", [2, 5])
def test_stratified_groups(spark, k):
    rnd = random.Random(k)
    rows = [(i, g, lab) for i, (g, lab) in enumerate((g, rnd.choice(["x", "x", "x", "y", None])) for g in range(150) for _ in range(rnd.choice([1, 1, 2, 3, 9])))]
    df = spark.createDataFrame(rows, "id long, g long, lab string")
    got = {r.id: r.fold for r in S.stratified_group_kfold(df, "id", "g", "lab", k).collect()}
    assert len(got) == len(rows) and set(got.values()) == set(range(k))
    per_group, per_fold = defaultdict(set), defaultdict(Counter)
    for i, g, lab in rows:
        per_group[g].add(got[i])
        per_fold[got[i]][lab] += 1
    assert all(len(f) == 1 for f in per_group.values())
    total = Counter(lab for _, _, lab in rows)
    for c in per_fold.values():
        assert all(abs(c[lab] / c.total() - n / len(rows)) < 0.08 for lab, n in total.items())
        assert abs(c.total() - len(rows) / k) < 0.35 * len(rows) / k
    again = {r.id: r.fold for r in S.stratified_group_kfold(df.repartition(7), "id", "g", "lab", k).collect()}
    assert again == got


def plain_ard(x, y, n_iter=300, tol=1e-3, prune=1e4):
    """The same updates from the rows themselves."""
    xc, yc = x - x.mean(0), y - y.mean()
    p = x.shape[1]
    alpha, lam, keep, coef = 1 / (yc.var() + np.finfo(float).eps), np.ones(p), np.ones(p, bool), np.zeros(p)
    fit = lambda: np.linalg.inv(np.diag(lam[keep]) + alpha * xc[:, keep].T @ xc[:, keep])
    for _ in range(n_iter):
        cov, old = fit(), coef
        coef = np.zeros(p)
        coef[keep] = alpha * cov @ xc[:, keep].T @ yc
        g = 1 - lam[keep] * np.diag(cov)
        lam[keep] = (g + 2e-6) / (coef[keep] ** 2 + 2e-6)
        alpha = (len(y) - g.sum() + 2e-6) / (((yc - xc @ coef) ** 2).sum() + 2e-6)
        keep = lam < prune
        coef[~keep] = 0
        if abs(old - coef).sum() < tol:
            break
    coef = np.zeros(p)
    coef[keep] = alpha * fit() @ xc[:, keep].T @ yc
    return coef, y.mean() - x.mean(0) @ coef


def test_ard_prunes_what_does_not_matter(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = 3 * x[:, 0] - 2 * x[:, 3] + 5 + 0.1 * rng.normal(size=300)
    cols = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in [*cols, "y"]))
    model = LM.fit_ard(df, cols, "y")
    coef, intercept = plain_ard(x, y)
    assert np.allclose(model.coef, coef, atol=1e-6) and np.isclose(model.intercept, intercept, atol=1e-6)
    assert abs(model.coef[0] - 3) < 0.05 and (abs(model.coef[[1, 2, 4, 5]]) < 0.02).all()
