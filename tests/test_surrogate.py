"""Surrogate on random Fourier features and multi-objective suggestion against plain numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import search as SR
from tabwright.operators import surrogate as G
from tabwright.plans import fourier as FO


def wave(x):
    return np.sin(x[:, 0]) + 0.5 * x[:, 1]


def observations(spark, n=300, partitions=7):
    rng = np.random.default_rng(3)
    X = rng.uniform(-2, 2, (n, 2))
    y, z = wave(X) + rng.normal(0, 0.05, n), X[:, 0] ** 2
    rows = [(*map(float, X[i]), float(y[i]), float(z[i])) for i in range(n)] + [(None, 1.0, 2.0, 3.0), (1.0, 1.0, None, 3.0), (1.0, float("nan"), 1.0, 1.0)]
    return spark.createDataFrame(rows, "a double, b double, y double, z double").repartition(partitions), X, y, z


def test_posterior_equals_a_plain_solve(spark):
    df, X, y, z = observations(spark)
    models = FO.fit_fourier(df, ["a", "b"], ["y", "z"], n_features=40)
    grid = np.array(list(itertools.product(np.linspace(-2, 2, 5), repeat=2)))
    for m, t in zip(models, (y, z)):
        Z = np.hstack([m.basis(X, m.length), np.ones((len(X), 1))])
        A = Z.T @ Z / m.noise + np.eye(41)
        w = np.linalg.solve(A, Z.T @ ((t - t.mean()) / t.std()) / m.noise)
        z0 = np.hstack([m.basis(grid, m.length), np.ones((len(grid), 1))])
        mu, sigma = m.predict(grid)
        assert np.allclose(mu, z0 @ w * t.std() + t.mean(), rtol=1e-6, atol=1e-6)
        assert np.allclose(sigma, np.sqrt(np.einsum("ij,ij->i", z0, np.linalg.solve(A, z0.T).T)) * t.std(), rtol=1e-5)


def test_evidence_equals_the_gaussian_density(spark):
    df, X, y, _ = observations(spark, n=60)
    m = FO.fit_fourier(df, ["a", "b"], ["y"], n_features=20, scales=(0.5,))[0]
    Z = np.hstack([m.basis(X, m.length), np.ones((len(X), 1))])
    t = (y - y.mean()) / y.std()

    def density(noise):
        K = Z @ Z.T + noise * np.eye(len(t))
        return -0.5 * (t @ np.linalg.solve(K, t) + np.linalg.slogdet(K)[1] + len(t) * np.log(2 * np.pi))
    values, V = np.linalg.eigh(Z.T @ Z)
    for noise in (1e-3, 0.1, 1.0):
        assert FO._evidence(values, V.T @ (Z.T @ t), t @ t, len(t), noise) == pytest.approx(density(noise), rel=1e-6)
    assert m.noise == max(FO.NOISES, key=density)


def test_surrogate_learns_and_does_not_depend_on_partitions(spark):
    df, X, y, _ = observations(spark, n=3000)
    a, b = (FO.fit_fourier(df.repartition(k), ["a", "b"], ["y"])[0] for k in (1, 9))
    grid = np.array(list(itertools.product(np.linspace(-1.8, 1.8, 7), repeat=2)))
    assert np.abs(a.predict(grid)[0] - wave(grid)).max() < 0.1
    assert np.allclose(a.predict(grid)[0], b.predict(grid)[0], atol=1e-6)


def test_believed_observation_equals_a_refit(spark):
    df, X, y, _ = observations(spark, n=50)
    m = FO.fit_fourier(df, ["a", "b"], ["y"], n_features=30, length_scale=1.0, noise=0.01)[0]
    more = m.believe([0.5, 0.5], 4.0)
    Z = np.hstack([m.basis(np.vstack([X, [[0.5, 0.5]]]), 1.0), np.ones((51, 1))])
    t = (np.append(y, 4.0) - y.mean()) / y.std()
    w = np.linalg.solve(Z.T @ Z / 0.01 + np.eye(31), Z.T @ t / 0.01)
    assert np.allclose(more.weights, w, rtol=1e-6, atol=1e-8)
    assert more.predict([[0.5, 0.5]])[1][0] < m.predict([[0.5, 0.5]])[1][0]


@pytest.mark.parametrize("strategy", ["top_n", "kriging_believer", "doe_then_bo", "bo_then_doe"])
def test_strategies(spark, strategy):
    df, *_ = observations(spark)
    cands = SR.grid_candidates(spark, [SR.between("a", -2, 2), SR.between("b", -2, 2)], 9).limit(81)
    got = G.suggest(df, cands, ["a", "b"], "y", n=4, kind="ucb", kappa=0.5, strategy=strategy).collect()
    assert len({r["grid_index"] for r in got}) == 4
    if strategy in ("top_n", "bo_then_doe", "kriging_believer"):
        assert all(r["a"] > 0 and r["b"] > 0 for r in got)
    with pytest.raises(ValueError):
        G.suggest(df, cands, ["a", "b"], "y", strategy="none")


def test_null_candidates_and_empty_tables(spark):
    df, *_ = observations(spark)
    cands = spark.createDataFrame([(1, None, 1.0), (2, 1.0, 1.0), (3, float("nan"), 0.0)], "grid_index long, a double, b double")
    scored = {r["grid_index"]: r for r in G.score_with_surrogate(cands, G.fit_surrogate(df, ["a", "b"], "y"), ["a", "b"]).collect()}
    assert scored[1]["mu"] is None and scored[3]["acquisition"] is None and scored[2]["mu"] is not None
    assert G.suggest(df, cands, ["a", "b"], "y", n=1).first()["grid_index"] == 2
    assert [r["grid_index"] for r in G.suggest(df, cands, ["a", "b"], "y", n=3, strategy="kriging_believer").collect()] == [2]
    assert G.suggest(df, cands.limit(0), ["a", "b"], "y").count() == 0
    with pytest.raises(ValueError):
        G.fit_surrogate(df.limit(0), ["a", "b"], "y")
    flat = spark.createDataFrame([(1.0, 2.0, 5.0)] * 3, "a double, b double, y double")
    assert G.fit_surrogate(flat, ["a", "b"], "y").predict([[1.0, 2.0]])[0][0] == pytest.approx(5.0)


def test_parego_against_a_loop(spark):
    rng = np.random.default_rng(8)
    P = np.round(rng.uniform(0, 1, (200, 2)), 1)                           # many ties
    df = spark.createDataFrame([(i, *map(float, P[i])) for i in range(200)] + [(999, None, -9.0)], "k long, u double, v double").repartition(5)
    weights = G.dirichlet_weights(6, ["u", "v"], seed=1) + [{"u": 0.5, "v": 0.5}] * 3
    got = G.parego_select(df, {"u": "min", "v": "max"}, {"u": (0, 1), "v": (0, 2)}, weights, "k")
    f = np.stack([P[:, 0], 1 - P[:, 1] / 2], 1)
    taken = []
    for w in weights:
        s = f * [w["u"], w["v"]]
        s = s.max(1) + 0.05 * s.sum(1)
        taken.append(min((x for x in range(200) if x not in taken), key=lambda x: (round(s[x], 12), x)))
    assert [r["k"] for r in got.orderBy("weight_no").collect()] == taken
    assert G.parego_select(df.limit(0), {"u": "min", "v": "max"}, {"u": (0, 1), "v": (0, 2)}, weights, "k").count() == 0


def test_parego_suggest_shares_one_gram(spark):
    df, *_ = observations(spark, n=2500)
    cands = SR.grid_candidates(spark, [SR.between("a", -2, 2), SR.between("b", -2, 2)], 9).limit(81)
    got = G.parego_suggest(df, cands, ["a", "b"], {"y": "max", "z": "min"}, n=4).orderBy("weight_no").collect()
    assert [r["weight_no"] for r in got] == [1, 2, 3, 4] and len({r["grid_index"] for r in got}) == 4
    assert all(r["b"] > 0 for r in got)
    first = G.parego_suggest(df, cands, ["a", "b"], {"y": "max", "z": "min"}, weights=[{"y": 0.0, "z": 1.0}]).first()
    assert abs(first["a"]) < 0.6


def test_parego_select_keeps_a_few_candidates_a_task(spark, monkeypatch):
    rng = np.random.RandomState(4)
    v = np.round(rng.rand(400, 2), 2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "k long, p double, q double")
    weights = [{"p": 0.5, "q": 0.5}, {"p": 0.5, "q": 0.5}, {"p": 0.9, "q": 0.1}]
    monkeypatch.setattr(G, "Window", None)                  # a window would sort every candidate of every weight
    got = [(r["weight_no"], r["k"]) for r in G.parego_select(df, {"p": "min", "q": "max"}, {"p": (0, 1), "q": (0, 1)}, weights, "k").orderBy("weight_no").collect()]
    want, taken = [], set()
    for no, w in enumerate(weights):
        f = [(w["p"] * r[0], w["q"] * (1.0 - r[1])) for r in v]
        best = min((max(x) + 0.05 * sum(x), i) for i, x in enumerate(f) if i not in taken)[1]
        taken.add(best)
        want.append((no + 1, best))
    assert got == want


@pytest.mark.parametrize("gaps", [False, True])
def test_lists_of_targets_share_one_gram(spark, monkeypatch, gaps):
    from tabwright.plans import fourier
    rng = np.random.RandomState(6)
    X = rng.rand(1500, 2)
    rows = [(float(a), float(b), float(a - b), None if gaps and i % 9 == 0 else float(a * b)) for i, (a, b) in enumerate(X)]
    df = spark.createDataFrame(rows, "a double, b double, y double, z double").repartition(3)
    made, plain = [], fourier.gram
    monkeypatch.setattr(fourier, "gram", lambda *args: made.append(1) or plain(*args))
    (one,), both = fourier.fit_fourier_sets(df, ["a", "b"], [["y"], ["y", "z"]], n_features=24)
    assert len(made) == (2 if gaps else 1)
    basis = both[1].basis
    want = [fourier.fit_fourier(df, ["a", "b"], s, n_features=24) for s in (["y"], ["y", "z"])]
    for got, m in zip([one, *both], want[0] + want[1]):
        assert (got.length, got.noise) == (m.length, m.noise)
        np.testing.assert_allclose(got.predict(X[:50]), m.predict(X[:50]), rtol=1e-6, atol=1e-9)
    if not gaps:                                                     # the blocks' sums are those of all rows at once
        E = np.hstack([basis(X, one.length), np.ones((len(X), 1))])
        np.testing.assert_allclose((one.precision - np.eye(25)) * one.noise, E.T @ E, rtol=1e-8, atol=1e-8)
