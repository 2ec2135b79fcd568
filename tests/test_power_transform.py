"""λ of the power transforms against a plain likelihood in long double, without bounds on λ."""

import numpy as np
import pytest

from tabwright.operators import prep as P


def psi(x, lam, method):
    x, lam = np.asarray(x, np.longdouble), np.longdouble(lam)
    if abs(lam) > 3 and (x > 0).all():                                 # without the − 1, which would take all digits
        return (x if method == "box-cox" else 1 + x) ** lam / lam
    if abs(2 - lam) > 3 and (x < 0).all():
        return -(1 - x) ** (2 - lam) / (2 - lam)
    if method == "box-cox":
        return np.expm1(lam * np.log(x)) / lam if lam else np.log(x)
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    pos = np.expm1(lam * np.log1p(up)) / lam if lam else np.log1p(up)
    neg = -np.expm1((2 - lam) * np.log1p(-down)) / (2 - lam) if lam != 2 else -np.log1p(-down)
    return np.where(x >= 0, pos, neg)


def likelihood(x, lam, method):
    x = np.asarray(x, np.longdouble)
    jac = np.log(x) if method == "box-cox" else np.sign(x) * np.log1p(np.abs(x))
    return float(-len(x) / 2 * np.log(np.var(psi(x, lam, method))) + (lam - 1) * jac.sum())


RNG = np.random.default_rng(5)
COLUMNS = {
    "years": 2025.0 - np.floor(RNG.exponential(4.0, 400)),             # λ far above 4
    "price": 1000.0 + RNG.exponential(5.0, 400),                       # λ far below −4
}
MORE = {"mixed": RNG.normal(0.0, 2.0, 400) ** 3, "below": -RNG.exponential(3.0, 400) - 500.0, "zero": np.floor(RNG.exponential(2.0, 400))}


@pytest.mark.parametrize("method", ["box-cox", "yeo-johnson"])
def test_lambda_is_the_likeliest(spark, method):
    data = COLUMNS | (MORE if method == "yeo-johnson" else {})
    rows = [tuple(float(v[i]) for v in data.values()) for i in range(400)] + [(None,) * len(data)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data))
    model = P.PowerTransformer(method).fit(df, list(data))
    out = model.transform(df).toPandas()
    for c, x in data.items():
        lam = model.lambdas[c]
        at, wide = likelihood(x, lam, method), max(0.05, abs(lam) * 0.05)
        assert at > likelihood(x, lam - wide, method) and at > likelihood(x, lam + wide, method), (c, lam)
        want = psi(x, lam, method)
        want = ((want - want.mean()) / want.std()).astype(float)
        assert np.allclose(out[c].to_numpy(dtype=float)[:400], want, atol=1e-6), c
        assert np.isnan(out[c].iloc[400])
    assert model.lambdas["years"] > 4.5 and model.lambdas["price"] < -4.5


def test_other_sign_constant_and_empty(spark):
    fit = spark.createDataFrame([(float(i), 3.0, None) for i in range(1, 50)], "x double, k double, e double")
    model = P.PowerTransformer().fit(fit, ["x", "k", "e"])
    new = spark.createDataFrame([(-2.0, 3.0, 1.0), (5.0, 3.0, None)], "x double, k double, e double")
    got = model.transform(new).collect()
    x = np.arange(1.0, 50.0)
    base = psi(x, model.lambdas["x"], "yeo-johnson")
    want = (psi([-2.0, 5.0], model.lambdas["x"], "yeo-johnson") - base.mean()) / base.std()
    assert [r.x for r in got] == pytest.approx([float(w) for w in want])
    assert [r.k for r in got] == [0.0, 0.0] and model.lambdas["k"] == 1.0 and got[1].e is None
    assert P.PowerTransformer().fit(fit.limit(0), ["x"]).transform(fit.limit(0)).count() == 0
