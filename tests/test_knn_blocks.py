import numpy as np
import pytest

from tabwright.plans import knn as K


def brute(points, queries, k, other):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in points
                      if w is not None and not (other and i == q))
        out.setdefault(q, []).extend(near[:k])
    return {q: [i for _, i in sorted(got)[:k]] for q, got in out.items()}


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query"], []).append(r["neighbor"])
    return out


@pytest.mark.parametrize("dim,block", [(2, 16), (24, 40), (24, None)])
def test_blocks_find_what_all_pairs_find(spark, dim, block):
    """Clusters, copies of one vector, rows without a vector, several blocks a task."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(260, dim)) + 20.0 * rnd.integers(0, 3, size=(260, 1))
    points = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    points += [(1000 + i, points[3][1]) for i in range(150)] + [(5000, None)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    some = [(i, v) for i, v in points if v is not None]
    assert found(K.knn_self(df, "id", "v", k=4, h0=2, block=block)) == brute(some, some, 4, True)
    asked = [(9000 + i, [float(v) for v in r]) for i, r in enumerate(rnd.normal(size=(30, dim)) * 8)]
    near = K.knn(df, spark.createDataFrame(asked, "id long, v array<double>"), "id", "v", k=3, h0=2, block=block)
    assert found(near) == brute(some, asked, 3, False)


def test_a_key_that_comes_often_hides_no_neighbour(spark):
    points = [(1, [0.0, float(i % 3)]) for i in range(40)] + [(i, [0.5, float(i)]) for i in range(2, 30)]
    df = spark.createDataFrame(points, "id long, v array<float>")
    assert set(found(K.knn_self(df, "id", "v", k=3, h0=2, block=8))[1]) <= {2, 3, 4, 5}


def test_pairs_are_scored_by_matrix_product_not_column_by_column(monkeypatch):
    """Few pairs get the exact sum: those whose rounding the product can't exclude."""
    rnd = np.random.default_rng(6)
    q, c = rnd.normal(size=(300, 32)), rnd.normal(size=(400, 32))
    exact = np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
    limit = np.sort(exact, axis=1)[:, 4]
    row, col, dist = K._nearest(q, c, np.full(300, -1), np.arange(400), limit, 5)
    want = np.argsort(exact, axis=1, kind="stable")[:, :5]
    assert (col.reshape(300, 5) == want).all() and np.allclose(dist, exact[row, col], atol=0, rtol=1e-14)
    monkeypatch.setattr(K, "_TILE", 900)
    monkeypatch.setattr(K, "_EXACT", 64)
    assert (K._nearest(q, c, np.full(300, -1), np.arange(400), np.full(300, np.inf), 5)[1].reshape(300, 5) == want).all()
