import math
import random

import pytest

from tabwright.plans.knn_impute import KnnImputer

COLS = ["a", "b", "c", "d"]
SCHEMA = "id long, a double, b double, c double, d double, v string"


def plain(donors, rows, k):
    p = len(COLS)
    means = [(lambda x: sum(x) / len(x) if x else None)([r[j] for r in donors if r[j] is not None]) for j in range(p)]
    out = []
    for r in rows:
        new = list(r)
        for t in range(p):
            if r[t] is None:
                near = []
                for y in donors:
                    shared = [j for j in range(p) if r[j] is not None and y[j] is not None]
                    if y[t] is not None and shared:
                        near.append((p / len(shared) * sum((r[j] - y[j]) ** 2 for j in shared), [-math.inf if x is None else x for x in y], y[t]))
                near = sorted(near)[:k]
                new[t] = sum(x[2] for x in near) / len(near) if near else means[t]
        out.append(new)
    return out


def rows_of(rnd, n, gap, step):
    out = []
    for _ in range(n):
        base = rnd.choice([0, 5, 5, 20])
        out.append([None if rnd.random() < gap else round(rnd.gauss(base, 2) / step) * step for _ in COLS])
    return out


@pytest.mark.parametrize("step,k,ring", [(0.001, 5, 512), (1.0, 3, 7), (0.01, 1, 3)])
def test_against_all_donors(spark, step, k, ring):
    rnd = random.Random(int(k))
    rows = rows_of(rnd, 260, 0.25, step) + [[None] * 4] + [[1.0, None, 3.0, 4.0]] * 40
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = {r.id: r for r in KnnImputer(k, ring=ring).fit(df, COLS).transform(df).collect()}
    for i, want in enumerate(plain(rows, rows, k)):
        assert all(math.isclose(got[i][c], w, rel_tol=1e-9, abs_tol=1e-9) for c, w in zip(COLS, want)), (rows[i], want, got[i])
        assert got[i]["v"] == "x"


def test_other_table_indicator_and_empty(spark):
    rnd = random.Random(8)
    donors, rows = rows_of(rnd, 80, 0.1, 0.01), rows_of(rnd, 40, 0.4, 0.01) + [[1e6, None, math.nan, -1e6]]
    make = lambda rs: spark.createDataFrame([(i, *r, None) for i, r in enumerate(rs)], SCHEMA)
    model = KnnImputer(4, add_indicator=True).fit(make(donors), COLS)
    got = {r.id: r for r in model.transform(make(rows)).collect()}
    clean = [[None if x is None or math.isnan(x) else x for x in r] for r in rows]
    for i, want in enumerate(plain(donors, clean, 4)):
        assert all(math.isclose(got[i][c], w, rel_tol=1e-9, abs_tol=1e-9) for c, w in zip(COLS, want))
        assert [got[i][f"missingindicator_{c}"] for c in COLS] == [float(x is None) for x in clean[i]]
    assert model.transform(make([])).collect() == []
    assert [r.a for r in KnnImputer().fit(make([]), COLS).transform(make([[None, 1.0, 2.0, 3.0]])).collect()] == [None]


def test_a_query_looks_into_few_boxes():
    import numpy as np
    from tabwright.plans.knn_impute import _Boxes
    rnd = np.random.RandomState(1)
    x = np.c_[rnd.lognormal(5, 2, 20_000), rnd.randint(0, 5, 20_000) * 10.0]
    tree = _Boxes.of(x[::10], 10)                                   # cuts from a tenth of the donors
    leaf = tree.first[tree.around(x)]
    some = [x[leaf == i] for i in range(leaf.max() + 1)]
    assert max(map(len, some)) < 600
    tree.fill(np.arange(len(some)), np.array([s.min(0) for s in some]), np.array([s.max(0) for s in some]), np.array([len(s) for s in some]))
    limit = np.full(300, 4.0)
    asked = [(r, i) for rows, i in tree.within(x[:300], limit) for r in rows]
    assert len(asked) < 300 * 5                                      # of some 200 boxes; rings around 256 pivots took one per pivot
    for r in range(300):
        near = np.flatnonzero(((x - x[r]) ** 2).sum(1) <= 4.0)
        assert {(r, i) for i in leaf[near]} <= set(asked)
    node = tree.around(np.array([[-1e9, 1e9]]), 700)                 # the lowest node that holds that many
    assert tree.n[node[0]] >= 700


def test_a_box_that_many_ask_for(spark, monkeypatch):
    from tabwright.plans import knn_impute
    monkeypatch.setattr(knn_impute, "QUERIES", 16)
    rnd = random.Random(3)
    rows = [[rnd.choice([1.0, 2.0]), None, rnd.random(), rnd.random()] for _ in range(150)] + [[1.0, rnd.random(), None, None] for _ in range(40)]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = {r.id: r for r in KnnImputer(3).fit(df, COLS).transform(df).collect()}
    for i, want in enumerate(plain(rows, rows, 3)):
        assert all(math.isclose(got[i][c], w, rel_tol=1e-9, abs_tol=1e-9) for c, w in zip(COLS, want))
