"""Exact Kendall tau-b without emitting row pairs.

tau-b = S / sqrt((n0 − n1)(n0 − n2)), S = n0 − n1 − n2 + n3 − 2D, where D is
the number of strictly discordant pairs (x_i < x_j, y_i > y_j) and n1, n2, n3
are the x-, y- and joint-tie pair counts.  Work happens on the *cell table*
(distinct (x, y) with multiplicity w), so duplicates and hot values collapse
map-side.  D is split by a grid of x-ranges (P) and y-ranges (Q), cut on
values so equal x (or y) never straddle two ranges:

  D = D_cross + Σ_p D(range p) + Σ_q D(range q) − Σ_{p,q} D(cell p,q)

D_cross (pairs in different x- AND y-ranges) comes from the P×Q weight matrix
(collected: bounded by P·Q) with 2-D prefix sums; each in-range term is a
weighted inversion count computed inside one task per range (Fenwick tree over
the range's own y ranks)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bounds(cells: DataFrame, col: str, parts: int) -> list:
    if parts <= 1:
        return []
    qs = cells.agg(F.percentile_approx(col, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    return sorted(set(float(q) for q in qs))


def _bucket(col: str, bounds: list):
    e = F.lit(0)
    for b in bounds:
        e = e + (F.col(col) >= F.lit(b)).cast("int")
    return e


def _inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted count of pairs with x_i < x_j and y_i > y_j (Fenwick over y ranks)."""
    if len(x) < 2:
        return 0.0
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order]
    ys = np.unique(y)
    r = np.searchsorted(ys, y) + 1
    m = len(ys)
    tree = np.zeros(m + 1)
    total = 0.0
    inserted = 0.0
    i = 0
    n = len(x)
    while i < n:
        j = i
        while j < n and x[j] == x[i]:
            j += 1
        # query the group (same x) against earlier groups: weight with y' > y
        for k in range(i, j):
            s, idx = 0.0, int(r[k])
            while idx > 0:
                s += tree[idx]
                idx -= idx & (-idx)
            total += w[k] * (inserted - s)           # inserted weight with rank > r[k]
        for k in range(i, j):
            idx = int(r[k])
            while idx <= m:
                tree[idx] += w[k]
                idx += idx & (-idx)
            inserted += w[k]
        i = j
    return float(total)


def kendall_tau_b(df: DataFrame, x: str, y: str, parts: int = 16) -> float:
    """Exact tau-b of two numeric columns (pairwise complete)."""
    cells = (df.select(F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias("x"),
                       F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double")).alias("y"))
             .where(F.col("x").isNotNull() & F.col("y").isNotNull())
             .groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    ties = cells.agg(F.sum("w").alias("N"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("n3")).first()
    N = ties["N"] or 0.0
    if N < 2:
        return float("nan")
    n1 = cells.groupBy("x").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).first()[0]
    n2 = cells.groupBy("y").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).first()[0]
    bx, by = _bounds(cells, "x", parts), _bounds(cells, "y", parts)
    g = cells.withColumn("p", _bucket("x", bx)).withColumn("q", _bucket("y", by))
    P, Q = len(bx) + 1, len(by) + 1
    M = np.zeros((P, Q))
    for r in g.groupBy("p", "q").agg(F.sum("w").alias("w")).collect():
        M[r["p"], r["q"]] = r["w"]
    # D_cross: (p, q) with (p', q'), p' > p and q' < q
    # S[p, q] = Σ_{p' > p, q' < q} M[p', q']
    suf = np.cumsum(M[::-1, :], axis=0)[::-1, :]          # Σ_{p' ≥ p}
    suf = np.vstack([suf[1:, :], np.zeros((1, Q))])       # Σ_{p' > p}
    pre = np.cumsum(suf, axis=1)                          # Σ_{q' ≤ q}
    pre = np.hstack([np.zeros((P, 1)), pre[:, :-1]])      # Σ_{q' < q}
    d_cross = float((M * pre).sum())
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("d", T.DoubleType())])

    def by_x(batches):
        import pandas as pd
        frames = [b for b in batches]
        if not frames:
            return
        pdf = pd.concat(frames)
        out = []
        for p, part in pdf.groupby("p"):
            out.append(("range", _inversions(part.x.to_numpy(), part.y.to_numpy(), part.w.to_numpy())))
            for q, cell in part.groupby("q"):
                out.append(("cell", _inversions(cell.x.to_numpy(), cell.y.to_numpy(), cell.w.to_numpy())))
        yield pd.DataFrame(out, columns=["kind", "d"])

    def by_y(batches):
        import pandas as pd
        frames = [b for b in batches]
        if not frames:
            return
        pdf = pd.concat(frames)
        out = [("range", _inversions(part.x.to_numpy(), part.y.to_numpy(), part.w.to_numpy()))
               for _, part in pdf.groupby("q")]
        yield pd.DataFrame(out, columns=["kind", "d"])

    dx = g.repartition(P, "p").mapInPandas(by_x, schema).groupBy("kind").agg(F.sum("d").alias("d")).collect()
    dy = g.repartition(Q, "q").mapInPandas(by_y, schema).agg(F.sum("d")).first()[0] or 0.0
    dxd = {r["kind"]: r["d"] for r in dx}
    D = d_cross + dxd.get("range", 0.0) + dy - dxd.get("cell", 0.0)
    n0 = N * (N - 1) / 2
    S = n0 - n1 - n2 + ties["n3"] - 2 * D
    den = math.sqrt((n0 - n1) * (n0 - n2))
    return S / den if den > 0 else float("nan")
