"""Linear-model tree regressor (M11): a tree whose split minimises the summed
residual error of ridge models fitted in the two children, with a ridge model
in every leaf.

Level-wise and aggregate-only: per level ONE grouped aggregate produces, for
every (node, feature, threshold bin), the sufficient statistics of the ridge
fits — n, ZᵀZ, Zᵀy, yᵀy with z = (1, x) — summed map-side; prefix sums over
bins give every candidate split's left/right statistics, and each candidate is
scored with a (p+1)×(p+1) solve on the driver.  Node membership is a column
expression built from the splits so far, so nothing is materialised per level.
Thresholds are ≤ 64 quantile bin edges per feature (instead of midpoints of
all unique values).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B


@dataclass
class _Node:
    nid: int
    depth: int
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    coef: np.ndarray | None = None       # (p + 1): intercept first


def _ridge(zz: np.ndarray, zy: np.ndarray, yy: float, lam: float):
    """β and SSE of ridge with an unpenalised intercept from sufficient statistics."""
    pen = lam * np.eye(len(zy))
    pen[0, 0] = 0.0
    try:
        beta = np.linalg.solve(zz + pen, zy)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(zz + pen, zy, rcond=None)[0]
    sse = yy - 2 * beta @ zy + beta @ zz @ beta
    return beta, max(float(sse), 0.0)


def quantile_edges(data: DataFrame, features, max_bins: int) -> list[list[float]]:
    """Candidate thresholds: approximate quantile edges per feature (bounded: p × max_bins)."""
    probs = [i / max_bins for i in range(1, max_bins)]
    row = data.agg(*[F.percentile_approx(c, probs, 10000).alias(f"e{j}") for j, c in enumerate(features)]).first()
    return [sorted(set(row[f"e{j}"] or [])) for j in range(len(features))]


@dataclass
class LinearTreeRegressor:
    max_depth: int = 5
    min_samples_split: int = 6
    min_samples_leaf: int = 3
    max_bins: int = 64
    alpha: float = 1.0
    nodes: dict = field(default_factory=dict)
    features: list = field(default_factory=list)

    def _node_expr(self) -> Column:
        """Leaf id of every row from the splits so far (nested CASE)."""
        def build(nid):
            nd = self.nodes[nid]
            if nd.feature < 0:
                return F.lit(nid)
            x = B.as_double(self.features[nd.feature])
            return F.when(x <= F.lit(nd.threshold), build(nd.left)).otherwise(build(nd.right))
        return build(0)

    def fit(self, df: DataFrame, features, target, weight: Column | None = None) -> "LinearTreeRegressor":
        """``target`` is a column name or expression; ``weight`` an optional
        per-row weight expression (bootstrap counts, boosting weights)."""
        self.features = list(features)
        p = len(self.features)
        y = B.as_double(target) if isinstance(target, str) else target
        w = weight if weight is not None else F.lit(1.0)
        data = df.select(*[B.as_double(c).alias(c) for c in self.features], y.alias("_y"), w.cast("double").alias("_w")) \
            .where(F.col("_y").isNotNull() & (F.col("_w") > 0))
        edges = quantile_edges(data, self.features, self.max_bins)
        z = [F.lit(1.0)] + [F.coalesce(F.col(c), F.lit(0.0)) for c in self.features]
        q = p + 1
        self.nodes = {0: _Node(0, 0)}
        frontier = [0]
        next_id = 1
        # statistics of every node of the current level, per feature bin
        for depth in range(self.max_depth + 1):
            if not frontier:
                break
            node = self._node_expr()
            recs = []
            for j in range(p):
                bexpr = F.lit(0)
                for e in edges[j]:
                    bexpr = bexpr + (F.col(self.features[j]) > F.lit(e)).cast("int")
                recs.append(F.struct(F.lit(j).alias("j"), bexpr.alias("b")))
            base = data.withColumn("_node", node).where(F.col("_node").isin(frontier))
            ex = base.select("_node", F.inline(F.array(*recs)), *[zz.alias(f"z{i}") for i, zz in enumerate(z)], "_y", "_w")
            wc = F.col("_w")
            aggs = [F.sum(wc).alias("n"), F.sum(wc * F.col("_y") * F.col("_y")).alias("yy")]
            aggs += [F.sum(wc * F.col(f"z{a}") * F.col(f"z{b}")).alias(f"zz{a}_{b}") for a in range(q) for b in range(a, q)]
            aggs += [F.sum(wc * F.col(f"z{a}") * F.col("_y")).alias(f"zy{a}") for a in range(q)]
            rows = ex.groupBy("_node", "j", "b").agg(*aggs).collect()
            stats = {}
            for r in rows:
                zz = np.zeros((q, q))
                for a in range(q):
                    for b in range(a, q):
                        zz[a, b] = zz[b, a] = r[f"zz{a}_{b}"]
                zy = np.array([r[f"zy{a}"] for a in range(q)])
                stats.setdefault(r["_node"], {}).setdefault(r["j"], {})[r["b"]] = (r["n"], zz, zy, r["yy"])
            new_frontier = []
            for nid in frontier:
                nd = self.nodes[nid]
                per_f = stats.get(nid, {})
                if not per_f:
                    nd.coef = np.zeros(q)
                    continue
                # node totals from any feature's bins
                tot = [0, np.zeros((q, q)), np.zeros(q), 0.0]
                for (n, zz, zy, yy) in per_f[next(iter(per_f))].values():
                    tot[0] += n
                    tot[1] += zz
                    tot[2] += zy
                    tot[3] += yy
                nd.coef, _ = _ridge(tot[1], tot[2], tot[3], self.alpha)
                n_tot = tot[0]
                if depth >= self.max_depth or n_tot < self.min_samples_split or n_tot <= 2 * self.min_samples_leaf:
                    continue
                best = None
                for j, bins in per_f.items():
                    acc = [0, np.zeros((q, q)), np.zeros(q), 0.0]
                    for b in range(len(edges[j])):
                        if b in bins:
                            n, zz, zy, yy = bins[b]
                            acc = [acc[0] + n, acc[1] + zz, acc[2] + zy, acc[3] + yy]
                        nl, nr = acc[0], n_tot - acc[0]
                        if nl < self.min_samples_leaf or nr < self.min_samples_leaf:
                            continue
                        _, sl = _ridge(acc[1], acc[2], acc[3], self.alpha)
                        _, sr = _ridge(tot[1] - acc[1], tot[2] - acc[2], tot[3] - acc[3], self.alpha)
                        score = (sl + sr) / n_tot
                        if best is None or score < best[0] - 1e-12:
                            best = (score, j, edges[j][b])
                if best is None:
                    continue
                nd.feature, nd.threshold = best[1], float(best[2])
                nd.left, nd.right = next_id, next_id + 1
                self.nodes[next_id] = _Node(next_id, depth + 1)
                self.nodes[next_id + 1] = _Node(next_id + 1, depth + 1)
                new_frontier += [next_id, next_id + 1]
                next_id += 2
            frontier = new_frontier
        return self

    def predict_expr(self) -> Column:
        """The leaf's ridge model, as one nested CASE of linear expressions."""
        def build(nid):
            nd = self.nodes[nid]
            if nd.feature < 0:
                e = F.lit(float(nd.coef[0]))
                for j, c in enumerate(self.features):
                    e = e + F.lit(float(nd.coef[j + 1])) * F.coalesce(B.as_double(c), F.lit(0.0))
                return e
            x = B.as_double(self.features[nd.feature])
            return F.when(x <= F.lit(nd.threshold), build(nd.left)).otherwise(build(nd.right))
        return build(0)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.predict_expr())

    @property
    def n_leaves(self) -> int:
        return sum(1 for n in self.nodes.values() if n.feature < 0)


def poisson_weight(key: Column, tree: int, seed: int) -> Column:
    """Bootstrap count of a row in tree ``tree``: Poisson(1) by inverse CDF of a hash."""
    import math
    u = (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(tree)), F.lit(1 << 40)).cast("double")) / float(1 << 40)
    acc, p, w = 0.0, math.exp(-1.0), F.lit(12.0)
    cdf = []
    for k in range(12):
        acc += p
        cdf.append(acc)
        p /= (k + 1)
    for k in reversed(range(12)):
        w = F.when(u < F.lit(cdf[k]), F.lit(float(k))).otherwise(w)
    return w


@dataclass
class LinearForestRegressor:
    """M12 — mean of linear trees, each on Poisson(1)-weighted rows (hash of
    (key, tree)) and a seeded feature subset (``max_features`` share)."""
    n_trees: int = 10
    max_depth: int = 3
    max_features: float = 1.0
    seed: int = 42
    trees: list = field(default_factory=list)

    def fit(self, df: DataFrame, key: str, features, target: str) -> "LinearForestRegressor":
        import random
        feats = list(features)
        k = max(1, int(round(self.max_features * len(feats))))
        self.trees = []
        for t in range(self.n_trees):
            sub = sorted(random.Random(self.seed * 1000 + t).sample(feats, k))
            m = LinearTreeRegressor(max_depth=self.max_depth).fit(df, sub, target, poisson_weight(F.col(key), t, self.seed))
            self.trees.append(m)
        return self

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        e = F.lit(0.0)
        for m in self.trees:
            e = e + m.predict_expr()
        return df.withColumn(name, e / F.lit(float(len(self.trees))))


@dataclass
class LinearBoostRegressor:
    """M13 — residual boosting of linear trees: start at the mean, each round
    fits a tree to the current residual and adds it with ``learning_rate``."""
    n_rounds: int = 5
    max_depth: int = 2
    learning_rate: float = 0.5
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, df: DataFrame, features, target: str) -> "LinearBoostRegressor":
        self.base = df.agg(F.avg(B.as_double(target))).first()[0]
        self.trees = []
        for _ in range(self.n_rounds):
            resid = B.as_double(target) - self.predict_expr()
            self.trees.append(LinearTreeRegressor(max_depth=self.max_depth).fit(df, features, resid))
        return self

    def predict_expr(self) -> Column:
        e = F.lit(float(self.base))
        for m in self.trees:
            e = e + F.lit(self.learning_rate) * m.predict_expr()
        return e

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.predict_expr())
