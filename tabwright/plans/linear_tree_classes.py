"""Classifiers of linear trees (M11–M13): labels are 0 … K−1, a model's ``transform`` adds ``probability`` and ``prediction``.

* :class:`LinearTreeClassifier`: splits that leave the least Gini impurity, found level by level from one aggregate of
  class counts per (node, feature, bin); then one logistic model per leaf by Newton's method, all leaves together.  A
  Newton step needs each leaf's gradient and Hessian only: tasks sum them over their rows, the sums are added in two
  grouped steps, and (classes·(p + 1))² numbers a leaf reach the driver whatever the number of rows.
* :class:`LinearForestClassifier`: mean probability of trees on Poisson(1)-weighted rows and feature subsets.
* :class:`LinearBoostClassifier`: regression trees of linear models on the residuals of the logit (two classes) or the
  softmax (more), starting at the classes' log odds.

Null labels are not learnt from, null features count as 0 in the linear models and go right at a split.  A leaf of one
class predicts it; classes absent from a leaf get probability 0 there.  No labelled row raises ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.plans.fourier import FAN_IN, _added
from tabwright.plans.linear_tree import LinearTreeRegressor, _Node, poisson_weight, quantile_edges


def _logits(W: np.ndarray, Z: np.ndarray) -> np.ndarray:
    """Class probabilities, rows × classes; one row of ``W`` stands for the second of two classes."""
    s = Z @ W.T
    if len(W) == 1:
        s = np.hstack([np.zeros((len(Z), 1)), s])
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


def _derivatives(W, Z, y, w):
    """Loss, gradient and Hessian of the weighted log loss at ``W`` as one flat array."""
    P = _logits(W, Z)
    loss = -(w * np.log(np.maximum(P[np.arange(len(y)), y], 1e-300))).sum()
    P, first = (P[:, 1:], 1) if len(W) == 1 else (P, 0)
    k, q = W.shape
    hit = y[:, None] == np.arange(k) + first
    grad = ((P - hit) * w[:, None]).T @ Z
    H = np.zeros((k, q, k, q))
    for a in range(k):
        for b in range(a, k):
            H[a, :, b, :] = (Z * (w * P[:, a] * ((a == b) - P[:, b]))[:, None]).T @ Z
            H[b, :, a, :] = H[a, :, b, :].T
    return np.concatenate([[loss], grad.ravel(), H.ravel()])


@dataclass
class _Fit:
    """Newton's state of one leaf: the accepted point, its penalised loss and the step that is tried."""
    present: list
    W: np.ndarray
    loss: float = np.inf
    step: np.ndarray | None = None
    rate: float = 1.0
    done: bool = False

    def trial(self):
        return self.W if self.step is None else self.W - self.rate * self.step

    def take(self, flat, pen, tol):
        W = self.trial()
        k, q = W.shape
        loss = flat[0] + 0.5 * (pen * W * W).sum()
        if loss > self.loss + 1e-9 * max(1.0, abs(self.loss)):
            self.rate /= 2
            self.done = self.rate < 1e-6
            return
        grad = flat[1: 1 + k * q] + (pen * W).ravel()
        H = flat[1 + k * q:].reshape(k * q, k * q) + np.diag(np.tile(pen, k))
        step = np.linalg.lstsq(H, grad, rcond=None)[0]
        self.W, self.loss, self.step, self.rate = W, loss, step.reshape(k, q), 1.0
        self.done = grad @ step < tol * max(1.0, loss)


def fit_leaves(rows: DataFrame, n_features: int, counts: dict, alpha: float, max_iter: int, tol: float) -> dict:
    """Penalised logistic models of all leaves; ``rows`` holds z0 … , _y, _w and _node, ``counts`` the leaves' class weights."""
    q = n_features + 1
    pen = np.r_[1e-8, np.full(n_features, alpha)]
    fits = {}
    for leaf, c in counts.items():
        present = [int(k) for k in np.flatnonzero(c > 0)]
        fits[leaf] = _Fit(present, np.zeros((1 if len(present) == 2 else len(present), q)), done=len(present) < 2)
    for _ in range(max_iter):
        trials = {leaf: (f.trial(), f.present) for leaf, f in fits.items() if not f.done}
        if not trials:
            break

        def sums(batches, trials=trials):
            import pandas as pd
            from pyspark import TaskContext
            total = {}
            for pdf in batches:
                V = pdf.to_numpy(float)
                for leaf in np.unique(V[:, -1]).astype(int):
                    if leaf in trials:
                        W, present = trials[leaf]
                        S = V[V[:, -1] == leaf]
                        Z = np.hstack([np.ones((len(S), 1)), S[:, :-3]])
                        total[leaf] = total.get(leaf, 0) + _derivatives(W, Z, np.searchsorted(present, S[:, -3].astype(int)), S[:, -2])
            if total:
                yield pd.DataFrame({"leaf": list(total), "part": TaskContext.get().partitionId(), "row": list(total.values())})

        kinds = "leaf int, part int, row array<double>"
        parts = rows.where(F.col("_node").isin(list(trials))).mapInPandas(sums, kinds).withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        some = parts.groupBy("leaf", "part").applyInPandas(_added(["leaf", "part"]), kinds)
        for r in some.groupBy("leaf").applyInPandas(_added(["leaf"]), "leaf int, row array<double>").collect():
            fits[r["leaf"]].take(np.array(r["row"]), pen, tol)
    return fits


def node_of(nodes: dict, X: np.ndarray) -> np.ndarray:
    """The leaf of each row, by the splits of ``nodes``; a missing value goes right."""
    at, todo = np.zeros(len(X), int), [(0, np.arange(len(X)))]
    while todo:
        nid, rows = todo.pop()
        nd = nodes[nid]
        if nd.feature < 0:
            at[rows] = nid
        else:
            left = X[rows, nd.feature] <= nd.threshold
            todo += [(nd.left, rows[left]), (nd.right, rows[~left])]
    return at


def _gini(c: np.ndarray) -> float:
    n = c.sum()
    return float(n - (c @ c) / n) if n > 0 else 0.0


def _classes(df: DataFrame, y: Column) -> int:
    top = df.agg(F.max(y)).first()[0]
    if top is None:
        raise ValueError("no labelled rows")
    return int(top) + 1


def _with_classes(df: DataFrame, p: Column) -> DataFrame:
    out = df.withColumn("_tw_p", p)
    best = (F.array_position("_tw_p", F.array_max("_tw_p")) - 1).cast("double")                 # the first of equal ones
    return out.withColumns({"probability": array_to_vector("_tw_p"), "prediction": best}).drop("_tw_p")


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


@dataclass
class LinearTreeClassifier:
    max_depth: int = 5
    min_samples_split: int = 6
    min_samples_leaf: int = 3
    max_bins: int = 64
    alpha: float = 1.0
    max_iter: int = 100
    tol: float = 1e-10
    n_classes: int = 0
    nodes: dict = field(default_factory=dict)
    leaves: dict = field(default_factory=dict)
    features: list = field(default_factory=list)

    def _route(self, at_leaf) -> Column:
        """Nested CASE of the splits, ``at_leaf(node id)`` in the leaves."""
        def build(nid):
            nd = self.nodes[nid]
            if nd.feature < 0:
                return at_leaf(nid)
            return F.when(B.as_double(self.features[nd.feature]) <= F.lit(nd.threshold), build(nd.left)).otherwise(build(nd.right))
        return build(0)

    def fit(self, df: DataFrame, features, target: str, weight: Column | None = None, n_classes: int | None = None) -> "LinearTreeClassifier":
        self.features = list(features)
        w = weight if weight is not None else F.lit(1.0)
        data = df.select(*[B.as_double(c).alias(c) for c in self.features], B.as_double(target).alias("_y"), w.cast("double").alias("_w")) \
            .where(F.col("_y").isNotNull() & (F.col("_w") > 0))
        self.n_classes = K = n_classes or _classes(data, F.col("_y"))
        edges = quantile_edges(data, self.features, self.max_bins)
        self.nodes, frontier, counts = {0: _Node(0, 0)}, [0], {}
        for depth in range(self.max_depth + 1):
            if not frontier:
                break
            stats = self._class_counts(data, edges, frontier, K)
            grown = []
            for nid in frontier:
                per_f = stats.get(nid)
                if per_f is None:                                                   # no labelled row at all
                    counts[nid] = np.zeros(K)
                    continue
                counts[nid] = total = next(iter(per_f.values())).sum(0)
                best = None if depth >= self.max_depth or total.sum() < self.min_samples_split else self._best_split(per_f, edges, total)
                if best is None:
                    continue
                nd = self.nodes[nid]
                nd.feature, nd.threshold = best
                nd.left, nd.right = len(self.nodes), len(self.nodes) + 1
                for child in (nd.left, nd.right):
                    self.nodes[child] = _Node(child, depth + 1)
                    grown.append(child)
            frontier = grown
        at = {nid: counts[nid] for nid, nd in self.nodes.items() if nd.feature < 0}
        rows = data.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(f"z{i}") for i, c in enumerate(self.features)], "_y", "_w",
                           self._route(F.lit).alias("_node"))
        self.leaves = fit_leaves(rows, len(self.features), at, self.alpha, self.max_iter, self.tol)
        return self

    def _class_counts(self, data, edges, frontier, K):
        """Class weights per bin: node → feature → (bins × classes)."""
        rows = data.select(*[F.col(c).alias(f"z{i}") for i, c in enumerate(self.features)], "_y", "_w")
        nodes, names, sizes = self.nodes, frontier, [len(e) + 1 for e in edges]
        cuts = [np.asarray(e, float) for e in edges]

        def sums(batches):
            import pandas as pd
            from pyspark import TaskContext
            total = {}
            for pdf in batches:
                V = pdf.to_numpy(float)
                X, y, w = V[:, :-2], V[:, -2], V[:, -1]
                at = node_of(nodes, X)
                bins = [np.searchsorted(e, X[:, j]) for j, e in enumerate(cuts)]    # a null is in the last bin: it goes right
                known = (y >= 0) & (y < K) & (y == np.floor(y))
                for nid in names:
                    rows = at == nid
                    if rows.any():
                        rows &= known
                        cell = [b[rows] * K + y[rows].astype(int) for b in bins]
                        got = np.concatenate([np.bincount(c, w[rows], n * K) for c, n in zip(cell, sizes)])
                        total[nid] = total.get(nid, 0) + got
            if total:
                yield pd.DataFrame({"leaf": list(total), "part": TaskContext.get().partitionId(), "row": list(total.values())})

        kinds = "leaf int, part int, row array<double>"
        parts = rows.mapInPandas(sums, kinds).withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        some = parts.groupBy("leaf", "part").applyInPandas(_added(["leaf", "part"]), kinds)
        out = {}
        for r in some.groupBy("leaf").applyInPandas(_added(["leaf"]), "leaf int, row array<double>").collect():
            per = np.split(np.array(r["row"]), np.cumsum([n * K for n in sizes])[:-1])
            out[r["leaf"]] = {j: c.reshape(n, K) for j, (c, n) in enumerate(zip(per, sizes))}
        return out

    def _best_split(self, per_f, edges, total):
        """(feature, threshold) of the least impurity that is below the node's own; the first of equal ones."""
        best, limit = None, _gini(total) - 1e-9 * total.sum()
        for j in sorted(per_f):
            left = np.cumsum(per_f[j], axis=0)
            for b, e in enumerate(edges[j]):
                if min(left[b].sum(), total.sum() - left[b].sum()) >= self.min_samples_leaf:
                    g = _gini(left[b]) + _gini(total - left[b])
                    if g < limit:
                        best, limit = (j, float(e)), g - 1e-12 * total.sum()
        return best

    def _leaf_probabilities(self, nid) -> Column:
        f = self.leaves[nid]
        p = {k: F.lit(0.0) for k in range(self.n_classes)}
        if len(f.present) == 1:
            p[f.present[0]] = F.lit(1.0)
        elif len(f.present) > 1:
            scores = [F.lit(0.0)] if len(f.W) == 1 else []
            for row in f.W:
                s = F.lit(float(row[0]))
                for v, c in zip(row[1:], self.features):
                    s = s + F.lit(float(v)) * F.coalesce(B.as_double(c), F.lit(0.0))
                scores.append(s)
            p.update(zip(f.present, _softmax(scores)))
        return F.array(*[p[k] for k in range(self.n_classes)])

    def probabilities(self) -> Column:
        return self._route(self._leaf_probabilities)

    def transform(self, df: DataFrame) -> DataFrame:
        return _with_classes(df, self.probabilities())


@dataclass
class LinearForestClassifier:
    """M12 — each tree sees Poisson(1) copies of the rows (hash of (key, tree)) and a seeded share of the features."""
    n_trees: int = 10
    max_depth: int = 3
    max_features: float = 1.0
    seed: int = 42
    trees: list = field(default_factory=list)

    def fit(self, df: DataFrame, key: str, features, target: str) -> "LinearForestClassifier":
        import random
        feats = list(features)
        k = max(1, int(round(self.max_features * len(feats))))
        n_classes = _classes(df, B.as_double(target))
        self.trees = [LinearTreeClassifier(max_depth=self.max_depth).fit(df, sorted(random.Random(self.seed * 1000 + t).sample(feats, k)), target,
                                                                         poisson_weight(F.col(key), t, self.seed), n_classes)
                      for t in range(self.n_trees)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        n = self.trees[0].n_classes
        out = df.withColumns({f"_tw_t{t}": m.probabilities() for t, m in enumerate(self.trees)})
        total = []
        for k in range(n):
            s = F.get("_tw_t0", F.lit(k))
            for t in range(1, len(self.trees)):
                s = s + F.get(f"_tw_t{t}", F.lit(k))
            total.append(s / F.lit(float(len(self.trees))))
        return _with_classes(out, F.array(*total)).drop(*[f"_tw_t{t}" for t in range(len(self.trees))])


@dataclass
class LinearBoostClassifier:
    """M13 — ``scores[k]`` is the sum of class k's trees; with two classes only the second has any."""
    n_rounds: int = 5
    max_depth: int = 2
    learning_rate: float = 0.5
    base: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def fit(self, df: DataFrame, features, target: str) -> "LinearBoostClassifier":
        y = B.as_double(target)
        K = max(2, _classes(df, y))
        share = df.where(y.isNotNull()).agg(*[F.avg((y == F.lit(float(k))).cast("double")).alias(f"c{k}") for k in range(K)]).first()
        p = np.clip([share[f"c{k}"] for k in range(K)], 1e-6, 1 - 1e-6)
        start = np.log(p / (1 - p))
        self.base, self.trees = ([0.0, float(start[1])] if K == 2 else [float(v) for v in start]), [[] for _ in range(K)]
        for _ in range(self.n_rounds):
            now = _softmax(self.scores())
            self.trees = [old if K == 2 and k == 0 else old + [LinearTreeRegressor(max_depth=self.max_depth).fit(
                df, features, (y == F.lit(float(k))).cast("double") - now[k])] for k, old in enumerate(self.trees)]
        return self

    def scores(self) -> list[Column]:
        out = []
        for b, trees in zip(self.base, self.trees):
            e = F.lit(b)
            for m in trees:
                e = e + F.lit(self.learning_rate) * m.predict_expr()
            out.append(e)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        n = len(self.base)
        out = df.withColumns({f"_tw_s{k}": s for k, s in enumerate(self.scores())})
        return _with_classes(out, F.array(*_softmax([F.col(f"_tw_s{k}") for k in range(n)]))).drop(*[f"_tw_s{k}" for k in range(n)])
