"""Extra trees (M4): all trees grown together, level by level, with one random cut per feature and node.

A level takes two scans: the range of every feature in every open node (min and max, combined in the tasks), then, with a
cut drawn uniformly from each range, the label sums on the left of each cut.  The driver holds the trees and, per level, one
row per open node and feature.  Cuts depend on (seed, tree, node, feature) and the ranges alone, so a fit is the same for
any partitioning.  Every tree sees all rows.  Missing values (null, NaN) go to the right.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Tree:
    """Arrays by node: split feature (-1: leaf), cut, left child (right: left + 1) and label sums."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [-1])
    sums: list = field(default_factory=lambda: [None])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        f, c, nxt = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(f[at] >= 0)).size:
            n = at[inner]
            at[inner] = nxt[n] + ~(x[inner, f[n]] <= c[n])
        return at


def draw(seed: int, tree: int, node: int, lo: np.ndarray, hi: np.ndarray, wanted: int) -> list[tuple[int, float]]:
    """(feature, cut) for up to ``wanted`` features that vary in the node."""
    rng = np.random.default_rng([seed, tree, node])
    order, where = rng.permutation(len(lo)), rng.random(len(lo))
    varied = [int(j) for j in order if lo[j] < hi[j]][:wanted]
    return [(j, min(lo[j] + where[j] * (hi[j] - lo[j]), np.nextafter(hi[j], lo[j]))) for j in varied]


def gain(total: np.ndarray, left: np.ndarray, classes: int, least: int) -> float:
    """How much a split lowers the impurity times n (Gini, or the sum of squares); -inf where a side has under ``least`` rows."""
    right = total - left
    if classes:
        n, a, b = total.sum(), left.sum(), right.sum()
        score = lambda s, m: (s * s).sum() / m
    else:
        n, a, b = total[0], left[0], right[0]
        score = lambda s, m: s[1] * s[1] / m
    return -np.inf if min(a, b) < max(least, 1) else score(left, a) + score(right, b) - score(total, n)


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten().fill_null(np.nan), float).reshape(len(column), -1)


def _label_sums(y: np.ndarray, classes: int) -> np.ndarray:
    return np.eye(classes)[y.astype(int)] if classes else np.stack([np.ones(len(y)), y], 1)


def _groups(node: np.ndarray, open_nodes: np.ndarray):
    """Row order and starts of the rows in open nodes, and those nodes."""
    at = np.flatnonzero(np.isin(node, open_nodes))
    order = at[np.argsort(node[at], kind="stable")]
    nodes, starts = np.unique(node[order], return_index=True)
    return order, starts, nodes


@dataclass
class ExtraTreesModel:
    features: str
    classes: int
    trees: list

    def transform(self, df: DataFrame) -> DataFrame:
        trees, classes = df.sparkSession.sparkContext.broadcast(self.trees), self.classes

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(x):
            import pandas as pd
            v = np.array(x.tolist(), float).reshape(len(x), -1)
            out = 0.0
            for tree in trees.value:
                s = np.array(tree.sums)[tree.leaf(v)]
                out = out + (s / s.sum(1, keepdims=True) if classes else s[:, 1:] / s[:, :1])
            return pd.Series(list(out / len(trees.value)))
        got = df.withColumn("_tw_s", scored(vector_to_array(self.features)))
        if not classes:
            return got.withColumn("prediction", F.get("_tw_s", F.lit(0))).drop("_tw_s")
        best = F.array_position("_tw_s", F.array_max("_tw_s")) - 1                       # the first of equal ones
        return got.withColumns({"probability": array_to_vector("_tw_s"), "prediction": best.cast("double")}).drop("_tw_s")


@dataclass
class ExtraTrees:
    task: str = "regression"
    features: str = "features"
    label: str = "label"
    n_trees: int = 50
    max_depth: int = 8
    min_leaf: int = 1
    max_features: str | float = "sqrt"
    seed: int = 42

    def fit(self, df: DataFrame) -> ExtraTreesModel:
        data = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y")).where("y IS NOT NULL").persist()
        try:
            return self._fit(data)
        finally:
            data.unpersist()

    def _fit(self, data: DataFrame) -> ExtraTreesModel:
        first = data.agg(F.max(F.size("x")).alias("p"), F.max("y").alias("top"), F.count("y").alias("n"), F.sum("y").alias("s")).first()
        if not first["n"]:
            raise ValueError("no labelled rows")
        p, classes = first["p"], int(first["top"]) + 1 if self.task == "classification" else 0
        wanted = max(1, int(p ** 0.5)) if self.max_features == "sqrt" else max(1, round(float(self.max_features) * p))
        if classes:
            counts = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
            root = np.array([counts.get(float(c), 0) for c in range(classes)], float)
        else:
            root = np.array([first["n"], first["s"]], float)
        trees = [Tree(sums=[root]) for _ in range(self.n_trees)]
        open_nodes = {t: [0] for t in range(self.n_trees) if self.max_depth and self._splittable(root, classes)}
        sc = data.sparkSession.sparkContext
        for depth in range(self.max_depth):
            if not open_nodes:
                break
            now = sc.broadcast((trees, open_nodes))
            ranges: dict = {}
            for r in data.mapInArrow(_ranges(now), "t int, n int, j int, lo double, hi double").groupBy("t", "n", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
                ranges.setdefault((r["t"], r["n"]), []).append((r["j"], r["lo"], r["hi"]))
            cuts = {}
            for (t, n), rows in ranges.items():
                lo, hi = np.full(p, np.inf), np.full(p, -np.inf)
                for j, a, b in rows:
                    lo[j], hi[j] = a, b
                if drawn := draw(self.seed, t, n, lo, hi, wanted):
                    cuts.setdefault(t, {})[n] = drawn
            if not cuts:
                break
            width = classes or 2
            cols = [f"s{i}" for i in range(width)]
            lefts = data.mapInArrow(_lefts(sc.broadcast((trees, cuts)), classes), "t int, n int, c int, " + ", ".join(f"{c} double" for c in cols))
            best: dict = {}
            for r in lefts.groupBy("t", "n", "c").agg(*[F.sum(c).alias(c) for c in cols]).collect():
                left = np.array([r[c] for c in cols])
                g = gain(trees[r["t"]].sums[r["n"]], left, classes, self.min_leaf)
                key = (r["t"], r["n"])
                if g > 1e-12 and (key not in best or (g, -r["c"]) > best[key][:2]):
                    best[key] = (g, -r["c"], left)
            open_nodes = {}
            for (t, n), (_, c, left) in sorted(best.items()):
                tree, (j, cut) = trees[t], cuts[t][n][-c]
                tree.feature[n], tree.cut[n], tree.left[n] = j, cut, len(tree.feature)
                for side in (left, tree.sums[n] - left):
                    if depth + 1 < self.max_depth and self._splittable(side, classes):
                        open_nodes.setdefault(t, []).append(len(tree.feature))
                    tree.feature.append(-1)
                    tree.cut.append(0.0)
                    tree.left.append(-1)
                    tree.sums.append(side)
        return ExtraTreesModel(self.features, classes, trees)

    def _splittable(self, sums: np.ndarray, classes: int) -> bool:
        n = sums.sum() if classes else sums[0]
        return n >= 2 * self.min_leaf and n > 1 and not (classes and (sums > 0).sum() < 2)


def _ranges(now):
    def run(batches):
        trees, open_nodes = now.value
        for batch in batches:
            x = _matrix(batch.column(0))
            p = x.shape[1]
            for t, nodes in open_nodes.items() if len(x) else ():
                order, starts, seen = _groups(trees[t].leaf(x), np.array(nodes))
                if len(order):
                    lo, hi = np.fmin.reduceat(x[order], starts), np.fmax.reduceat(x[order], starts)
                    lo, hi = np.where(np.isnan(lo), np.inf, lo), np.where(np.isnan(hi), -np.inf, hi)
                    yield pa.record_batch([pa.array(np.full(lo.size, t, np.int32)), pa.array(np.repeat(seen, p).astype(np.int32)),
                                           pa.array(np.tile(np.arange(p, dtype=np.int32), len(seen))), pa.array(lo.ravel()), pa.array(hi.ravel())],
                                          ["t", "n", "j", "lo", "hi"])
    return run


def _lefts(now, classes):
    def run(batches):
        trees, cuts = now.value
        for batch in batches:
            x = _matrix(batch.column(0))
            s = _label_sums(batch.column(1).to_numpy(), classes)
            for t, by_node in cuts.items() if len(x) else ():
                order, starts, seen = _groups(trees[t].leaf(x), np.array(list(by_node)))
                ends = np.append(starts[1:], len(order))
                rows = [(n, c, s[at][x[at, j] <= cut].sum(0)) for n, at in zip(seen.tolist(), (order[a:b] for a, b in zip(starts, ends)))
                        for c, (j, cut) in enumerate(by_node[n])]
                if rows:
                    sums = np.array([r[2] for r in rows])
                    yield pa.record_batch([pa.array([t] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
                                           pa.array([r[1] for r in rows], pa.int32()), *[pa.array(sums[:, i]) for i in range(sums.shape[1])]],
                                          ["t", "n", "c", *[f"s{i}" for i in range(sums.shape[1])]])
    return run
