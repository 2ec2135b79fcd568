"""Regularised greedy forest (M14): after every new tree the weights of all leaves of all trees are solved anew.

A round fits one tree to the residuals (Spark ML, depth ⌈log2 max_leaves⌉), adds each row's leaf to its list of leaves and
counts, in one grouped aggregate, how often each new leaf meets each older one, with the label sums of the new leaves.
These counts are the new rows of ΦᵀΦ for the leaf indicators Φ, so the ridge system (ΦᵀΦ + λ₂I)w = Φᵀ(y − ȳ) is complete
without another scan; λ₁ shrinks the solution by soft thresholds.  The driver holds n_trees · max_leaves squared numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.session import cut_lineage


def solve(gram: np.ndarray, sums: np.ndarray, l2: float, l1: float) -> np.ndarray:
    a = gram + l2 * np.eye(len(sums))
    w = np.linalg.lstsq(a, sums, rcond=None)[0] if l2 <= 0 else np.linalg.solve(a, sums)
    return np.sign(w) * np.maximum(0.0, np.abs(w) - l1)


def _leaf(model, first: int) -> Column:
    """Number of a row's leaf among all leaves, from the tree's leaf column."""
    return (F.get(vector_to_array("_tw_leaf"), F.lit(0)) + first).cast("int")


@dataclass
class GreedyForestModel:
    features: str
    base: float
    trees: list                       # (tree model, number of its first leaf)
    weights: np.ndarray

    def leaves(self, df: DataFrame) -> DataFrame:
        """``df`` with _tw_ids: the row's leaf in each tree."""
        out = df.withColumn("_tw_ids", F.array().cast("array<int>"))
        for model, first in self.trees:
            out = model.transform(out).withColumn("_tw_ids", F.concat("_tw_ids", F.array(_leaf(model, first)))).drop("_tw_leaf", "_tw_p")
        return out

    def score(self) -> Column:
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        return F.lit(self.base) + F.aggregate("_tw_ids", F.lit(0.0), lambda s, i: s + F.coalesce(F.get(w, i), F.lit(0.0)))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return self.leaves(df).withColumn(name, self.score()).drop("_tw_ids")


@dataclass
class GreedyForestRegressor:
    features: str = "features"
    label: str = "label"
    n_trees: int = 100
    max_leaves: int = 32
    l2: float = 1.0
    l1: float = 0.0
    min_leaf: int = 5
    max_features: str = "sqrt"
    subsample: float = 1.0
    seed: int = 42

    def fit(self, df: DataFrame) -> GreedyForestModel:
        from pyspark.ml.regression import RandomForestRegressor
        y = F.col(self.label).cast("double")
        data = df.select(self.features, y.alias("_tw_y"), F.array().cast("array<int>").alias("_tw_ids")).where("_tw_y IS NOT NULL")
        base = data.agg(F.avg("_tw_y")).first()[0]
        if base is None:
            raise ValueError("no labelled rows")
        model = GreedyForestModel(self.features, float(base), [], np.zeros(0))
        gram, sums = np.zeros((0, 0)), np.zeros(0)
        for k in range(self.n_trees):
            rest = data.withColumn("_tw_r", F.col("_tw_y") - model.score())
            tree = RandomForestRegressor(featuresCol=self.features, labelCol="_tw_r", predictionCol="_tw_p", numTrees=1, seed=self.seed + k,
                                         maxDepth=max(1, math.ceil(math.log2(self.max_leaves))), minInstancesPerNode=self.min_leaf, bootstrap=False,
                                         subsamplingRate=self.subsample, featureSubsetStrategy=self.max_features).fit(rest).setLeafCol("_tw_leaf")
            first = len(sums)
            data = cut_lineage(tree.transform(data).withColumn("_tw_ids", F.concat("_tw_ids", F.array(_leaf(tree, first)))).drop("_tw_leaf", "_tw_p"))
            met = (data.select(F.element_at("_tw_ids", -1).alias("a"), "_tw_y", F.explode("_tw_ids").alias("b"))
                   .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_tw_y") - F.lit(base)).alias("s")).collect())
            size = max(r["a"] for r in met) + 1
            gram, sums = np.pad(gram, (0, size - first)), np.pad(sums, (0, size - first))
            for r in met:
                gram[r["a"], r["b"]] = gram[r["b"], r["a"]] = r["n"]
                if r["a"] == r["b"]:
                    sums[r["a"]] = r["s"]
            model.trees.append((tree, first))
            model.weights = solve(gram, sums, self.l2, self.l1)
        return model


@dataclass
class GreedyForestClassifierModel:
    members: list

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in enumerate(self.members):
            out = m.transform(out, f"_tw_c{c}")
        scores = [F.greatest(F.least(F.col(f"_tw_c{c}"), F.lit(1.0)), F.lit(0.0)) + F.lit(1e-9) for c in range(len(self.members))]
        p = F.array(*[s / sum(scores[1:], scores[0]) for s in scores])
        out = out.withColumn("_tw_p", p).withColumns({"probability": array_to_vector("_tw_p"),
                                                      "prediction": (F.array_position("_tw_p", F.array_max("_tw_p")) - 1).cast("double")})
        return out.drop("_tw_p", *[f"_tw_c{c}" for c in range(len(self.members))])


@dataclass
class GreedyForestClassifier(GreedyForestRegressor):
    """One forest per class against the rest, on 0/1 labels; probabilities are the clipped scores, made to sum to 1."""

    def fit(self, df: DataFrame) -> GreedyForestClassifierModel:
        y = F.col(self.label).cast("double")
        top = df.agg(F.max(y)).first()[0]
        if top is None:
            raise ValueError("no labelled rows")
        own = {k: v for k, v in vars(self).items() if k != "label"}
        marked = df.where(y.isNotNull()).select(self.features, y.alias("_tw_class"))
        return GreedyForestClassifierModel([GreedyForestRegressor(label="_tw_is", **own).fit(marked.withColumn("_tw_is", (F.col("_tw_class") == c).cast("double")))
                                            for c in range(int(top) + 1)])
