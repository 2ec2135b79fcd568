"""Monotone regression by isotonic pull (M15), for any Spark ML regressor with a weight column.

A profile of a feature is the model's prediction along that feature with all others at their medians.  The wanted
profile is the closest monotone one, found by pool-adjacent-violators.  Where the two differ, the profile's points
join the training rows with the isotonic value as label and the weight ``pull``, and the model is fitted again.
All profiles of a round are one small frame and one prediction job; its size is constrained features × ``points``,
whatever the data.  The data itself is only unioned with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.plans.ordering import exact_quantiles


def isotonic(values, rising: bool = True) -> np.ndarray:
    """The monotone sequence with the least squared distance to ``values`` (pool adjacent violators)."""
    v = np.asarray(values, float) * (1 if rising else -1)
    level, size = [], []
    for x in v:
        level.append(x)
        size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            n = size[-2] + size[-1]
            level[-2:] = [(level[-2] * size[-2] + level[-1] * size[-1]) / n]
            size[-2:] = [n]
    return np.repeat(level, size) * (1 if rising else -1)


@dataclass
class MonotoneRegressor:
    """``make(weight_col)`` gives an unfitted regressor; ``directions``: feature → +1, −1 or 0 (free)."""
    make: object
    directions: dict
    points: int = 25
    span: tuple = (0.05, 0.95)          # quantiles between which a profile is looked at
    pull: float = 5.0
    rounds: int = 4
    tolerance: float = 1e-3             # of the target's standard deviation
    model: object = None
    history: list = field(default_factory=list)      # largest distance to the isotonic profile, per round

    def _profiles(self, data: DataFrame, features: list) -> DataFrame:
        q = {r["col_name"]: r for r in exact_quantiles(data, features, [0.5, *self.span]).collect()}
        wanted = [f for f in features if self.directions.get(f, 0) and q[f]["q2"] > q[f]["q1"]]
        rows = [(f, k, *[float(x) if c == f else float(q[c]["q0"]) for c in features])
                for f in wanted for k, x in enumerate(np.linspace(q[f]["q1"], q[f]["q2"], self.points))]
        return data.sparkSession.createDataFrame(rows, "_profile string, _at int, " + ", ".join(f"`{c}` double" for c in features))

    def fit(self, df: DataFrame, features, target: str) -> "MonotoneRegressor":
        features = list(features)
        data = df.select(*[B.as_double(c).alias(c) for c in features], B.as_double(target).alias("label"), F.lit(1.0).alias("_weight"))
        to_vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
        scale = data.agg(F.stddev_pop("label")).first()[0] or 1.0
        probe = to_vector.transform(self._profiles(data, features))
        train = data
        for turn in range(self.rounds + 1):
            self.model = self.make("_weight").fit(to_vector.transform(train))
            seen: dict = {}
            for r in self.model.transform(probe).orderBy("_profile", "_at").collect():       # points × constrained features
                seen.setdefault(r["_profile"], []).append(r)
            wrong, worst = [], 0.0
            for f, rows in seen.items():
                want = isotonic([r["prediction"] for r in rows], self.directions[f] > 0)
                for r, w in zip(rows, want):
                    gap = abs(w - r["prediction"]) / scale
                    worst = max(worst, gap)
                    if gap > self.tolerance:
                        wrong.append((*[r[c] for c in features], float(w), float(self.pull)))
            self.history.append(worst)
            if not wrong or turn == self.rounds:
                break
            train = train.unionByName(df.sparkSession.createDataFrame(wrong, train.schema))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Predict on a frame that already holds the assembled ``features`` vector."""
        return self.model.transform(df)
