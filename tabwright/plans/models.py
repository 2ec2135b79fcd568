"""Model registry (M1–M6, M17) on Spark ML estimators.

A registry entry is (task, factory, tags, note).  Keys that name learners
without a Spark core map to the nearest Spark ML estimator and carry a note.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import classification as C
from pyspark.ml import regression as R


@dataclass
class ModelSpec:
    key: str
    task: str
    factory: object
    tags: tuple = ()
    note: str = ""


def _lin(reg=0.0, en=0.0, loss="squaredError"):
    def f(features="features", label="label", weight=None, **kw):
        m = R.LinearRegression(featuresCol=features, labelCol=label, regParam=kw.get("regParam", reg),
                               elasticNetParam=kw.get("elasticNetParam", en), loss=loss,
                               maxIter=kw.get("maxIter", 100), standardization=True)
        if weight:
            m.setWeightCol(weight)
        return m
    return f


def _tree(cls, **defaults):
    def f(features="features", label="label", weight=None, **kw):
        params = {**defaults, **kw}
        m = cls(featuresCol=features, labelCol=label, **params)
        if weight and m.hasParam("weightCol"):
            m.setWeightCol(weight)
        return m
    return f


def _ovr_gbt(features="features", label="label", weight=None, **kw):
    base = C.GBTClassifier(featuresCol=features, labelCol=label, maxIter=kw.get("maxIter", 50), seed=42)
    return C.OneVsRest(classifier=base, featuresCol=features, labelCol=label)


def _logistic(features="features", label="label", weight=None, **kw):
    m = C.LogisticRegression(featuresCol=features, labelCol=label, regParam=kw.get("regParam", 0.0),
                             elasticNetParam=kw.get("elasticNetParam", 0.0), maxIter=kw.get("maxIter", 100))
    if weight:
        m.setWeightCol(weight)
    return m


def _svc(features="features", label="label", weight=None, **kw):
    return C.OneVsRest(classifier=C.LinearSVC(featuresCol=features, labelCol=label, regParam=kw.get("regParam", 0.0)),
                       featuresCol=features, labelCol=label)


def _nb(kind):
    def f(features="features", label="label", weight=None, **kw):
        return C.NaiveBayes(featuresCol=features, labelCol=label, modelType=kind)
    return f


class _Searched:
    """A linear model whose penalty is chosen by k-fold search over ``grid``, refitted on all rows."""

    def __init__(self, make, label, grid, n_splits, seed):
        self.make, self.label, self.grid, self.n_splits, self.seed = make, label, grid, n_splits, seed

    def fit(self, df):
        from pyspark.ml.evaluation import RegressionEvaluator
        from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
        m = self.make()
        grid = ParamGridBuilder()
        for name, values in self.grid.items():
            grid = grid.addGrid(m.getParam(name), values)
        return CrossValidator(estimator=m, estimatorParamMaps=grid.build(), evaluator=RegressionEvaluator(labelCol=self.label, metricName="rmse"),
                              numFolds=self.n_splits, seed=self.seed).fit(df).bestModel


def _searched(en, **axes):
    def f(features="features", label="label", weight=None, **kw):
        grid = {"regParam": list(kw.get("alphas", (0.001, 0.01, 0.1, 1.0, 10.0))), **axes}
        return _Searched(lambda: _lin(0.1, en)(features, label, weight), label, grid, kw.get("n_splits", 5), kw.get("seed", 42))
    return f


class _SizedMlp:
    """A perceptron whose input and output layers follow the data; ``hidden`` are the layers between."""

    def __init__(self, features, label, hidden, max_iter):
        self.features, self.label, self.hidden, self.max_iter = features, label, hidden, max_iter

    def fit(self, df):
        from pyspark.ml.functions import vector_to_array
        from pyspark.sql import functions as F
        r = df.agg(F.max(F.size(vector_to_array(self.features))).alias("n"), F.max(self.label).alias("k")).first()
        layers = [int(r["n"]), *self.hidden, int(r["k"]) + 1]
        return C.MultilayerPerceptronClassifier(featuresCol=self.features, labelCol=self.label, layers=layers, seed=42,
                                                maxIter=self.max_iter).fit(df)


def _mlp(features="features", label="label", weight=None, **kw):
    return _SizedMlp(features, label, list(kw.get("hidden", (32,))), kw.get("maxIter", 200))


def _extra(task):
    def f(features="features", label="label", weight=None, **kw):
        from tabwright.plans.extra_trees import ExtraTrees
        return ExtraTrees(task, features, label, **kw)
    return f


def _greedy_forest(task):
    def f(features="features", label="label", weight=None, **kw):
        from tabwright.plans import rgf
        return (rgf.GreedyForestRegressor if task == "regression" else rgf.GreedyForestClassifier)(features, label, **kw)
    return f


@dataclass
class _OnColumns:
    """A learner over named columns, given a vector column: its entries become columns for the fit and the prediction.
    ``learn(df, key, columns, label)`` gives a model whose ``transform`` adds ``prediction``; ``key`` is a hash of the row."""
    learn: object
    features: str
    label: str
    names: tuple = ()
    model: object = None

    def _spread(self, df):
        from pyspark.ml.functions import vector_to_array
        from pyspark.sql import functions as F
        x = vector_to_array(self.features)
        return df.withColumns({c: F.get(x, F.lit(i)) for i, c in enumerate(self.names)} | {"_tw_key": F.xxhash64(x)})

    def fit(self, df):
        from pyspark.ml.functions import vector_to_array
        from pyspark.sql import functions as F
        n = df.agg(F.max(F.size(vector_to_array(self.features)))).first()[0]
        if n is None:
            raise ValueError("no rows to learn from")
        on = _OnColumns(self.learn, self.features, self.label, tuple(f"_tw_x{i}" for i in range(n)))
        on.model = self.learn(on._spread(df), "_tw_key", list(on.names), self.label)
        return on

    def transform(self, df):
        return self.model.transform(self._spread(df)).drop(*self.names, "_tw_key")


def _on_columns(learn):
    def f(features="features", label="label", weight=None, **kw):
        return _OnColumns(lambda df, key, cols, y: learn(df, key, cols, y, **kw), features, label)
    return f


def _linear_tree(df, key, cols, y, **kw):
    from tabwright.plans.linear_tree import LinearTreeRegressor
    return LinearTreeRegressor(**kw).fit(df, cols, y)


def _linear_forest(df, key, cols, y, **kw):
    from tabwright.plans.linear_tree import LinearForestRegressor
    return LinearForestRegressor(**kw).fit(df, key, cols, y)


def _linear_boost(df, key, cols, y, **kw):
    from tabwright.plans.linear_tree import LinearBoostRegressor
    return LinearBoostRegressor(**kw).fit(df, cols, y)


def _linear_tree_classes(df, key, cols, y, **kw):
    from tabwright.plans.linear_tree_classes import LinearTreeClassifier
    return LinearTreeClassifier(**kw).fit(df, cols, y)


def _linear_forest_classes(df, key, cols, y, **kw):
    from tabwright.plans.linear_tree_classes import LinearForestClassifier
    return LinearForestClassifier(**kw).fit(df, key, cols, y)


def _linear_boost_classes(df, key, cols, y, **kw):
    from tabwright.plans.linear_tree_classes import LinearBoostClassifier
    return LinearBoostClassifier(**kw).fit(df, cols, y)


def _pls(df, key, cols, y, **kw):
    from tabwright.plans.linear_models import fit_pls
    return fit_pls(df, cols, y, **kw)


def _bayesian_ridge(df, key, cols, y, **kw):
    from tabwright.plans.linear_models import fit_bayesian_ridge
    return fit_bayesian_ridge(df, cols, y, **kw)


def _ard(df, key, cols, y, **kw):
    from tabwright.plans.linear_models import fit_ard
    return fit_ard(df, cols, y, **kw)


@dataclass
class _AdaBoost:
    features: str
    label: str
    options: dict

    def fit(self, df):
        from tabwright.plans.selection import adaboost_classifier
        return adaboost_classifier(df, label=self.label, **self.options)


def _adaboost(features="features", label="label", weight=None, **kw):
    if features != "features":
        raise ValueError("adaboost reads the vector column 'features'")
    return _AdaBoost(features, label, kw)


REGISTRY = {s.key + "/" + s.task: s for s in [
    ModelSpec("linear", "regression", _lin(), ("linear", "default")),
    ModelSpec("ridge", "regression", _lin(1.0, 0.0), ("linear", "default")),
    ModelSpec("lasso", "regression", _lin(0.1, 1.0), ("linear",)),
    ModelSpec("elasticnet", "regression", _lin(0.1, 0.5), ("linear",)),
    ModelSpec("ridge_cv", "regression", _searched(0.0), ("linear",)),
    ModelSpec("lasso_cv", "regression", _searched(1.0), ("linear",)),
    ModelSpec("elasticnet_cv", "regression", _searched(0.5, elasticNetParam=[0.1, 0.5, 0.9]), ("linear",)),
    ModelSpec("huber", "regression", _lin(0.0, 0.0, "huber"), ("linear", "robust")),
    ModelSpec("decision_tree", "regression", _tree(R.DecisionTreeRegressor, maxDepth=5, seed=42), ("tree", "default")),
    ModelSpec("random_forest", "regression", _tree(R.RandomForestRegressor, numTrees=50, maxDepth=8, seed=42), ("tree", "ensemble", "default")),
    ModelSpec("bagging", "regression", _tree(R.RandomForestRegressor, numTrees=20, featureSubsetStrategy="all", bootstrap=True, seed=42), ("ensemble",)),
    ModelSpec("gbm", "regression", _tree(R.GBTRegressor, maxIter=50, maxDepth=5, seed=42), ("tree", "ensemble", "default")),
    ModelSpec("hgbm", "regression", _tree(R.GBTRegressor, maxIter=50, maxDepth=5, maxBins=64, seed=42), ("tree", "ensemble"), "binned gradient boosting"),
    ModelSpec("logistic", "classification", _logistic, ("linear", "default")),
    ModelSpec("linearsvc", "classification", _svc, ("linear",)),
    ModelSpec("decision_tree", "classification", _tree(C.DecisionTreeClassifier, maxDepth=5, seed=42), ("tree", "default")),
    ModelSpec("random_forest", "classification", _tree(C.RandomForestClassifier, numTrees=50, maxDepth=8, seed=42), ("tree", "ensemble", "default")),
    ModelSpec("gbm", "classification", _ovr_gbt, ("tree", "ensemble", "default"), "binary trees, one-vs-rest"),
    ModelSpec("gaussian_nb", "classification", _nb("gaussian"), ("probabilistic",)),
    ModelSpec("bernoulli_nb", "classification", _nb("bernoulli"), ("probabilistic",)),
    ModelSpec("mlp", "classification", _mlp, ("neural",)),
    ModelSpec("bagging", "classification", _tree(C.RandomForestClassifier, numTrees=20, featureSubsetStrategy="all", bootstrap=True, seed=42), ("ensemble",)),
    ModelSpec("extra_trees", "regression", _extra("regression"), ("tree", "ensemble")),
    ModelSpec("extra_trees", "classification", _extra("classification"), ("tree", "ensemble")),
    ModelSpec("rgf", "regression", _greedy_forest("regression"), ("tree", "ensemble")),
    ModelSpec("rgf", "classification", _greedy_forest("classification"), ("tree", "ensemble"), "one-vs-rest"),
    ModelSpec("linear_tree", "regression", _on_columns(_linear_tree), ("tree", "linear")),
    ModelSpec("linear_forest", "regression", _on_columns(_linear_forest), ("tree", "linear", "ensemble")),
    ModelSpec("linear_boost", "regression", _on_columns(_linear_boost), ("tree", "linear", "ensemble")),
    ModelSpec("linear_tree", "classification", _on_columns(_linear_tree_classes), ("tree", "linear"), "logistic leaves"),
    ModelSpec("linear_forest", "classification", _on_columns(_linear_forest_classes), ("tree", "linear", "ensemble")),
    ModelSpec("linear_boost", "classification", _on_columns(_linear_boost_classes), ("tree", "linear", "ensemble")),
    ModelSpec("pls", "regression", _on_columns(_pls), ("linear",)),
    ModelSpec("bayesian_ridge", "regression", _on_columns(_bayesian_ridge), ("linear", "probabilistic")),
    ModelSpec("ard", "regression", _on_columns(_ard), ("linear", "probabilistic")),
    ModelSpec("adaboost", "classification", _adaboost, ("ensemble",), "SAMME over decision stumps"),
]}


def get_model(key: str, task: str, **params):
    """M17 — an unfitted estimator for (key, task)."""
    spec = REGISTRY.get(f"{key}/{task}")
    if spec is None:
        raise KeyError(f"unknown model {key!r} for {task}")
    return spec.factory(**params)


def register_model(key: str, task: str, factory, tags=(), note: str = "") -> None:
    """X5 — a caller's own estimator under a new key; ``factory(features=, label=, weight=, **params)`` gives an
    object whose ``fit(df)`` returns a model with ``transform(df)`` that adds ``prediction``."""
    if f"{key}/{task}" in REGISTRY:
        raise ValueError(f"model {key!r} for {task} is there already")
    REGISTRY[f"{key}/{task}"] = ModelSpec(key, task, factory, tuple(tags), note)


def list_models(spark, task: str | None = None, tag: str | None = None):
    """M17 — registry as a frame, filtered by task and tag."""
    rows = [(s.key, s.task, list(s.tags), s.note) for s in REGISTRY.values()
            if (task is None or s.task == task) and (tag is None or tag in s.tags)]
    return spark.createDataFrame(rows, "key string, task string, tags array<string>, note string")


def default_models(task: str) -> list[str]:
    return [s.key for s in REGISTRY.values() if s.task == task and "default" in s.tags]


# Monotone-direction presets (name fragment → direction), per preset, in their order.
MONOTONE_PRESETS = {
    "boiling_melting_point": {"molwt": 1, "mw": 1, "mol_wt": 1, "molecularweight": 1, "heavyatom": 1,
                              "heavyatoms": 1, "nha": 1, "rotbond": 1, "rotatable": 1, "nrotb": 1,
                              "ringcount": 1, "ring": 1},
    "water_solubility": {"logp": -1, "alogp": -1, "xlogp": -1, "clogp": -1, "hbd": 1, "hbond_donor": 1,
                         "nhbd": 1, "numhdonor": 1, "hba": 1, "hbond_acceptor": 1, "nhba": 1,
                         "numhacceptor": 1, "tpsa": 1},
    "permeability_bbb": {"logp": 1, "alogp": 1, "xlogp": 1, "tpsa": -1, "molwt": -1, "mw": -1, "hbd": -1,
                         "numhdonor": -1},
    "toxicity": {"logp": 1, "alogp": 1, "molwt": 1, "ring": 1, "aromatic": 1},
}


def monotone_presets(columns, preset: str) -> dict:
    """M16 — per column the direction of the first fragment (in preset order)
    contained in its lower-cased name; 0 when none matches."""
    frags = MONOTONE_PRESETS.get(preset, {})
    out = {}
    for c in columns:
        lc = c.lower()
        out[c] = next((v for k, v in frags.items() if k in lc), 0)
    return out
