"""Model explanation over attribution tables (I4–I7, I10, I11) and
model-agnostic estimators (I1, I2) that score perturbed copies in one job.

Attribution (φ) tables are wide: key columns + ``phi_<feature>``.  Every
statistic is an aggregate over them — covariances of all pairs in one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.session import cut_lineage, release


def linear_shap(df: DataFrame, coefficients: dict, keep=(), means: dict | None = None) -> DataFrame:
    """I4 (linear, exact) — φ_j = coef_j · (x_j − mean_j); means from one aggregate
    unless given (the background mean)."""
    feats = list(coefficients)
    if means is None:
        r = df.agg(*[F.avg(B.as_double(c)).alias(c) for c in feats]).first().asDict()
        means = {c: r[c] for c in feats}
    return df.select(*keep, *[(F.lit(float(coefficients[c])) * (B.as_double(c) - F.lit(means[c]))).alias(f"phi_{c}")
                              for c in feats])


def global_importance(phi: DataFrame, features, top_n: int | None = None) -> DataFrame:
    """I5 — mean |φ| per feature, sorted descending (ties by name), optional top N."""
    feats = list(features)
    row = phi.agg(*[F.avg(F.abs(F.col(f"phi_{c}"))).alias(c) for c in feats])
    st = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in feats])
    out = row.select(F.inline(st))
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    return out.where(F.col("rank") <= top_n) if top_n else out


def _cov_row(phi: DataFrame, feats) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, a in enumerate(feats):
        aggs.append(F.var_pop(F.col(f"phi_{a}")).alias(f"v_{i}"))
        for j in range(i + 1, len(feats)):
            aggs.append(F.covar_pop(F.col(f"phi_{a}"), F.col(f"phi_{feats[j]}")).alias(f"c_{i}_{j}"))
    return phi.agg(*aggs)


def sri(phi: DataFrame, features) -> tuple[DataFrame, DataFrame]:
    """I6 — synergy / redundancy / independence from the centred φ covariance.

    s_ij = cov(φ_i, φ_j); ‖φ_i‖² = n·var(φ_i) (centred, *not* divided by n);
    r_ij = s_ij² / (‖φ_i‖² + ‖φ_j‖²) (0 if that is ≤ 1e-12); syn_ij = s_ij − r_ij;
    ind_i = max(0, ‖φ_i‖²/n − Σ_{j≠i} |s_ij|).  Returns (summary, pairs): summary
    per feature with sums over j and columns normalised by the total absolute
    mass; pairs i < j.  All covariances come from ONE aggregate."""
    feats = list(features)
    d = len(feats)
    row = _cov_row(phi, feats)
    n = F.col("_n")
    norm = {i: F.col(f"v_{i}") * n for i in range(d)}

    def s(i, j):
        a, b = min(i, j), max(i, j)
        return F.col(f"c_{a}_{b}")

    def r(i, j):
        den = norm[i] + norm[j]
        return F.when(den > 1e-12, s(i, j) * s(i, j) / den).otherwise(F.lit(0.0))

    pairs_st = F.array(*[F.struct(F.lit(feats[i]).alias("feature_i"), F.lit(feats[j]).alias("feature_j"),
                                  (s(i, j) - r(i, j)).alias("synergy"), r(i, j).alias("redundancy"))
                         for i in range(d) for j in range(i + 1, d)]) if d > 1 else None
    summ = []
    for i in range(d):
        syn = F.lit(0.0)
        red = F.lit(0.0)
        abs_s = F.lit(0.0)
        for j in range(d):
            if j == i:
                continue
            syn = syn + (s(i, j) - r(i, j))
            red = red + r(i, j)
            abs_s = abs_s + F.abs(s(i, j))
        ind = F.greatest(F.lit(0.0), F.col(f"v_{i}") - abs_s)
        summ.append(F.struct(F.lit(feats[i]).alias("feature"), syn.alias("synergy"), red.alias("redundancy"),
                             ind.alias("independence")))
    summary = row.select(F.inline(F.array(*summ)))
    tot = summary.agg((F.sum(F.abs("synergy")) + F.sum(F.abs("redundancy")) + F.sum(F.abs("independence"))).alias("_t"))
    summary = summary.crossJoin(tot).select(
        "feature", "synergy", "redundancy", "independence",
        *[F.when(F.col("_t") > 0, F.col(c) / F.col("_t")).otherwise(0.0).alias(f"{c}_norm")
          for c in ("synergy", "redundancy", "independence")])
    pairs = row.select(F.inline(pairs_st)) if pairs_st is not None else \
        phi.sparkSession.createDataFrame([], "feature_i string, feature_j string, synergy double, redundancy double")
    return summary, pairs


def independence_selection(summary: DataFrame, top_n: int | None = None, threshold: float | None = None) -> DataFrame:
    """E36 — features ranked by independence; keep top N and/or ≥ threshold."""
    out = summary.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("independence"), "feature")))
    if threshold is not None:
        out = out.where(F.col("independence") >= threshold)
    if top_n:
        out = out.where(F.col("rank") <= top_n)
    return out


def interaction_partner(df: DataFrame, phi: DataFrame, feature: str, features, key: str) -> DataFrame:
    """I10 — |corr(φ_other, x_feature)| for every other feature, best first."""
    others = [f for f in features if f != feature]
    j = df.select(key, B.as_double(feature).alias("_x")).join(phi, key)
    row = j.agg(*[F.corr("_x", F.col(f"phi_{o}")).alias(o) for o in others])
    st = F.array(*[F.struct(F.lit(o).alias("partner"), F.abs(F.col(o)).alias("abs_corr")) for o in others])
    out = row.select(F.inline(st)).where(F.col("abs_corr").isNotNull())
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("abs_corr"), "partner")))


def pair_interaction_proxy(phi: DataFrame, features) -> DataFrame:
    """I7 — |corr(φ_i, φ_j)| for all pairs i < j (one aggregate)."""
    feats = list(features)
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    row = phi.agg(*[F.corr(F.col(f"phi_{a}"), F.col(f"phi_{b}")).alias(f"{a}__{b}") for a, b in pairs])
    st = F.array(*[F.struct(F.lit(a).alias("feature_i"), F.lit(b).alias("feature_j"),
                            F.abs(F.col(f"{a}__{b}")).alias("abs_corr")) for a, b in pairs])
    return row.select(F.inline(st))


def single_row_explanation(phi: DataFrame, key: str, value, features, base_value: float,
                           top_n: int = 20) -> DataFrame:
    """I11 — for one row: base value and contributions sorted by |φ|, top N."""
    feats = list(features)
    one = phi.where(F.col(key) == F.lit(value))
    st = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"phi_{c}").alias("phi")) for c in feats])
    out = one.select(F.inline(st)).withColumn("base_value", F.lit(float(base_value)))
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("phi")), "feature")))
    return out.where(F.col("rank") <= top_n)


def permutation_importance(df: DataFrame, key: str, features, target: str, predict,
                           n_repeats: int = 5, seed: int = 42, metric: str = "rmse") -> DataFrame:
    """I1 — loss of score when one feature's values are permuted (n_repeats).

    The rows are numbered once.  A permutation is the affine map
    i → (a·i + b) mod n of that number with a coprime to n, so moving a feature's
    values is one equi-join on the number; no further sort.  All (feature,
    repeat) copies are scored in ONE grouped aggregate; ``predict`` maps a frame
    with the feature columns to a frame with ``prediction``.  ``metric``: rmse
    (rise), or accuracy for classes (fall)."""
    import random
    from tabwright.plans.ordering import global_row_number
    if metric not in ("rmse", "accuracy"):
        raise ValueError(f"unknown metric {metric!r}")
    feats, rnd = list(features), random.Random(seed)
    base = global_row_number(df, [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], "_tw_kr")
    n = base.count()
    allc = base.withColumn("_tw_feature", F.lit("__baseline__")).withColumn("_tw_repeat", F.lit(-1))
    columns = allc.columns
    for f in feats:
        for r in range(n_repeats):
            a = next(x for x in iter(lambda: rnd.randrange(1, max(2, n)), None) if math.gcd(x, max(1, n)) == 1)
            to = F.pmod(F.lit(a).cast("decimal(38,0)") * (F.col("_tw_kr") - 1) + F.lit(rnd.randrange(max(1, n))), F.lit(max(1, n))).cast("long") + 1
            src = base.select(to.alias("_tw_to"), F.col(f).alias("_tw_v"))
            moved = base.drop(f).join(src, F.col("_tw_kr") == F.col("_tw_to")).withColumnRenamed("_tw_v", f).drop("_tw_to")
            allc = allc.unionByName(moved.withColumn("_tw_feature", F.lit(f)).withColumn("_tw_repeat", F.lit(r)).select(*columns))
    scored = predict(allc)
    if metric == "rmse":
        e = F.col(target).cast("double") - F.col("prediction")
        loss = F.sqrt(F.avg(e * e))
    else:
        loss = 1 - F.avg((F.col(target).cast("string") == F.col("prediction").cast("string")).cast("double"))
    sc = scored.groupBy("_tw_feature", "_tw_repeat").agg(loss.alias("_s"))
    b = sc.where(F.col("_tw_feature") == "__baseline__").select(F.col("_s").alias("_b"))
    d = sc.where(F.col("_tw_feature") != "__baseline__").crossJoin(b)
    out = d.groupBy(F.col("_tw_feature").alias("feature")).agg(F.avg(F.col("_s") - F.col("_b")).alias("importance_mean"),
                                                                F.stddev_pop(F.col("_s") - F.col("_b")).alias("importance_std"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance_mean"), "feature")))


def _on_grid(df: DataFrame, feature: str, predict, grid_points: int) -> DataFrame:
    mm = df.agg(F.min(B.as_double(feature)).alias("lo"), F.max(B.as_double(feature)).alias("hi")).first()
    if mm["lo"] is None:
        raise ValueError(f"{feature!r} has no values")
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(mm["lo"] + (mm["hi"] - mm["lo"]) * i / max(grid_points - 1, 1))).alias("v"))
                       for i in range(grid_points)])
    ex = df.drop(feature).withColumn("_tw_g", F.explode(points))
    return predict(ex.withColumns({"grid_id": F.col("_tw_g.i"), "grid_value": F.col("_tw_g.v"), feature: F.col("_tw_g.v")}).drop("_tw_g"))


def partial_dependence(df: DataFrame, feature: str, predict, grid_points: int = 50, sample: int | None = None,
                       key: str | None = None, seed: int = 42) -> DataFrame:
    """I2 — average prediction with ``feature`` set to each of ``grid_points``
    values over [min, max]; over ``sample`` rows in hash order if that is given.
    Each row is expanded where it lies and averaged map-side."""
    rows = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample) if sample and key else df
    return _on_grid(rows, feature, predict, grid_points).groupBy("grid_id", "grid_value").agg(F.avg("prediction").alias("mean_prediction"))


def individual_expectations(df: DataFrame, feature: str, predict, key: str, grid_points: int = 50, sample: int = 100, seed: int = 42,
                            centred: bool = False) -> DataFrame:
    """I2 (ICE) — (key, grid_id, grid_value, prediction): the curve of each of ``sample`` rows, chosen in
    hash order; ``centred`` subtracts a row's prediction at the first grid point."""
    rows = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample)
    out = _on_grid(rows, feature, predict, grid_points).select(key, "grid_id", "grid_value", "prediction")
    if centred:
        first = out.where("grid_id = 0").select(key, F.col("prediction").alias("_tw_p0"))
        out = out.join(first, key).select(key, "grid_id", "grid_value", (F.col("prediction") - F.col("_tw_p0")).alias("prediction"))
    return out


def tree_rules(model, feature_names, df: DataFrame | None = None) -> DataFrame:
    """I9 — one row per leaf of a fitted Spark ML decision tree: the rule as a
    SQL predicate over the feature columns, the leaf prediction and, with
    ``df``, its support (share of rows) from ONE aggregate of all predicates.
    Importance = the model's feature importances of the features used."""
    root = model._java_obj.rootNode()
    rules = []

    def walk(node, conds):
        if node.getClass().getSimpleName() == "LeafNode":
            rules.append((" AND ".join(conds) if conds else "true", float(node.prediction())))
            return
        sp = node.split()
        f = feature_names[sp.featureIndex()]
        if sp.getClass().getSimpleName() == "ContinuousSplit":
            t = sp.threshold()
            walk(node.leftChild(), conds + [f"`{f}` <= {t!r}"])
            walk(node.rightChild(), conds + [f"`{f}` > {t!r}"])
        else:
            cats = ", ".join(repr(float(c)) for c in sp.leftCategories())
            walk(node.leftChild(), conds + [f"`{f}` IN ({cats})"])
            walk(node.rightChild(), conds + [f"NOT (`{f}` IN ({cats}))"])
    walk(root, [])
    spark = (df.sparkSession if df is not None else None)
    imp = list(model.featureImportances.toArray())
    rows = []
    sup = {}
    if df is not None and rules:
        r = df.agg(*[F.avg(F.expr(rule).cast("double")).alias(f"r{i}") for i, (rule, _) in enumerate(rules)]).first()
        sup = {i: r[f"r{i}"] for i in range(len(rules))}
    for i, (rule, pred) in enumerate(rules):
        used = [j for j, f in enumerate(feature_names) if f"`{f}`" in rule]
        rows.append((i, rule, pred, sup.get(i), float(sum(imp[j] for j in used))))
    if spark is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "rule_id int, rule string, prediction double, support double, importance double")


_COPY = "_tw_copy_no"
_TUPLES = 1 << 18                                    # distinct feature rows of a background that is sent to every task
_TASK_ROWS = 1 << 17                                 # rows whose samples a task folds without spilling


def _row_keys(key) -> list:
    return [*([key] if isinstance(key, str) else key), _COPY]


def _scored_as(rows: DataFrame, features, side: str, place: int, predict) -> DataFrame:
    """``rows`` with the prediction of the values ``_tw_<side>_`` as ``_tw_p<place>``; as they are without ``predict``."""
    if predict is None:
        return rows
    return predict(rows.withColumns({c: F.col(f"_tw_{side}_{c}") for c in features})).select(*rows.columns, F.col("prediction").alias(f"_tw_p{place}"))


def _background_rows(background: DataFrame, features, seed: int, predict=None) -> tuple[DataFrame, int, int | None]:
    """(rows, number, width): the background in hash order, its rows numbered from 1, with the values ``_tw_z_`` and their
    prediction ``_tw_p0``.  Equal feature rows are interchangeable and follow one another: if there are at most ``_TUPLES``
    distinct ones, a row stands for the numbers ``_tw_from`` to ``_tw_to`` and comes once per bin ``_tw_bin`` of ``width``
    numbers that these reach into, two bins a row on average; otherwise a row has its number ``_tw_bi`` and width is None."""
    from tabwright.plans.ordering import global_row_number
    feats = list(features)
    code = F.xxhash64(*[F.col(c) for c in feats], F.lit(seed))

    def valued(rows, *more):
        return _scored_as(rows.select(*more, *[B.as_double(c).alias(f"_tw_z_{c}") for c in feats]), feats, "z", 0, predict)
    if background.agg(F.approx_count_distinct(code)).first()[0] <= _TUPLES:
        kinds = background.select(*feats).groupBy(*feats).agg(F.count(F.lit(1)).alias("_tw_n"))
        kinds = cut_lineage(kinds.withColumn("_tw_h", code))
        to = F.sum("_tw_n").over(Window.orderBy("_tw_h", *feats).rowsBetween(Window.unboundedPreceding, 0))      # few rows
        kinds = kinds.withColumn("_tw_to", to).withColumn("_tw_from", F.col("_tw_to") - F.col("_tw_n") + 1)
        n, many = kinds.agg(F.coalesce(F.sum("_tw_n"), F.lit(0)), F.count(F.lit(1))).first()
        width = max(1, n // max(1, many))
        bins = F.sequence(F.floor(F.col("_tw_from") / width), F.floor(F.col("_tw_to") / width))
        return valued(kinds, "_tw_from", "_tw_to").withColumn("_tw_bin", F.explode(bins)), n, width
    # a copy number spreads a hot feature row over partitions
    bg = background.select(*feats).withColumn("_tw_copy", F.monotonically_increasing_id())
    bg = global_row_number(bg, [code] + [F.col(c) for c in feats] + ["_tw_copy"], "_tw_bi")
    return valued(bg, "_tw_bi"), bg.count(), None


def _coalition_rows(df: DataFrame, key: str, features, background, n_samples: int,
                    seed: int, keep=(), predict=None) -> DataFrame:
    """Permutation-sampling design shared by I4 (sampled) and I8.

    For every explained row and sample m: one background row z (hash of
    (key, m) onto a dense background index — a join, no product) and
    one random feature order (hash rank per (key, m, feature)), in one row:
    ``_tw_x_`` and ``_tw_z_`` hold the values, ``_tw_r_`` each feature's place
    (from 0).  Along one order the contributions telescope, so per sample they
    add up to f(x) − f(z) exactly.  With ``predict``, f(z) is in ``_tw_p0`` and f(x) in ``_tw_p<n>``, scored once for all samples of
    a row.  ``background`` is a frame or what ``_background_rows`` made of one; if it has few distinct rows, the design stays
    in the partitions that the keys have."""
    feats = list(features)
    bg, n_bg, width = _background_rows(background, feats, seed, predict) if isinstance(background, DataFrame) else background
    keys = _row_keys(key)
    kc = [F.col(k) for k in keys]
    if n_bg > _TASK_ROWS:                            # given in full, so that no task gets more rows by Spark's merging of small ones
        df = df.repartition(max(-(-n_bg // _TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys[:-1])
    # rows that share a key stay apart by a number among them
    df = df.withColumn(_COPY, F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(*feats, *keep)))
    rows = df.select(*keys, *keep, *[B.as_double(c).alias(f"_tw_x_{c}") for c in feats])
    rows = _scored_as(rows, feats, "x", len(feats), predict)
    rows = rows.withColumn("_tw_m", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    rows = rows.withColumn("_tw_bi", F.pmod(F.xxhash64(*kc, F.col("_tw_m"), F.lit(seed)), F.lit(n_bg)) + 1)
    if width is None:
        pairs = rows.join(bg, "_tw_bi")
    else:
        pairs = rows.withColumn("_tw_bin", F.floor(F.col("_tw_bi") / width)).join(F.broadcast(bg), "_tw_bin")
        pairs = pairs.where((F.col("_tw_bi") >= F.col("_tw_from")) & (F.col("_tw_bi") <= F.col("_tw_to")))
    ranks = {c: F.struct(F.xxhash64(*kc, F.col("_tw_m"), F.lit(seed), F.lit(c)), F.lit(i)) for i, c in enumerate(feats)}
    place = [sum(((ranks[o] < ranks[c]).cast("int") for o in feats if o != c), F.lit(0)).alias(f"_tw_r_{c}") for c in feats]
    return pairs.select(*keys, *keep, "_tw_m", *[f"_tw_{s}_{c}" for c in feats for s in "xz"],
                        *(["_tw_p0", f"_tw_p{len(feats)}"] if predict else []), *place)


def _prefix_predictions(design: DataFrame, features, predict) -> DataFrame:
    """``design`` with ``_tw_p0`` … ``_tw_p<n>``: the prediction when the first j features of the row's order come from
    the explained row and the rest from the background.  A row keeps all of its predictions: nothing is regrouped."""
    feats = list(features)
    for j in (j for j in range(len(feats) + 1) if f"_tw_p{j}" not in design.columns):
        now = design.withColumns({c: F.when(F.col(f"_tw_r_{c}") < j, F.col(f"_tw_x_{c}")).otherwise(F.col(f"_tw_z_{c}")) for c in feats})
        design = predict(now).withColumnRenamed("prediction", f"_tw_p{j}")
    return design


def _at_place(c: str, n: int, value):
    """``value(j)`` for the place j that feature ``c`` has in the row's order."""
    return F.coalesce(*[F.when(F.col(f"_tw_r_{c}") == j, value(j)) for j in range(n)])


def _difference(a, b):
    """a − b; of a null and a value, the value counts."""
    return F.coalesce(a - b, a, -b)


def sampled_shap(df: DataFrame, key: str, features, predict, background: DataFrame | None = None,
                 n_samples: int = 16, seed: int = 42) -> DataFrame:
    """I4 (any model) — ``key`` is a column or a list of columns; rows that share
    a key get a row of values each.  Permutation-sampling Shapley values with a marginal
    (background) imputer.  ``predict`` maps a frame with the feature columns
    to a frame with ``prediction`` beside its other columns; all rows ×
    samples are scored, the coalitions of an order one after the other in the
    same row, and folded back with ONE groupBy on the key.  With few distinct background rows nothing but the rows
    themselves is shuffled; otherwise the samples of all rows are, in ``n_samples`` slices of the keys one after the other, so
    that the files of one slice, not those of all samples, are held at a time."""
    feats, keys = list(features), _row_keys(key)
    bg = _background_rows(df if background is None else background, feats, seed, predict)
    gain = lambda j: _difference(F.col(f"_tw_p{j + 1}"), F.col(f"_tw_p{j}"))

    def folded(rows):
        scored = _prefix_predictions(_coalition_rows(rows, key, feats, bg, n_samples, seed, predict=predict), feats, predict)
        return scored.groupBy(*keys).agg(*[(F.sum(_at_place(c, len(feats), gain)) / F.lit(float(n_samples))).alias(f"phi_{c}") for c in feats]).drop(_COPY)
    if bg[2] is not None:
        return folded(df)
    out = None
    for i in range(n_samples):
        part = cut_lineage(folded(df.where(F.pmod(F.xxhash64(*keys[:-1]), F.lit(n_samples)) == i)))
        out = part if out is None else out.unionAll(part)
        release(df.sparkSession)
    return out


def sage(df: DataFrame, key: str, features, target: str, predict, background: DataFrame | None = None,
         n_samples: int = 8, seed: int = 42, loss: str = "mse") -> DataFrame:
    """I8 — SAGE-style global Shapley values of the loss: per (row, sample,
    feature) the loss drop when the feature joins its coalition (marginal
    imputer), averaged over all rows; mean and standard error per feature."""
    feats = list(features)
    design = _coalition_rows(df, key, feats, df if background is None else background, n_samples, seed,
                             keep=[target], predict=predict)
    scored = _prefix_predictions(design, feats, predict)
    y = F.col(target).cast("double")
    if loss not in ("mse", "mae"):
        raise ValueError(f"unknown loss {loss}")

    def off(j):
        gap = y - F.col(f"_tw_p{j}")
        return gap * gap if loss == "mse" else F.abs(gap)
    # a row per feature is summed up where it is made
    gains = [F.struct(F.lit(c).alias("_tw_feature"), _at_place(c, len(feats), lambda j: _difference(off(j), off(j + 1))).alias("_tw_gain"))
             for c in feats]
    per = scored.select(F.inline(F.array(*gains)))
    out = per.groupBy(F.col("_tw_feature").alias("feature")).agg(
        F.avg("_tw_gain").alias("sage_value"),
        (F.stddev_samp("_tw_gain") / F.sqrt(F.count(F.lit(1)))).alias("std_error"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sage_value"), "feature")))
