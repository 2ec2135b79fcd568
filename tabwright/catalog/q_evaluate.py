"""Evaluation queries (V4–V8, V12–V14, V19) over predictions and fold scores
derived from the driver tables."""

from pyspark.sql import functions as F

from tabwright.catalog import r6, register, table
from tabwright.operators import evaluate as EV
from tabwright.operators import split as S
from tabwright.plans.cv import fold_ols_scores

_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _fold_scores(spark, sf):
    folds = S.kfold(table(spark, sf, "orders"), "o_orderkey", 5, shuffle=False)
    li = table(spark, sf, "lineitem").join(folds.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return fold_ols_scores(li, "fold", _FEATS, "l_extendedprice")


_KF = ("(SELECT o_orderkey, CASE WHEN pos - 1 < (n % 5) * (n // 5 + 1) THEN (pos - 1) // (n // 5 + 1) "
       "ELSE (n % 5) + (pos - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM "
       "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos, count(*) OVER () AS n FROM orders))")
_SCORES_CTE = f"""
d AS (SELECT l.*, f.fold FROM lineitem l JOIN {_KF} f ON l.l_orderkey = f.o_orderkey),
lg AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS model, {c} AS x, l_extendedprice AS y, fold AS split_id FROM d" for c in _FEATS) + """),
s AS (SELECT model, split_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy FROM lg GROUP BY 1, 2),
t AS (SELECT model, sum(n) AS tn, sum(sx) AS tsx, sum(sy) AS tsy, sum(sxx) AS tsxx, sum(sxy) AS tsxy FROM s GROUP BY 1),
c AS (SELECT model, split_id, tn - n AS n, tsx - sx AS sx, tsy - sy AS sy, tsxx - sxx AS sxx, tsxy - sxy AS sxy FROM s JOIN t USING (model)),
co AS (SELECT model, split_id, CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0 END AS b, sx, sy, n FROM c),
cf AS (SELECT model, split_id, b, (sy - b * sx) / n AS a FROM co),
scores AS (SELECT lg.model, lg.split_id, sqrt(avg((y - (a + b * x)) ^ 2)) AS score,
                  1 - sum((y - (a + b * x)) ^ 2) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2, count(*) AS n_test
           FROM lg JOIN cf USING (model, split_id) GROUP BY 1, 2)"""


@register("cv_fold_scores", f"WITH {_SCORES_CTE} SELECT model, split_id::INT AS split_id, round(score, 6) AS score, "
          "round(r2, 6) AS r2, n_test FROM scores")
def q_cv_scores(spark, sf):
    return r6(_fold_scores(spark, sf).select("model", F.col("split_id").cast("int"), "score", "r2", "n_test"))


@register("leaderboard", f"""WITH {_SCORES_CTE}
SELECT model, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS n_folds,
       row_number() OVER (ORDER BY avg(score), model) AS rank FROM scores GROUP BY model""")
def q_leaderboard(spark, sf):
    return r6(EV.leaderboard(_fold_scores(spark, sf), higher_is_better=False))


@register("paired_model_test", f"""WITH {_SCORES_CTE},
best AS (SELECT model AS bm FROM scores GROUP BY model ORDER BY avg(score), model LIMIT 1),
j AS (SELECT best.bm AS best_model, o.model AS vs_model, b.score - o.score AS d FROM scores o JOIN scores b ON o.split_id = b.split_id
      JOIN best ON b.model = best.bm WHERE o.model <> best.bm)
SELECT best_model, vs_model, count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_stat,
       round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) ELSE 0 END, 6) AS cohens_d,
       CASE WHEN abs(avg(d) / stddev_samp(d)) > 0.8 THEN 'large' WHEN abs(avg(d) / stddev_samp(d)) > 0.5 THEN 'medium' ELSE 'small' END AS effect
FROM j GROUP BY 1, 2""")
def q_paired(spark, sf):
    return r6(EV.paired_model_test(_fold_scores(spark, sf), higher_is_better=False).drop("p_value"))


@register("score_stability", f"""WITH {_SCORES_CTE}
SELECT model, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(stddev_pop(score) / abs(avg(score)), 6) AS cv,
       CASE WHEN stddev_pop(score) / abs(avg(score)) < 0.05 THEN 'stable' WHEN stddev_pop(score) / abs(avg(score)) < 0.15 THEN 'moderate'
            ELSE 'unstable' END AS band FROM scores GROUP BY model""")
def q_stability(spark, sf):
    return r6(EV.score_stability(_fold_scores(spark, sf)))


@register("cv_bias_tibshirani", f"""WITH {_SCORES_CTE},
m AS (SELECT model, avg(score) AS m FROM scores GROUP BY model),
b AS (SELECT model AS bm, m AS raw_score FROM m ORDER BY m, model LIMIT 1),
own AS (SELECT split_id, min(score) AS own FROM scores GROUP BY split_id),
atb AS (SELECT split_id, score AS atb FROM scores JOIN b ON model = bm)
SELECT 'tibshirani' AS method, round(min(raw_score), 6) AS raw_score, round(avg(atb - own), 6) AS bias_estimate,
       round(min(raw_score) + avg(atb - own), 6) AS corrected_score, count(*) AS n_folds, 3 AS n_params
FROM own JOIN atb USING (split_id), b""")
def q_cv_bias(spark, sf):
    sc = _fold_scores(spark, sf).withColumnRenamed("model", "param_id")
    return r6(EV.cv_bias_tibshirani(sc, "split_id", "param_id", "score", higher_is_better=False))


_PRED = ("(SELECT l_extendedprice AS y_true, regr_intercept(l_extendedprice, l_quantity) OVER () + "
         "regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity AS y_pred FROM lineitem)")


def _pred(spark, sf):
    li = table(spark, sf, "lineitem")
    co = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    return li.crossJoin(F.broadcast(co)).select(F.col("l_extendedprice").alias("y_true"),
                                                (F.col("a") + F.col("b") * F.col("l_quantity")).alias("y_pred"))


@register("regression_metrics", f"""
SELECT round(sqrt(avg((y_true - y_pred) ^ 2)), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae,
       round(1 - sum((y_true - y_pred) ^ 2) / (sum(y_true * y_true) - sum(y_true) * sum(y_true) / count(*)), 6) AS r2, count(*) AS n
FROM {_PRED}""")
def q_regression_metrics(spark, sf):
    return r6(EV.regression_metrics(_pred(spark, sf)))


@register("residual_analysis", f"""
WITH r AS (SELECT y_true - y_pred AS r, y_true AS y FROM {_PRED}),
s AS (SELECT avg(r) AS mean, stddev_samp(r) AS std, count(r) AS n, max(abs(r)) AS max_abs,
             avg(CASE WHEN y <> 0 THEN abs(r / y) END) AS mape,
             avg(r * r) - avg(r) * avg(r) AS m2 FROM r),
mom AS (SELECT avg((r - mean) ^ 3) AS m3, avg((r - mean) ^ 4) AS m4 FROM r, s)
SELECT n, round(mean, 4) AS mean, round(std, 6) AS std, round(max_abs, 6) AS max_abs, round(mape, 6) AS mape,
       round((SELECT avg((abs(r - mean) > 2 * std)::DOUBLE) FROM r, s), 6) AS share_beyond_2sd,
       round(n / 6.0 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / m2 ^ 2 - 3) ^ 2 / 4), 6) AS jarque_bera FROM s, mom""")
def q_residuals(spark, sf):
    out = EV.residual_analysis(_pred(spark, sf))
    return r6(out.withColumn("mean", F.round("mean", 4)))


_CLS = "(SELECT l.quality AS y_true, (d.n_chars > 3000)::INT AS y_pred, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id))"


def _cls(spark, sf):
    return (table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
            .select(F.col("quality").alias("y_true"), (F.col("n_chars") > 3000).cast("int").alias("y_pred"),
                    F.col("n_chars").alias("score")))


@register("roc_auc", f"""
WITH r AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM {_CLS})
SELECT round((sum(CASE WHEN y_true = 1 THEN rk END) - sum(y_true) * (sum(y_true) + 1) / 2.0)
             / (sum(y_true) * sum(1 - y_true)), 6) AS roc_auc, sum(y_true) AS n_pos, sum(1 - y_true) AS n_neg FROM r""")
def q_roc_auc(spark, sf):
    return r6(EV.roc_auc(_cls(spark, sf), "y_true", "score", 1))


@register("class_report", f"""
WITH c AS (SELECT y_true::VARCHAR AS t, y_pred::VARCHAR AS p FROM {_CLS}),
lv AS (SELECT t AS label FROM c UNION SELECT p FROM c)
SELECT label, (SELECT count(*) FROM c WHERE t = label) AS support,
  round(coalesce((SELECT count(*) FILTER (WHERE t = p)::DOUBLE / nullif(count(*), 0) FROM c WHERE p = label), 0), 6) AS precision,
  round(coalesce((SELECT count(*) FILTER (WHERE t = p)::DOUBLE / nullif(count(*), 0) FROM c WHERE t = label), 0), 6) AS recall,
  round(coalesce((SELECT 2.0 * count(*) FILTER (WHERE t = p AND t = label) / nullif(count(*) FILTER (WHERE t = label) + count(*) FILTER (WHERE p = label), 0) FROM c), 0), 6) AS f1
FROM lv""")
def q_class_report(spark, sf):
    return r6(EV.class_report(_cls(spark, sf)))


@register("confusion_counts", f"SELECT y_true::VARCHAR AS true_label, y_pred::VARCHAR AS pred_label, count(*) AS n FROM {_CLS} GROUP BY 1, 2")
def q_confusion(spark, sf):
    return EV.confusion_counts(_cls(spark, sf))


@register("classification_metrics", f"""
WITH c AS (SELECT y_true::VARCHAR AS t, y_pred::VARCHAR AS p FROM {_CLS}),
lv AS (SELECT t AS label FROM c UNION SELECT p FROM c),
r AS (SELECT label, (SELECT count(*) FROM c WHERE t = label) AS support,
  coalesce((SELECT count(*) FILTER (WHERE t = p)::DOUBLE / nullif(count(*), 0) FROM c WHERE p = label), 0) AS pr,
  coalesce((SELECT count(*) FILTER (WHERE t = p)::DOUBLE / nullif(count(*), 0) FROM c WHERE t = label), 0) AS re FROM lv)
SELECT round((SELECT avg((t = p)::DOUBLE) FROM c), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision_weighted,
       round(sum(re * support) / sum(support), 6) AS recall_weighted,
       round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support), 6) AS f1_weighted FROM r""")
def q_cls_metrics(spark, sf):
    return r6(EV.classification_metrics(_cls(spark, sf)))
