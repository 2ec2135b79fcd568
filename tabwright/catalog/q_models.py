"""Proximity, imputation, skyline, encoder and fold queries whose operators have plans of their own."""

from pyspark.sql import functions as F

from tabwright.catalog import r6, register, table

TREES = 16


@register("forest_proximity_pairs", f"""
WITH leaves AS (SELECT vec_id AS id, list_transform(range({TREES}), lambda t: 2 * (embedding[2 * t + 1] > 0)::INT + (embedding[2 * t + 2] > 0)::INT) AS leaves
                FROM embeddings),
classes AS (SELECT leaves, min(id) AS rep, count(*) AS n FROM leaves GROUP BY leaves),
pairs AS (SELECT a.rep AS id_a, b.rep AS id_b, a.n AS n_a, b.n AS n_b,
                 len(list_filter(range({TREES}), lambda t: a.leaves[t + 1] = b.leaves[t + 1])) AS same
          FROM classes a JOIN classes b ON a.rep < b.rep)
SELECT id_a, id_b, round(same / {TREES}.0, 6)::DOUBLE AS proximity, n_a, n_b FROM pairs WHERE same >= 0.75 * {TREES}""")
def q_forest_proximity(spark, sf):
    """L3 over given trees: each splits by the signs of two coordinates."""
    from tabwright.plans.proximity import proximity_pairs
    sign = lambda i: (F.get("embedding", F.lit(i)) > 0).cast("int")
    leaves = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"),
                                                   F.array(*[2 * sign(2 * t) + sign(2 * t + 1) for t in range(TREES)]).alias("leaves"))
    return r6(proximity_pairs(leaves, 0.75)[0])


def _beaten(better):
    """SQL: whether point o is at least as good as point p throughout and not the same."""
    return " AND ".join(f"o.{c} {'<=' if d == 'min' else '>='} p.{c}" for c, d in better.items()) \
        + " AND (" + " OR ".join(f"o.{c} <> p.{c}" for c in better) + ")"


def _skyline_sql(t, keep, better):
    cols = ", ".join(better)
    return f"""
WITH points AS (SELECT DISTINCT {cols} FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in better)}),
front AS (SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE {_beaten(better)}))
SELECT {', '.join(keep)}, {cols} FROM {t} JOIN front USING ({cols})"""


THREE = {"l_extendedprice": "min", "l_quantity": "max", "l_discount": "max"}
FOUR = {"l_extendedprice": "min", "l_quantity": "max", "l_discount": "max", "l_tax": "min"}


@register("skyline_3d", _skyline_sql("lineitem", ["l_orderkey", "l_linenumber"], THREE))
def q_skyline_3d(spark, sf):
    from tabwright.operators.search import skyline
    return skyline(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *THREE), THREE)


@register("skyline_4d", _skyline_sql("lineitem", ["l_orderkey", "l_linenumber"], FOUR))
def q_skyline_4d(spark, sf):
    from tabwright.operators.search import skyline
    return skyline(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *FOUR), FOUR)


def _gaps(num):
    return f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN {num('o_totalprice')} / 5000 END AS price,
       CASE WHEN o_orderkey % 5 <> 1 THEN {num('o_custkey')} END AS cust, {num('substr(o_orderpriority, 1, 1)')} * 10 AS prio FROM orders"""


GAPPED = ("price", "cust", "prio")


def _knn_sql(cols, k=5):
    both = lambda c: f"(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)"
    count = " + ".join(f"{both(c)}::INT" for c in cols)
    square = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in cols)
    order = ", ".join(f"d{c} NULLS FIRST" for c in cols)
    own, same = ", ".join(cols), lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)
    sql = f"""
WITH t AS ({_gaps(lambda x: f'({x})::DOUBLE')}),
d AS (SELECT {own}, count(*) AS n FROM t GROUP BY {own}),
q AS (SELECT {own} FROM d WHERE {' OR '.join(f'{c} IS NULL' for c in cols)})"""
    for t in cols:
        sql += f""",
near_{t} AS (SELECT q.*, d.{t} AS val, d.n, {len(cols)}::DOUBLE / ({count}) * ({square}) AS dist, {', '.join(f'd.{c} AS d{c}' for c in cols)}
             FROM q, d WHERE q.{t} IS NULL AND d.{t} IS NOT NULL AND {count} > 0),
first_{t} AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {own} ORDER BY dist, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM (SELECT * FROM near_{t} QUALIFY row_number() OVER (PARTITION BY {own} ORDER BY dist, {order}) <= {k})),
fill_{t} AS (SELECT {own}, sum(val * least(n, {k} - before)) / sum(least(n, {k} - before)) AS f FROM first_{t} WHERE before < {k} GROUP BY {own})"""
    return sql + f"""
SELECT o_orderkey, {', '.join(f'round(coalesce(t.{c}, fill_{c}.f, (SELECT avg({c}) FROM t)), 6) AS {c}' for c in cols)}
FROM t {' '.join(f'LEFT JOIN fill_{c} ON {same("t", f"fill_{c}")}' for c in cols)}"""


@register("knn_impute", _knn_sql(GAPPED))
def q_knn_impute(spark, sf):
    """E3 over orders with gaps in two columns, at times in both."""
    from tabwright.operators.prep import Imputer
    o = table(spark, sf, "orders")
    num = lambda c: c.cast("double")
    t = o.select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, num(F.col("o_totalprice")) / 5000).alias("price"),
                 F.when(F.col("o_orderkey") % 5 != 1, num(F.col("o_custkey"))).alias("cust"), (num(F.substring("o_orderpriority", 1, 1)) * 10).alias("prio"))
    return r6(Imputer("knn").fit(t, GAPPED).transform(t))


@register("cross_fit_target_encode", """
WITH li AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS y, l_orderkey % 5 AS fold FROM lineitem),
f AS (SELECT i AS fold, (SELECT avg(y) FROM li WHERE fold <> i) AS m, (SELECT var_pop(y) FROM li WHERE fold <> i) AS v FROM range(5) r(i)),
e AS (SELECT f.fold, l_suppkey, count(*) AS n, avg(y) AS mc, var_pop(y) AS vc FROM li JOIN f ON f.fold <> li.fold GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, round(coalesce((e.n * f.v * e.mc + e.vc * f.m) / (e.n * f.v + e.vc), f.m), 4) AS l_suppkey_enc
FROM li JOIN f USING (fold) LEFT JOIN e USING (fold, l_suppkey)""")
def q_cross_fit_target(spark, sf):
    from tabwright.operators.prep import cross_fit_target_encode
    li = table(spark, sf, "lineitem").withColumn("fold", F.col("l_orderkey") % 5)
    out = cross_fit_target_encode(li, ["l_suppkey"], "l_extendedprice", "fold")
    return out.select("l_orderkey", "l_linenumber", F.round("l_suppkey_enc", 4).alias("l_suppkey_enc"))


@register("onehot_many_levels", """
WITH levels AS (SELECT o_custkey::VARCHAR AS value, row_number() OVER (ORDER BY o_custkey::VARCHAR) AS p, count(*) OVER () AS k
                FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, (k - 1)::INT AS size, CASE WHEN p = 1 THEN k - 1 ELSE p - 2 END::DOUBLE AS code
FROM orders JOIN levels ON value = o_custkey::VARCHAR""")
def q_onehot_many(spark, sf):
    """E13 as sparse vectors: the position that is set in each order's vector."""
    from tabwright.operators.prep import OneHotEncoder
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    model = OneHotEncoder(inline_limit=0).fit(o, ["o_custkey"])
    return model.codes(o, "o_custkey", "code").select("o_orderkey", F.lit(model.sizes["o_custkey"]).alias("size"), "code")


@register("stratified_group_kfold", """
SELECT o_custkey, 1::BIGINT AS n_folds, count(*) AS n FROM orders GROUP BY o_custkey""")
def q_stratified_group_kfold(spark, sf):
    """C4: every group whole in one fold."""
    from tabwright.operators.split import stratified_group_kfold
    o = table(spark, sf, "orders")
    got = stratified_group_kfold(o, "o_orderkey", "o_custkey", "o_orderstatus").join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
    return got.groupBy("o_custkey").agg(F.count_distinct("fold").alias("n_folds"), F.count(F.lit(1)).alias("n"))
