"""Split queries."""

from pyspark.sql import functions as F

from tabwright.catalog import register, table
from tabwright.operators import split as S


def _kfold_sql(pos_sql, n_expr, k=5):
    return (f"CASE WHEN pos - 1 < ({n_expr} % {k}) * ({n_expr} // {k} + 1) THEN (pos - 1) // ({n_expr} // {k} + 1) "
            f"ELSE ({n_expr} % {k}) + (pos - 1 - ({n_expr} % {k}) * ({n_expr} // {k} + 1)) // ({n_expr} // {k}) END")


_KF = ("(SELECT o_orderkey, " + _kfold_sql("pos", "(SELECT count(*) FROM orders)") +
       " AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders))")


@register("kfold", f"SELECT o_orderkey, fold::INT AS fold FROM {_KF}")
def q_kfold(spark, sf):
    return S.kfold(table(spark, sf, "orders"), "o_orderkey", 5, shuffle=False)


@register("kfold_long", f"""
SELECT o_orderkey, s AS split_id, CASE WHEN fold = s THEN 'test' ELSE 'train' END AS role
FROM {_KF}, range(5) r(s)""")
def q_kfold_long(spark, sf):
    f = S.kfold(table(spark, sf, "orders"), "o_orderkey", 5, shuffle=False)
    return S.to_long(f, "o_orderkey", 5).select("o_orderkey", F.col("split_id").cast("bigint"), "role")


@register("stratified_kfold", """
SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5)::INT AS fold FROM labels""")
def q_strat(spark, sf):
    return S.stratified_kfold(table(spark, sf, "labels"), "doc_id", "quality", 5, shuffle=False)


@register("leave_one_group_out", """
SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS fold FROM orders""")
def q_logo(spark, sf):
    return S.leave_one_group_out(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority")


@register("leave_one_out", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS fold FROM customer")
def q_loo(spark, sf):
    return S.leave_one_out(table(spark, sf, "customer"), "c_custkey")


@register("time_series_split", """
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p0, count(*) OVER () AS n FROM orders),
b AS (SELECT s AS split_id, n - (5 - s) * (n // 6) AS train_end, n - (5 - s) * (n // 6) AS test_start,
             n - (5 - s - 1) * (n // 6) AS test_end FROM (SELECT DISTINCT n FROM p), range(5) r(s))
SELECT o_orderkey, split_id::INT AS split_id, CASE WHEN p0 < train_end THEN 'train' ELSE 'test' END AS role
FROM p, b WHERE p0 < train_end OR (p0 >= test_start AND p0 < test_end)""")
def q_tss(spark, sf):
    o = table(spark, sf, "orders")
    return S.time_series_split(o, "o_orderkey", ["o_orderdate", "o_orderkey"], 5)


@register("walk_forward", """
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p0, count(*) OVER () AS n FROM events),
m AS (SELECT DISTINCT n, n // 6 AS mt, (n - n // 6 - 3) // 5 AS t FROM p),
b AS (SELECT s AS split_id, mt + s * t AS train_end, mt + s * t + 3 AS test_start, mt + s * t + 3 + t AS test_end
      FROM m, range(5) r(s) WHERE mt + s * t + 3 + t <= n)
SELECT event_id, split_id::INT AS split_id, CASE WHEN p0 < train_end THEN 'train' ELSE 'test' END AS role
FROM p, b WHERE p0 < train_end OR (p0 >= test_start AND p0 < test_end)""")
def q_walk_forward(spark, sf):
    return S.walk_forward(table(spark, sf, "events"), "event_id", ["ts", "event_id"], 5, gap=3)


@register("predefined_split", "SELECT c_custkey, (CASE WHEN c_nationkey % 6 = 5 THEN -1 ELSE c_nationkey % 6 END)::INT AS fold FROM customer")
def q_predefined(spark, sf):
    c = table(spark, sf, "customer").withColumn("f", F.expr("CASE WHEN c_nationkey % 6 = 5 THEN -1 ELSE c_nationkey % 6 END"))
    return S.predefined(c, "c_custkey", "f")


@register("group_kfold")
def q_group_kfold(spark, sf):
    return S.group_kfold(table(spark, sf, "orders"), "o_orderkey", "o_custkey", 5)


@register("shuffle_split")
def q_shuffle_split(spark, sf):
    return S.shuffle_split(table(spark, sf, "orders"), "o_orderkey", 5, 0.2, seed=42)


@register("repeated_stratified_kfold")
def q_repeated(spark, sf):
    return S.repeated_kfold(table(spark, sf, "labels"), "doc_id", 5, 3, seed=42, label="quality")
