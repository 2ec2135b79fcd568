"""Encoder / scaler / imputer queries (E1–E22) on the driver tables."""

from pyspark.sql import functions as F

from tabwright.catalog import r6, register, table
from tabwright.operators import autoprep as A
from tabwright.operators import kinds as KD
from tabwright.operators import prep as P

_LI_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_KEYS_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _nulled(spark, sf):
    return table(spark, sf, "lineitem").select(*_LI_KEYS, F.expr("nullif(l_discount, 0)").alias("d"),
                                               F.expr("nullif(l_tax, 0)").alias("t"),
                                               F.expr("CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END").alias("f"))


_NULLED = (f"(SELECT {_KEYS_SQL}, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS t, "
           "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS f FROM lineitem)")


@register("impute_mean", f"SELECT {_KEYS_SQL}, round(coalesce(d, (SELECT avg(d) FROM {_NULLED})), 6) AS d, "
          f"round(coalesce(t, (SELECT avg(t) FROM {_NULLED})), 6) AS t, f FROM {_NULLED}")
def q_impute_mean(spark, sf):
    df = _nulled(spark, sf)
    return r6(P.Imputer("mean").fit(df, ["d", "t"]).transform(df))


@register("impute_median_indicator", f"SELECT {_KEYS_SQL}, f, round(coalesce(d, (SELECT quantile_cont(d, 0.5) FROM {_NULLED})), 6) AS d, "
          f"round(coalesce(t, (SELECT quantile_cont(t, 0.5) FROM {_NULLED})), 6) AS t, "
          f"(d IS NULL)::DOUBLE AS missingindicator_d, (t IS NULL)::DOUBLE AS missingindicator_t FROM {_NULLED}")
def q_impute_median(spark, sf):
    df = _nulled(spark, sf)
    return r6(P.Imputer("median", add_indicator=True).fit(df, ["d", "t"]).transform(df))


@register("impute_most_frequent", f"""
SELECT {_KEYS_SQL}, d, t, coalesce(f, (SELECT f FROM {_NULLED} WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)) AS f
FROM {_NULLED}""")
def q_impute_mode(spark, sf):
    df = _nulled(spark, sf)
    return P.Imputer("most_frequent").fit(df, ["f"]).transform(df)


def _scaled_sql(kind):
    cols = []
    for c in _NUM:
        if kind == "standard":
            e = f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM lineitem)"
        elif kind == "minmax":
            e = (f"({c} - (SELECT min({c}) FROM lineitem)) / (SELECT CASE WHEN max({c}) = min({c}) THEN 1 "
                 f"ELSE max({c}) - min({c}) END FROM lineitem)")
        elif kind == "maxabs":
            e = f"{c} / (SELECT max(abs({c})) FROM lineitem)"
        elif kind == "robust":
            e = (f"({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)) / (SELECT CASE WHEN quantile_cont({c}, 0.75) = "
                 f"quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM lineitem)")
        else:
            e = (f"(ln(1 + {c}) - (SELECT avg(ln(1 + {c})) FROM lineitem)) / "
                 f"(SELECT stddev_pop(ln(1 + {c})) FROM lineitem)")
        cols.append(f"round({e}, 6) AS {c}")
    return f"SELECT {_KEYS_SQL}, l_returnflag, {', '.join(cols)} FROM lineitem"


for _k in ("standard", "minmax", "maxabs", "robust", "log_standard"):
    def _mk(kind):
        def q(spark, sf):
            li = table(spark, sf, "lineitem").select(*_LI_KEYS, "l_returnflag", *_NUM)
            return r6(P.Scaler(kind).fit(li, _NUM).transform(li))
        return q
    register(f"scale_{_k}", _scaled_sql(_k))(_mk(_k))


_LV = "(SELECT DISTINCT o_orderpriority AS v FROM orders)"


@register("onehot_encode", """
SELECT o_orderkey, """ + ", ".join(
    f"(o_orderpriority = '{v}')::DOUBLE AS \"o_orderpriority_{v}\"" for v in
    ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + ", (o_orderstatus = 'O')::DOUBLE AS o_orderstatus_O, "
    "(o_orderstatus = 'P')::DOUBLE AS o_orderstatus_P FROM orders")
def q_onehot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return P.OneHotEncoder("first").fit(o, ["o_orderpriority", "o_orderstatus"]).transform(o)


@register("ordinal_encode", """
SELECT c_custkey, c_acctbal, coalesce((SELECT code FROM (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::DOUBLE AS code FROM
  (SELECT DISTINCT c_mktsegment AS v FROM customer)) WHERE v = c_mktsegment), -1.0) AS c_mktsegment,
  coalesce((SELECT code FROM (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::DOUBLE AS code FROM
  (SELECT DISTINCT c_name AS v FROM customer)) WHERE v = c_name), -1.0) AS c_name FROM customer""")
def q_ordinal(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    return P.fit_ordinal(c, ["c_mktsegment", "c_name"]).transform(c)


@register("target_encode", """
WITH g AS (SELECT avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem),
s AS (SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n, avg(l_extendedprice) AS mc, var_pop(l_extendedprice) AS vc
      FROM lineitem GROUP BY 1),
e AS (SELECT value, CASE WHEN n * v + vc = 0 THEN 1.0 ELSE n * v / (n * v + vc) END * mc
              + (1 - CASE WHEN n * v + vc = 0 THEN 1.0 ELSE n * v / (n * v + vc) END) * m AS enc FROM s, g)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(coalesce(e.enc, (SELECT m FROM g)), 6) AS l_suppkey
FROM lineitem LEFT JOIN e ON CAST(l_suppkey AS VARCHAR) = e.value""")
def q_target_encode(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return r6(P.fit_target_encoder(li, ["l_suppkey"], "l_extendedprice").transform(li))


@register("binary_encode", """
WITH c AS (SELECT v, dense_rank() OVER (ORDER BY v) AS code FROM (SELECT DISTINCT c_nationkey::VARCHAR AS v FROM customer))
SELECT c_custkey, """ + ", ".join(f"coalesce(((code >> {4 - i}) & 1)::DOUBLE, 0.0) AS c_nationkey_{i}" for i in range(5)) + """
FROM customer LEFT JOIN c ON c_nationkey::VARCHAR = c.v""")
def q_binary_encode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return P.fit_binary_encoder(c, ["c_nationkey"]).transform(c)


@register("leave_one_out_encode", """
SELECT o_orderkey, o_totalprice, o_orderpriority,
  round(CASE WHEN count(*) OVER (PARTITION BY o_orderpriority) > 1 THEN
    (sum(o_totalprice) OVER (PARTITION BY o_orderpriority) - o_totalprice) / (count(*) OVER (PARTITION BY o_orderpriority) - 1)
    ELSE (SELECT avg(o_totalprice) FROM orders) END, 6) AS o_orderpriority_loo FROM orders""")
def q_loo(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return r6(P.leave_one_out_train(o, ["o_orderpriority"], "o_totalprice"))


_LBL = "(SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l JOIN documents d USING (doc_id))"


@register("woe_encode", f"""
WITH t AS (SELECT sum((quality = 1)::INT) AS p, sum((quality = 0)::INT) AS n FROM {_LBL}),
s AS (SELECT source AS value, sum((quality = 1)::INT) AS pos, sum((quality = 0)::INT) AS neg FROM {_LBL} GROUP BY 1)
SELECT doc_id, quality, round(coalesce(ln(((pos + 1.0) / (p + 2.0)) / ((neg + 1.0) / (n + 2.0))), 0.0), 6) AS source
FROM {_LBL} x LEFT JOIN s ON x.source = s.value, t""")
def q_woe(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "quality", "source")
    return r6(P.fit_woe(lab, ["source"], "quality").transform(lab))


@register("detect_column_types", """
SELECT * FROM (VALUES ('l_quantity', 'numeric_normal'), ('l_extendedprice', 'numeric_normal'),
  ('l_discount', 'numeric_normal'), ('l_tax', 'numeric_normal'), ('l_returnflag', 'category_low'),
  ('l_linestatus', 'binary'), ('l_shipdate', 'datetime'), ('e', 'numeric_log'), ('one', 'constant')) AS t(col_name, col_type)""")
def q_detect_types(spark, sf):
    li = table(spark, sf, "lineitem").select(*_NUM, "l_returnflag", "l_linestatus", "l_shipdate",
                                             F.exp(F.col("l_extendedprice") / 20000.0).alias("e"),
                                             F.lit(1).alias("one"))
    return KD.detect_column_types(li).select("col_name", "col_type")


_AUTO_SQL = f"""
SELECT {_KEYS_SQL},
""" + ",\n".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM lineitem), 6) AS num_normal__{c}"
    for c in _NUM) + """,
  (l_linestatus = 'O')::DOUBLE AS binary__l_linestatus,
  (l_returnflag = 'N')::DOUBLE AS cat_low__l_returnflag_N, (l_returnflag = 'R')::DOUBLE AS cat_low__l_returnflag_R
FROM lineitem"""


@register("auto_preprocess", _AUTO_SQL)
def q_auto_preprocess(spark, sf):
    li = table(spark, sf, "lineitem").select(*_LI_KEYS, *_NUM, "l_returnflag", "l_linestatus")
    m = A.AutoPreprocessor().fit(li, keep=_LI_KEYS)
    return r6(m.transform(li))


@register("column_preprocess", f"""
SELECT {_KEYS_SQL},
""" + ",\n".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM lineitem), 6) AS numeric__{c}"
    for c in _NUM) + """,
  (l_linestatus = 'O')::DOUBLE AS binary__l_linestatus,
  coalesce((SELECT code FROM (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::DOUBLE AS code FROM
    (SELECT DISTINCT l_returnflag AS v FROM lineitem)) WHERE v = l_returnflag), -1.0) AS cat_high__l_returnflag
FROM lineitem""")
def q_column_preprocess(spark, sf):
    li = table(spark, sf, "lineitem").select(*_LI_KEYS, *_NUM, "l_returnflag", "l_linestatus")
    cfg = A.ColPreprocessConfig(override_types={"l_returnflag": "category_high"})
    return r6(A.fit_column_preprocess(li, cfg, keep=_LI_KEYS).transform(li))
