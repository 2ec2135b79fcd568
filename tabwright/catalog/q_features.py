"""Feature queries (G13/J1, F1–F4, W1/W2/W5, E24/E25) and the flagship query."""

import math

from pyspark.sql import functions as F

from tabwright.catalog import r6, register, table
from tabwright.functions import scalar as S
from tabwright.functions.boundary import nan_to_null
from tabwright.operators import clean as C
from tabwright.operators import features as FE
from tabwright.operators import profile as P

_GRP_SQL = """
SELECT l.*, coalesce(g.m_q, 0) AS grp_l_suppkey_l_quantity_mean, coalesce(g.s_q, 0) AS grp_l_suppkey_l_quantity_std,
       coalesce(g.m_p, 0) AS grp_l_suppkey_l_extendedprice_mean, coalesce(g.s_p, 0) AS grp_l_suppkey_l_extendedprice_std
FROM {src} l LEFT JOIN (SELECT l_suppkey, avg(l_quantity) AS m_q, stddev_samp(l_quantity) AS s_q,
                               avg(l_extendedprice) AS m_p, stddev_samp(l_extendedprice) AS s_p
                        FROM {src} GROUP BY l_suppkey) g USING (l_suppkey)"""


@register("group_agg_features", "SELECT * REPLACE (round(grp_l_suppkey_l_quantity_mean, 6) AS grp_l_suppkey_l_quantity_mean, "
          "round(grp_l_suppkey_l_quantity_std, 6) AS grp_l_suppkey_l_quantity_std, "
          "round(grp_l_suppkey_l_extendedprice_mean, 6) AS grp_l_suppkey_l_extendedprice_mean, "
          "round(grp_l_suppkey_l_extendedprice_std, 6) AS grp_l_suppkey_l_extendedprice_std, "
          "round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, "
          "round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax) FROM ("
          + _GRP_SQL.format(src="lineitem") + ")")
def q_group_agg(spark, sf):
    li = table(spark, sf, "lineitem")
    return r6(FE.group_agg_features(li, "l_suppkey", ["l_quantity", "l_extendedprice"], ["mean", "std"]))


_TAU = 2 * math.pi
_DT = ("year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, hour(o_orderdate) AS hour, "
       "minute(o_orderdate) AS minute, isodow(o_orderdate) - 1 AS dayofweek, dayofyear(o_orderdate) AS dayofyear, "
       "weekofyear(o_orderdate) AS weekofyear, quarter(o_orderdate) AS quarter, "
       "(isodow(o_orderdate) - 1 >= 5)::INT AS is_weekend, (day(o_orderdate) = 1)::INT AS is_month_start, "
       "(o_orderdate::DATE = last_day(o_orderdate))::INT AS is_month_end, "
       f"round(sin({_TAU} * month(o_orderdate) / 12), 6) AS month_sin, round(cos({_TAU} * month(o_orderdate) / 12), 6) AS month_cos, "
       f"round(sin({_TAU} * hour(o_orderdate) / 24), 6) AS hour_sin, round(cos({_TAU} * hour(o_orderdate) / 24), 6) AS hour_cos, "
       f"round(sin({_TAU} * (isodow(o_orderdate) - 1) / 7), 6) AS dow_sin, round(cos({_TAU} * (isodow(o_orderdate) - 1) / 7), 6) AS dow_cos")


@register("datetime_features", f"SELECT o_orderkey, {_DT} FROM orders")
def q_datetime(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return r6(FE.datetime_features(o, "o_orderdate").drop("o_orderdate"))


def _lag_sql(tbl, key, part, order, val, prefix):
    w = f"PARTITION BY {part} ORDER BY {order}"
    cols = [f"coalesce(lag({val}, {k}) OVER ({w}), 0) AS {prefix}_lag{k}" for k in (1, 2, 3)]
    for win in (3, 7):
        fr = f"({w} ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"round(coalesce(avg({val}) OVER {fr}, 0), 6) AS {prefix}_roll{win}_mean")
        cols.append(f"round(coalesce(stddev_samp({val}) OVER {fr}, 0), 6) AS {prefix}_roll{win}_std")
    return f"SELECT {key}, {', '.join(cols)} FROM {tbl}"


@register("lag_rolling_orders", _lag_sql("orders", "o_orderkey", "o_custkey", "o_orderdate, o_orderkey",
                                         "o_totalprice", "o_totalprice"))
def q_lag_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = FE.lag_rolling_features(o, ["o_totalprice"], ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return r6(out.drop("o_custkey", "o_orderdate", "o_totalprice"))


@register("lag_rolling_events", _lag_sql("events", "event_id", "user_id", "ts, event_id", "value", "value"))
def q_lag_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    # small buckets so that the bucket-carry path is exercised at every scale
    out = FE.lag_rolling_features(e, ["value"], ["ts", "event_id"], ["user_id"], bucket_rows=997)
    return r6(out.drop("user_id", "ts", "value"))


@register("best_so_far", """
SELECT o_orderkey, round(min(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
       AS best_so_far FROM orders""")
def q_best_so_far(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return r6(FE.best_so_far(o, "o_totalprice", ["o_orderdate", "o_orderkey"], "min").select("o_orderkey", "best_so_far"))


@register("polynomial_features", """
SELECT p_partkey, 1.0 AS "1", p_size::DOUBLE AS p_size, p_retailprice AS p_retailprice,
       round(p_size::DOUBLE * p_size, 6) AS "p_size^2", round(p_size * p_retailprice, 6) AS "p_size p_retailprice",
       round(p_retailprice * p_retailprice, 6) AS "p_retailprice^2" FROM part""")
def q_poly(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return r6(FE.polynomial_features(p, ["p_size", "p_retailprice"], 2, interaction_only=False,
                                     include_bias=True, keep_input=True))


@register("interaction_features", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
       round(l_quantity * l_discount, 6) AS "l_quantity l_discount", round(l_quantity * l_tax, 6) AS "l_quantity l_tax",
       round(l_discount * l_tax, 6) AS "l_discount l_tax", round(l_quantity * l_discount * l_tax, 6) AS "l_quantity l_discount l_tax"
FROM lineitem""")
def q_interactions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             "l_quantity", "l_discount", "l_tax")
    return r6(FE.polynomial_features(li, ["l_quantity", "l_discount", "l_tax"], 3, interaction_only=True,
                                     keep_input=True))


@register("log_periodic_transform", f"""
SELECT o_orderkey, round(ln(1 + (o_totalprice + 0.0)), 6) AS log_price,
       round(exp(ln(1 + o_totalprice)) - 1, 4) AS price_back,
       round(sin({_TAU} * month(o_orderdate) / 12), 6) AS m_sin, round(cos({_TAU} * month(o_orderdate) / 12), 6) AS m_cos
FROM orders""")
def q_log_periodic(spark, sf):
    o = table(spark, sf, "orders")
    s, c = S.periodic(F.month("o_orderdate"), 12)
    return r6(o.select("o_orderkey", S.log_transform("o_totalprice", 1.0).alias("log_price"),
                       F.round(S.inverse_log_transform(S.log_transform("o_totalprice"), 1.0), 4).alias("price_back"),
                       s.alias("m_sin"), c.alias("m_cos")))


_FLAG_NUM = ["l_quantity", "l_discount", "l_tax", "grp_l_suppkey_l_quantity_mean", "grp_l_suppkey_l_quantity_std",
             "grp_l_suppkey_l_extendedprice_mean", "grp_l_suppkey_l_extendedprice_std"]
_FLAG_SRC = """(SELECT l_suppkey, l_quantity, l_discount, l_tax,
   CASE WHEN q3 - q1 = 0 THEN l_extendedprice ELSE least(greatest(l_extendedprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END
   AS l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem))"""


def flagship(spark, sf):
    """read → NaN boundary → exact-IQR clip → per-supplier stats joined back → |r| top 10."""
    li = nan_to_null(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax",
                                                          "l_extendedprice"))
    clipped, _ = C.clip_outliers(li, 1.5, ["l_extendedprice"])
    feats = FE.group_agg_features(clipped, "l_suppkey", ["l_quantity", "l_extendedprice"], ["mean", "std"])
    return r6(P.correlate_with_target(feats, "l_extendedprice", _FLAG_NUM, top_n=10))


register("flagship", f"""
WITH f AS ({_GRP_SQL.format(src=_FLAG_SRC)})
SELECT col_name, abs_corr, rank FROM (
  SELECT col_name, abs_corr, row_number() OVER (ORDER BY abs_corr DESC, col_name) AS rank FROM (
""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS col_name, round(abs(corr({c}, l_extendedprice)), 6) AS abs_corr FROM f"
                            for c in _FLAG_NUM) + ") WHERE abs_corr IS NOT NULL AND NOT isnan(abs_corr)) WHERE rank <= 10")(flagship)
