"""Profiling queries (G1–G21) on the driver tables."""

from pyspark.sql import functions as F

from tabwright.catalog import r6, register, table
from tabwright.operators import profile as P

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _stats_sql(tbl, num, strs):
    parts = []
    for c in num:
        parts.append(
            f"SELECT '{c}' AS col_name, 'double' AS dtype, count(*) AS n_total, count(*) - count({c}) AS n_null, "
            f"round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_rate, count(DISTINCT {c}) AS n_unique, "
            f"round(avg({c}), 5) AS mean, round(coalesce(stddev_samp({c}), 0), 6) AS std, round(min({c}), 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max, "
            f"round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurt FROM {tbl}")
    for c in strs:
        parts.append(
            f"SELECT '{c}' AS col_name, 'string' AS dtype, count(*) AS n_total, count(*) - count({c}) AS n_null, "
            f"round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_rate, count(DISTINCT {c}) AS n_unique, "
            + ", ".join(f"NULL::DOUBLE AS {f}" for f in ("mean", "std", "min", "p25", "p50", "p75", "max", "skew", "kurt"))
            + f" FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


@register("column_stats", _stats_sql("lineitem", LI_NUM, ["l_returnflag", "l_linestatus"]))
def q_column_stats(spark, sf):
    li = table(spark, sf, "lineitem")
    # means of two-decimal columns can end in an exact 5 at the seventh place, where the last bit decides: 5 places
    got = P.column_stats(li, LI_NUM + ["l_returnflag", "l_linestatus"])
    return r6(got.withColumn("mean", F.round("mean", 5)))


@register("top_values", """
SELECT col_name, value, count, rank FROM (
  SELECT col_name, value, count, row_number() OVER (PARTITION BY col_name ORDER BY count DESC, value) AS rank
  FROM (SELECT 'o_orderstatus' AS col_name, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)) WHERE rank <= 5""")
def q_top_values(spark, sf):
    return P.top_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], 5)


@register("table_summary", """
SELECT count(*) AS n_rows, 6 AS n_cols, 3 AS n_numeric, 2 AS n_categorical, 1 AS n_datetime,
       0.0 AS total_null_rate, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS n_duplicates
FROM orders""")
def q_table_summary(spark, sf):
    return r6(P.table_summary(table(spark, sf, "orders")))


@register("describe", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS col_name, count({c}) AS count, round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS std, "
    f"round(min({c}),6) AS min, round(quantile_cont({c},0.25),6) AS p25, round(quantile_cont({c},0.5),6) AS p50, "
    f"round(quantile_cont({c},0.75),6) AS p75, round(max({c}),6) AS max FROM customer" for c in ["c_acctbal"]))
def q_describe(spark, sf):
    return r6(P.describe(table(spark, sf, "customer"), ["c_acctbal"]))


_COERCE = "(SELECT json_extract_string(props, '$.k') AS props_k, event_type, value FROM events)"


@register("coerced_summary", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS col_name, count(DISTINCT TRY_CAST({c} AS DOUBLE)) AS n_distinct, "
    f"count(*) - count(TRY_CAST({c} AS DOUBLE)) AS n_missing, "
    f"round(100.0 * (count(*) - count(TRY_CAST({c} AS DOUBLE))) / count(*), 6) AS missing_pct, "
    f"round(min(TRY_CAST({c} AS DOUBLE)),6) AS min, round(max(TRY_CAST({c} AS DOUBLE)),6) AS max, "
    f"round(avg(TRY_CAST({c} AS DOUBLE)),6) AS mean FROM {_COERCE}" for c in ["props_k", "event_type", "value"]))
def q_coerced_summary(spark, sf):
    ev = table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("props_k"), "event_type", "value")
    return r6(P.coerced_summary(ev))


def _pairs_sql(cols, tbl, fn="corr"):
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({'max(1.0)' if a == b else f'{fn}({a}, {b})'}, 6) AS corr FROM {tbl}"
        for a in cols for b in cols)


@register("correlation_pearson", _pairs_sql(LI_NUM, "lineitem"))
def q_corr_pearson(spark, sf):
    return r6(P.correlation_matrix(table(spark, sf, "lineitem"), "pearson", LI_NUM))


_RANKED = "(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LI_NUM) + " FROM lineitem)"


@register("correlation_spearman", _pairs_sql(LI_NUM, _RANKED))
def q_corr_spearman(spark, sf):
    return r6(P.correlation_matrix(table(spark, sf, "lineitem"), "spearman", LI_NUM))


@register("correlate_with_target", """
SELECT col_name, abs_corr, rank FROM (
  SELECT col_name, abs_corr, row_number() OVER (ORDER BY abs_corr DESC, col_name) AS rank FROM (
    SELECT 'l_quantity' AS col_name, round(abs(corr(l_quantity, l_extendedprice)), 6) AS abs_corr FROM lineitem
    UNION ALL SELECT 'l_discount', round(abs(corr(l_discount, l_extendedprice)), 6) FROM lineitem
    UNION ALL SELECT 'l_tax', round(abs(corr(l_tax, l_extendedprice)), 6) FROM lineitem)) WHERE rank <= 2""")
def q_corr_target(spark, sf):
    li = table(spark, sf, "lineitem")
    return r6(P.correlate_with_target(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], top_n=2))


def _outlier_sql(method):
    parts = []
    for c in LI_NUM:
        if method == "iqr":
            b = (f"SELECT quantile_cont({c},0.25) - 1.5*(quantile_cont({c},0.75)-quantile_cont({c},0.25)) AS lo, "
                 f"quantile_cont({c},0.75) + 1.5*(quantile_cont({c},0.75)-quantile_cont({c},0.25)) AS hi FROM lineitem")
            where = ""
        elif method == "zscore":
            b = (f"SELECT avg({c}) - 3*stddev_samp({c}) AS lo, avg({c}) + 3*stddev_samp({c}) AS hi, "
                 f"stddev_samp({c}) AS s FROM lineitem")
            where = " WHERE s <> 0"
        else:
            b = (f"SELECT med - 3*mad/0.6745 AS lo, med + 3*mad/0.6745 AS hi, mad FROM "
                 f"(SELECT med, (SELECT quantile_cont(abs({c} - med), 0.5) FROM lineitem) AS mad FROM "
                 f"(SELECT quantile_cont({c}, 0.5) AS med FROM lineitem))")
            where = " WHERE mad <> 0"
        parts.append(
            f"SELECT '{c}' AS col_name, (SELECT count(*) FROM lineitem WHERE {c} < lo OR {c} > hi) AS n_outliers, "
            f"round((SELECT count(*) FROM lineitem WHERE {c} < lo OR {c} > hi)::DOUBLE / "
            f"(SELECT count({c}) FROM lineitem), 6) AS outlier_rate, round(lo, 6) AS lower, round(hi, 6) AS upper "
            f"FROM ({b}){where}")
    return "\nUNION ALL\n".join(parts)


for _m in ("iqr", "zscore", "modified_zscore"):
    def _mk(m):
        def q(spark, sf):
            return r6(P.detect_outliers(table(spark, sf, "lineitem"), m, 1.5 if m == "iqr" else 3.0, 3.0, LI_NUM))
        return q
    register(f"detect_outliers_{_m}", _outlier_sql(_m))(_mk(_m))


@register("outlier_rows", """
SELECT 'c_acctbal' AS col_name, c_custkey, round(c_acctbal, 6) AS value FROM customer,
    (SELECT quantile_cont(c_acctbal,0.25) AS q1, quantile_cont(c_acctbal,0.75) AS q3 FROM customer)
  WHERE c_acctbal < q1 - 0.3*(q3-q1) OR c_acctbal > q3 + 0.3*(q3-q1)""")
def q_outlier_rows(spark, sf):
    return r6(P.outlier_rows(table(spark, sf, "customer"), "c_custkey", "iqr", 0.3, columns=["c_acctbal"]))


@register("histogram", """
WITH mm AS (SELECT CASE WHEN min(l_extendedprice) = max(l_extendedprice) THEN min(l_extendedprice) - 0.5 ELSE min(l_extendedprice) END AS lo,
                   CASE WHEN min(l_extendedprice) = max(l_extendedprice) THEN max(l_extendedprice) + 0.5 ELSE max(l_extendedprice) END AS hi FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS cnt FROM lineitem, mm GROUP BY 1),
g AS (SELECT range::INT AS bin FROM range(30))
SELECT g.bin, round(lo + g.bin * (hi - lo) / 30, 6) AS lo_edge, round(lo + (g.bin + 1) * (hi - lo) / 30, 6) AS hi_edge,
       round(lo + (g.bin + 0.5) * (hi - lo) / 30, 6) AS center, coalesce(cnt, 0) AS count
FROM g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin""")
def q_histogram(spark, sf):
    return r6(P.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30))


@register("class_balance", """
SELECT class, count, round(count / sum(count) OVER (), 4) AS share,
       CASE WHEN count(*) OVER () < 2 THEN true ELSE min(count) OVER () / max(count) OVER () >= 0.5 END AS is_balanced
FROM (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count FROM labels WHERE quality IS NOT NULL GROUP BY 1)""")
def q_class_balance(spark, sf):
    return r6(P.class_balance(table(spark, sf, "labels"), "quality"))


@register("variance_ranking", """
SELECT col_name, round(variance, 6) AS variance, row_number() OVER (ORDER BY variance DESC, col_name) AS rank FROM (
""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS col_name, var_samp({c}) AS variance FROM lineitem" for c in LI_NUM) + ")")
def q_variance_ranking(spark, sf):
    return r6(P.variance_ranking(table(spark, sf, "lineitem"), LI_NUM))


_NULLED = "(SELECT nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS t, l_quantity AS q FROM lineitem)"


@register("missing_report", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS col_name, count(*) - count({c}) AS n_null, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_rate "
    f"FROM {_NULLED} HAVING count(*) - count({c}) > 0" for c in ["d", "t", "q"]))
def q_missing_report(spark, sf):
    li = table(spark, sf, "lineitem").select(F.expr("nullif(l_discount, 0)").alias("d"),
                                             F.expr("nullif(l_tax, 0)").alias("t"), F.col("l_quantity").alias("q"))
    return r6(P.missing_report(li))


@register("box_stats", """
SELECT o_orderpriority, count(*) AS n, round(min(o_totalprice),6) AS min, round(quantile_cont(o_totalprice,0.25),6) AS q1,
       round(quantile_cont(o_totalprice,0.5),6) AS median, round(quantile_cont(o_totalprice,0.75),6) AS q3, round(max(o_totalprice),6) AS max,
       round(greatest(min(o_totalprice), quantile_cont(o_totalprice,0.25) - 1.5*(quantile_cont(o_totalprice,0.75)-quantile_cont(o_totalprice,0.25))),6) AS whisker_lo,
       round(least(max(o_totalprice), quantile_cont(o_totalprice,0.75) + 1.5*(quantile_cont(o_totalprice,0.75)-quantile_cont(o_totalprice,0.25))),6) AS whisker_hi
FROM orders GROUP BY o_orderpriority""")
def q_box_stats(spark, sf):
    return r6(P.box_stats(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"))


@register("ols_trend", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity),6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity),6) AS intercept, round(regr_r2(l_extendedprice, l_quantity),6) AS r2,
       regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_returnflag""")
def q_ols_trend(spark, sf):
    return r6(P.ols_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", by="l_returnflag"))


@register("value_counts", "SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def q_value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "events"), "event_type")


@register("range_stats", """
SELECT round(coalesce(min(c_acctbal), 0.0),6) AS min, round(coalesce(max(c_acctbal), 1.0),6) AS max,
       round(quantile_cont(c_acctbal, 0.25),6) AS q1, round(quantile_cont(c_acctbal, 0.5),6) AS median,
       round(quantile_cont(c_acctbal, 0.75),6) AS q3, round(coalesce(avg(c_acctbal), 0.5),6) AS mean,
       round(coalesce(stddev_samp(c_acctbal), 0.0),6) AS std FROM customer""")
def q_range_stats(spark, sf):
    return r6(P.range_stats(table(spark, sf, "customer"), "c_acctbal"))


_KCOLS = ["p_size", "p_retailprice"]
_KSQL = """SELECT '{a}' AS col_a, '{b}' AS col_b, round(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b}))
           / sqrt((count(*) - sum((x.{a} = y.{a})::INT)) * (count(*) - sum((x.{b} = y.{b})::INT))), 6) AS corr
           FROM part x JOIN part y ON x.p_partkey < y.p_partkey"""


@register("correlation_kendall", " UNION ALL ".join(
    (_KSQL.format(a=a, b=b) if a != b else f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0 AS corr")
    for a in _KCOLS for b in _KCOLS))
def q_corr_kendall(spark, sf):
    return r6(P.correlation_matrix(table(spark, sf, "part"), "kendall", _KCOLS))
