"""Cleaning and constraint queries."""

from pyspark.sql import functions as F

from tabwright.catalog import r6, register, table
from tabwright.operators import clean as C
from tabwright.operators import constrain as K

_LI_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _nulled(spark, sf):
    return table(spark, sf, "lineitem").select(
        *_LI_KEYS, F.expr("nullif(l_discount, 0)").alias("d"), F.expr("nullif(l_tax, 0)").alias("t"),
        F.expr("CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END").alias("q"))


_NULLED_SQL = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_discount, 0) AS d, "
               "nullif(l_tax, 0) AS t, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS q FROM lineitem)")


@register("drop_rows_with_missing", f"""
SELECT * FROM {_NULLED_SQL}
WHERE ((d IS NULL)::INT + (t IS NULL)::INT + (q IS NULL)::INT) / 3.0 < 0.5""")
def q_drop_rows_with_missing(spark, sf):
    out, _ = C.drop_rows_with_missing(_nulled(spark, sf), 0.5, ["d", "t", "q"])
    return out


@register("preview_missing_impact", f"""
SELECT count(*) FILTER (WHERE ((d IS NULL)::INT + (t IS NULL)::INT + (q IS NULL)::INT) / 3.0 >= 0.3) AS rows_removed
FROM {_NULLED_SQL}""")
def q_preview_missing(spark, sf):
    return C.preview_missing_impact(_nulled(spark, sf), 0.3, ["d", "t", "q"])


@register("drop_null_rows", f"SELECT * FROM {_NULLED_SQL} WHERE d IS NOT NULL AND t IS NOT NULL AND q IS NOT NULL")
def q_drop_null_rows(spark, sf):
    out, _ = C.drop_null_rows(_nulled(spark, sf))
    return out


@register("remove_constant_columns", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_remove_constant(spark, sf):
    cu = table(spark, sf, "customer").withColumn("c_valid", F.col("c_custkey") >= 0) \
        .withColumn("c_none", F.lit(None).cast("double"))
    out, _ = C.remove_constant_columns(cu)
    return out


@register("drop_high_missing_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, d, t FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS t FROM lineitem)""")
def q_drop_high_missing(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *_LI_KEYS, F.expr("nullif(l_discount, 0)").alias("d"), F.expr("nullif(l_tax, 0)").alias("t"),
        F.expr("CASE WHEN l_quantity > 20 THEN NULL ELSE l_quantity END").alias("q"))
    out, _ = C.drop_high_missing_columns(li, 0.5)
    return out


_SKEWED_SQL = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, "
               "exp(l_extendedprice / 20000.0) AS e FROM lineitem)")


def _skewed(spark, sf):
    return table(spark, sf, "lineitem").select(*_LI_KEYS, "l_extendedprice",
                                               F.exp(F.col("l_extendedprice") / 20000.0).alias("e"))


def _clip_sql(c):
    return (f"CASE WHEN q3_{c} - q1_{c} = 0 OR {c} IS NULL THEN {c} ELSE "
            f"least(greatest({c}, q1_{c} - 1.5 * (q3_{c} - q1_{c})), q3_{c} + 1.5 * (q3_{c} - q1_{c})) END")


_Q = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
               for c in ["l_extendedprice", "e"])


@register("clip_outliers", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round({_clip_sql('l_extendedprice')}, 6) AS l_extendedprice,
       round({_clip_sql('e')}, 6) AS e
FROM {_SKEWED_SQL}, (SELECT {_Q} FROM {_SKEWED_SQL})""")
def q_clip_outliers(spark, sf):
    out, _ = C.clip_outliers(_skewed(spark, sf), 1.5, ["l_extendedprice", "e"])
    return r6(out)


@register("preview_outlier_impact", f"""
SELECT col_name, n_clipped FROM (
  SELECT 'e' AS col_name, count(*) FILTER (WHERE e < q1_e - 1.5*(q3_e-q1_e) OR e > q3_e + 1.5*(q3_e-q1_e)) AS n_clipped
  FROM {_SKEWED_SQL}, (SELECT {_Q} FROM {_SKEWED_SQL})
  UNION ALL
  SELECT 'l_extendedprice', count(*) FILTER (WHERE l_extendedprice < q1_l_extendedprice - 1.5*(q3_l_extendedprice-q1_l_extendedprice)
                                              OR l_extendedprice > q3_l_extendedprice + 1.5*(q3_l_extendedprice-q1_l_extendedprice))
  FROM {_SKEWED_SQL}, (SELECT {_Q} FROM {_SKEWED_SQL})) WHERE n_clipped > 0""")
def q_preview_outlier(spark, sf):
    return C.preview_outlier_impact(_skewed(spark, sf), 1.5, ["l_extendedprice", "e"])


@register("remove_duplicates_first", """
SELECT * FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)""")
def q_dedup_first(spark, sf):
    out, _ = C.remove_duplicates(table(spark, sf, "orders"), ["o_custkey"], "first", key="o_orderkey")
    return out


@register("remove_duplicates_last", """
SELECT * FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey, o_orderstatus)""")
def q_dedup_last(spark, sf):
    out, _ = C.remove_duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "last", key="o_orderkey")
    return out


@register("remove_duplicates_none", """
SELECT * FROM orders WHERE (o_custkey, o_orderpriority) IN (
  SELECT (o_custkey, o_orderpriority) FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) = 1)""")
def q_dedup_none(spark, sf):
    out, _ = C.remove_duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "none", key="o_orderkey")
    return out


@register("remove_duplicates_rows", """
SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem""")
def q_dedup_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    out, _ = C.remove_duplicates(li)
    return out


@register("cleaning_summary", """
SELECT (CASE WHEN min(c_valid) = max(c_valid) THEN 1 ELSE 0 END + CASE WHEN count(c_none) = 0 THEN 1 ELSE 0 END
        + CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN 1 ELSE 0 END
        + CASE WHEN min(c_nationkey) = max(c_nationkey) THEN 1 ELSE 0 END) AS n_const_cols,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_valid, c_none, n FROM
          (SELECT c_nationkey, c_mktsegment, c_custkey >= 0 AS c_valid, NULL::DOUBLE AS c_none, nullif(c_nationkey % 3, 0) AS n FROM customer))) AS n_dup_rows,
       CASE WHEN count(c_none) = 0 THEN 1 ELSE 0 END AS n_all_missing_cols,
       round(((count(*) - count(c_none)) + (count(*) - count(n)))::DOUBLE / count(*) / 5, 6) AS total_missing_rate
FROM (SELECT c_nationkey, c_mktsegment, c_custkey >= 0 AS c_valid, NULL::DOUBLE AS c_none, nullif(c_nationkey % 3, 0) AS n FROM customer)""")
def q_cleaning_summary(spark, sf):
    cu = table(spark, sf, "customer").select(
        "c_nationkey", "c_mktsegment", (F.col("c_custkey") >= 0).alias("c_valid"),
        F.lit(None).cast("double").alias("c_none"), F.expr("nullif(c_nationkey % 3, 0)").alias("n"))
    return r6(C.cleaning_summary(cu).select("n_const_cols", "n_dup_rows", "n_all_missing_cols", "total_missing_rate"))


def _part_constraints():
    return [K.in_range("p_size", 5, 45),
            K.linear({"p_retailprice": 1.0, "p_size": -20.0}, 1500.0, "le"),
            K.at_least(["p_size", "p_retailprice"], 2, 20.0),
            K.sql_rule("p_brand <> 'Brand#13'"),
            K.ratio_constraint("p_retailprice", "p_size", 30.0, "ge")]


_PART_PRED = ["p_size >= 5 AND p_size <= 45",
              "p_retailprice * 1.0 + p_size * -20.0 <= 1500.0",
              "(p_size > 20)::INT + (p_retailprice > 20)::INT >= 2",
              "p_brand <> 'Brand#13'",
              "p_retailprice * 1.0 + p_size * -30.0 >= 0"]
_FAIL = "CASE " + " ".join(f"WHEN NOT coalesce({p}, false) THEN {i}" for i, p in enumerate(_PART_PRED, 1)) + " ELSE 0 END"


@register("apply_constraints_rows", f"SELECT * FROM part WHERE {_FAIL} = 0")
def q_apply_constraints_rows(spark, sf):
    kept, _ = K.apply_constraints(table(spark, sf, "part"), _part_constraints())
    return kept


@register("apply_constraints_report", f"""
WITH f AS (SELECT {_FAIL} AS fail FROM part),
s AS (SELECT * FROM (VALUES (1, 'p_size in [5, 45]'), (2, 'weighted sum (p_retailprice by 1.0, p_size by -20.0) at most 1500.0'),
      (3, '2 or more above 20.0: p_size, p_retailprice'), (4, 'where p_brand <> ''Brand#13'''),
      (5, 'weighted sum (p_retailprice by 1.0, p_size by -30.0) at least 0.0')) AS s(idx, constraint_desc))
SELECT idx, constraint_desc, (SELECT count(*) FROM f WHERE fail = idx) AS removed,
       (SELECT count(*) FROM f) AS before, (SELECT count(*) FROM f WHERE fail = 0) AS after FROM s""")
def q_apply_constraints_report(spark, sf):
    _, report = K.apply_constraints(table(spark, sf, "part"), _part_constraints())
    return report


@register("constraint_sum_exclusion_conditional", """
SELECT * FROM lineitem
WHERE abs(coalesce(l_discount, 0) + coalesce(l_tax, 0) - 0.1) <= 1e-6
   OR (((l_discount > 0.05)::INT + (l_tax > 0.05)::INT) = 1
       AND ((NOT coalesce(l_quantity > 40, false)) OR coalesce(l_discount <= 0.05, false)))""")
def q_constraint_misc(spark, sf):
    li = table(spark, sf, "lineitem")
    s = K.sum_near(["l_discount", "l_tax"], 0.1, 1e-6).mask()
    e = K.count_rule(["l_discount", "l_tax"], "exactly_one", 0.05).mask()
    c = K.conditional_constraint("l_quantity", ">", 40, "l_discount", "<=", 0.05).mask()
    return li.where(s | (e & c))


@register("align_features", """
SELECT c_acctbal, 0.0 AS c_missing, c_nationkey, c_custkey FROM customer""")
def q_align_features(spark, sf):
    return K.align_features(table(spark, sf, "customer"), ["c_acctbal", "c_missing", "c_nationkey", "c_custkey"])


@register("select_columns_range", "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_select_columns(spark, sf):
    return K.select_columns(table(spark, sf, "orders"), "range", col_range=(1, 4))
