"""Queries for readers and writers, target rules, unions, scalar functions, charges, splits and nearest sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabwright.catalog import r6, register, table
from tabwright.functions import scalar as FN
from tabwright.operators import clean as CL
from tabwright.operators import constrain as CO
from tabwright.operators import molecules as M
from tabwright.operators import profile as P
from tabwright.operators import setops as U
from tabwright.operators import split as S
from tabwright.session import checkpoint_dir
from tabwright.sources import io


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


# --- S1–S5, S8: write and read back ------------------------------------------------
_ORDERS = """SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders"""


def _round_trip(ext):
    def run(spark, sf):
        path = f"{_folder(spark)}/t{ext}"
        io.write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
        got = io.read_table(spark, path)
        return r6(got.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus",
                             F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority"))
    return run


for _ext in (".csv", ".tsv", ".parquet"):
    register(f"round_trip_{_ext[1:]}", _ORDERS)(_round_trip(_ext))


@register("read_csv_encoding", """
SELECT o_orderkey, CASE WHEN o_orderkey > (SELECT max(o_orderkey) - 50 FROM orders) THEN 'テスト' ELSE o_orderstatus END AS word FROM orders""")
def q_read_csv_encoding(spark, sf):
    """A Shift-JIS file whose first non-ASCII row comes late."""
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0] or 0
    path = f"{_folder(spark)}/sjis.csv"
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    (o.select("o_orderkey", F.when(F.col("o_orderkey") > last - 50, "テスト").otherwise(F.col("o_orderstatus")).alias("word"))
     .write.option("header", True).option("encoding", "Shift_JIS").csv(path))
    got = io.read_csv(spark, path)
    return got.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "word")


# --- B24, B26, G9, G10, G21 ----------------------------------------------------------
@register("formula_constraint_rows", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity * l_discount + l_tax) <= 1.5""")
def q_formula(spark, sf):
    kept, _ = CO.apply_constraints(table(spark, sf, "lineitem"), [CO.formula_constraint("l_quantity * l_discount + l_tax", "<=", 1.5)])
    return kept.select("l_orderkey", "l_linenumber")


@register("drop_unlabelled", """SELECT l_orderkey, l_linenumber, l_quantity AS y FROM lineitem WHERE l_returnflag <> 'N'""")
def q_unlabelled(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("y"))
    return CL.drop_unlabelled(li, "y")


@register("analyze_target_regression", """
SELECT 'o_totalprice' AS col_name, count(*) AS n_total, count(DISTINCT o_totalprice) AS n_unique, round(min(o_totalprice), 6) AS lo,
       round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(max(o_totalprice), 6) AS hi, 'regression' AS task FROM orders""")
def q_analyze_target(spark, sf):
    t = P.analyze_target(table(spark, sf, "orders"), "o_totalprice")
    return r6(t.select("col_name", "n_total", "n_unique", F.col("min").alias("lo"), "p50", F.col("max").alias("hi"), "task"))


_TASK = {("eda", "n"): "CASE WHEN u <= 20 THEN 'classification' ELSE 'regression' END",
         ("automl", "n"): "CASE WHEN u <= greatest(10, 0.05 * n) THEN 'classification' ELSE 'regression' END",
         ("pipeline", "n"): "CASE WHEN u <= 10 THEN 'classification' ELSE 'regression' END"}
_TARGETS = [("customer", "c_nationkey"), ("part", "p_size"), ("orders", "o_custkey"), ("lineitem", "l_linenumber")]


@register("infer_task", " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, '{c}' AS col_name, {expr} AS task FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n FROM {t})"
    for (rule, _), expr in _TASK.items() for t, c in _TARGETS))
def q_infer_task(spark, sf):
    rows = [(rule, c, P.infer_task(table(spark, sf, t), c, rule)) for rule, _ in _TASK for t, c in _TARGETS]
    return spark.createDataFrame(rows, "rule string, col_name string, task string")


@register("fill_card", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, count(*) - count({c}) AS n_null, round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct, "
    f"count(DISTINCT {c}) AS n_unique FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")))
def q_fill_card(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    return r6(P.fill_card(o).select("col_name", "n_null", "null_pct", "n_unique"))


# --- T4, U2, U3, U7 --------------------------------------------------------------------
@register("sample_rows_size", "SELECT least(count(*), 500) AS n, least(count(*), 500) AS n_keys FROM orders")
def q_sample_rows(spark, sf):
    return U.sample_rows(table(spark, sf, "orders"), "o_orderkey", 500).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_keys"))


@register("append_tagged", """
SELECT 'observed' AS source, o_orderkey AS id, o_custkey AS cust, NULL::DOUBLE AS bal FROM orders
UNION ALL SELECT 'candidate', NULL, c_custkey, c_acctbal FROM customer""")
def q_append_tagged(spark, sf):
    return U.append_tagged({"observed": table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust")),
                            "candidate": table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("bal"))}) \
        .select("source", "id", "cust", "bal")


@register("append_weighted", """
SELECT p_partkey, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT p_partkey, 10.0 FROM part WHERE p_size > 40""")
def q_append_weighted(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return U.append_weighted(p, p.where("p_size > 40")).select("p_partkey", "weight")


@register("append_rows", """
SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, NULL FROM region""")
def q_append_rows(spark, sf):
    return U.append_rows(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")),
                         table(spark, sf, "region").select(F.col("r_regionkey").alias("k")))


# --- F5, F7, F8, F9, F10, F11, F13, F17 ---------------------------------------------------
@register("parse_dates", """
SELECT o_orderkey, (o_orderkey % 3 = 0) AS parsed FROM orders""")
def q_parse_dates(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", FN.try_parse_timestamp(text).isNotNull().alias("parsed"))


@register("strip_names", "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS name FROM part")
def q_strip(spark, sf):
    return table(spark, sf, "part").select("p_partkey", FN.strip_non_alnum("p_type").alias("name"))


_MOL = "CASE WHEN p_size % 4 = 0 THEN 'CC(=O)N' || p_size WHEN p_size % 4 = 1 THEN '*CC' || p_size || '[*:1]' WHEN p_size % 4 = 2 THEN 'F' ELSE p_brand END"


@register("molecule_strings", f"""
SELECT p_partkey, length(m) <= 2000 AND regexp_full_match(m, '[BCNOFPSIclbrnosp()=#@+\\-\\[\\]\\\\/%0-9]+') AND regexp_matches(m, '[BNOFPSClrIbcnosp]')
       AND NOT (length(m) < 3 AND regexp_full_match(m, '[A-Za-z]+')) AS is_molecule, contains(m, '*') AS is_polymer
FROM (SELECT p_partkey, {_MOL} AS m FROM part)""")
def q_molecule_strings(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(_MOL).alias("m"))
    return M.polymer_rows(p, "m").select("p_partkey", FN.looks_like_molecule("m").alias("is_molecule"), "is_polymer")


@register("protonation_states", """
SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 'unknown' WHEN a < 7.4 AND b > 7.4 THEN 'zwitterion' WHEN a < 7.4 THEN 'anion'
       WHEN b > 7.4 THEN 'cation' ELSE 'neutral' END AS state
FROM (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size / 4.0 END AS a, CASE WHEN p_size % 7 > 2 THEN p_size / 3.0 END AS b FROM part)""")
def q_protonation(spark, sf):
    p = table(spark, sf, "part")
    s = F.col("p_size")
    return M.protonation_states(p.select("p_partkey", F.when(s % 5 > 0, s / 4.0).alias("pka_acidic"),
                                         F.when(s % 7 > 2, s / 3.0).alias("pka_basic"))).select("p_partkey", "state")


@register("charge_columns", """
SELECT p_brand, p_partkey, coalesce(q, 0) AS charge, coalesce(m, 1) AS multiplicity, coalesce(m, 1) - 1 AS uhf,
       coalesce(m, 1) >= 1 AND coalesce(q, 0) BETWEEN -10 AND 10 AS valid_spin
FROM part LEFT JOIN (SELECT p_brand, (min(p_size) - 3)::INT AS q, (max(p_size) % 4)::INT AS m FROM part WHERE p_brand <= 'Brand#3' GROUP BY 1) USING (p_brand)""")
def q_charge_columns(spark, sf):
    p = table(spark, sf, "part")
    over = p.where("p_brand <= 'Brand#3'").groupBy("p_brand").agg((F.min("p_size") - 3).cast("int").alias("charge"),
                                                                 (F.max("p_size") % 4).cast("int").alias("multiplicity"))
    return M.charge_columns(p.select("p_brand", "p_partkey"), "p_brand", over).select("p_brand", "p_partkey", "charge", "multiplicity", "uhf", "valid_spin")


@register("sigmoid_softmax", """
SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS s,
       round(exp(c_acctbal / 1000) / (exp(c_acctbal / 1000) + exp(c_nationkey / 10.0) + exp(1)), 6) AS p0 FROM customer""")
def q_sigmoid(spark, sf):
    a = F.col("c_acctbal") / 1000
    return r6(table(spark, sf, "customer").select("c_custkey", FN.sigmoid(a).alias("s"), FN.softmax(F.array(
        a, F.col("c_nationkey") / 10.0, F.lit(1.0)))[0].alias("p0")))


@register("array_charge_summary", """
SELECT vec_id, round(list_max(e), 5) AS hi, round(list_min(e), 5) AS lo, round(list_max(e) - list_min(e), 5) AS width,
       round(sqrt(list_avg(list_transform(e, lambda x: (x - list_avg(e)) * (x - list_avg(e))))), 5) AS std, round(list_avg(list_transform(e, lambda x: abs(x))), 5) AS mean_abs
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""")
def q_array_charge(spark, sf):
    s = FN.array_charge_summary(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(s[k], 5).alias(n) for k, n in (
        ("max", "hi"), ("min", "lo"), ("range", "width"), ("std", "std"), ("mean_abs", "mean_abs"))])


# --- J3, K2 -------------------------------------------------------------------------------------
@register("precomputed_lookup", """
SELECT p_partkey, mean_size, n IS NOT NULL AS hit FROM part
LEFT JOIN (SELECT p_brand, round(avg(p_size), 6) AS mean_size, count(*) AS n FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1) USING (p_brand)""")
def q_lookup(spark, sf):
    p = table(spark, sf, "part")
    known = p.where("p_brand <> 'Brand#1'").groupBy(F.col("p_brand").alias("k")).agg(F.avg("p_size").alias("mean_size"), F.count(F.lit(1)).alias("n"))
    j, _ = M.precomputed_lookup(p.select("p_partkey", "p_brand"), "p_brand", known, "k")
    return r6(j.select("p_partkey", "mean_size", F.col("n").isNotNull().alias("hit")))


@register("descriptor_success", """
SELECT count(*) FILTER (WHERE p_size % 6 = 0) AS n_failed, round(avg(CASE WHEN p_size % 6 = 0 THEN 0.0 ELSE 1.0 END), 6) AS success_rate, 2 AS n_columns FROM part""")
def q_descriptor_success(spark, sf):
    s = F.col("p_size")
    return r6(M.descriptor_success(table(spark, sf, "part").select(F.when(s % 2 > 0, s).alias("a"), F.when(s % 3 > 0, s).alias("b")), ["a", "b"]))


# --- C5, C6, C7, C8 --------------------------------------------------------------------------------
@register("leave_two_out", """
WITH r AS (SELECT n_nationkey AS k FROM nation), p AS (SELECT a.k AS x, b.k AS y, row_number() OVER (ORDER BY a.k, b.k) - 1 AS split_id FROM r a JOIN r b ON a.k < b.k)
SELECT split_id, x AS n_nationkey FROM p UNION ALL SELECT split_id, y FROM p""")
def q_leave_two(spark, sf):
    return S.leave_p_out(table(spark, sf, "nation"), "n_nationkey", 2)


@register("leave_two_groups_out", """
WITH r AS (SELECT DISTINCT c_mktsegment AS k FROM customer), p AS (SELECT a.k AS x, b.k AS y, row_number() OVER (ORDER BY a.k, b.k) - 1 AS split_id FROM r a JOIN r b ON a.k < b.k)
SELECT split_id, x AS c_mktsegment FROM p UNION ALL SELECT split_id, y FROM p""")
def q_leave_two_groups(spark, sf):
    return S.leave_p_groups_out(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", 2)


@register("shuffle_split_sizes", """
SELECT s AS split_id, r AS role, CASE r WHEN 'test' THEN ceil(0.2 * n)::BIGINT ELSE n - ceil(0.2 * n)::BIGINT END AS n, n_all AS n_keys
FROM (SELECT count(*) AS n, count(DISTINCT c_custkey) AS n_all FROM customer), range(3) t(s), (VALUES ('test'), ('train')) v(r)""")
def q_shuffle_sizes(spark, sf):
    f = S.shuffle_split(table(spark, sf, "customer"), "c_custkey", 3, 0.2)
    every = f.groupBy("split_id").agg(F.countDistinct("c_custkey").alias("n_keys"))
    return (f.groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n")).join(every, "split_id")
            .select(F.col("split_id").cast("long").alias("split_id"), "role", "n", "n_keys"))


@register("repeated_stratified_sizes", """
SELECT r AS repeat, c_mktsegment, f AS fold, n // 4 + CASE WHEN f < n % 4 THEN 1 ELSE 0 END AS n
FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), range(2) a(r), range(4) b(f)""")
def q_repeated_sizes(spark, sf):
    c = table(spark, sf, "customer")
    f = S.repeated_kfold(c, "c_custkey", 4, 2, label="c_mktsegment").join(c.select("c_custkey", "c_mktsegment"), "c_custkey")
    return (f.groupBy("repeat", "c_mktsegment", "fold").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("repeat").cast("long").alias("repeat"), "c_mktsegment", F.col("fold").cast("long").alias("fold"), "n"))


# --- J7, nearest reference -----------------------------------------------------------------------------
_TOKENS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_type || ' ' || p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')))"


@register("max_similarity_reference", f"""
WITH t AS (SELECT p_partkey, p_size, {_TOKENS} AS s FROM part),
c AS (SELECT DISTINCT s FROM t WHERE p_size % 2 = 1), r AS (SELECT DISTINCT s FROM t WHERE p_size % 2 = 0),
b AS (SELECT c.s, max(len(list_intersect(c.s, r.s)) / (len(c.s) + len(r.s) - len(list_intersect(c.s, r.s)))::DOUBLE) AS j FROM c, r GROUP BY 1)
SELECT p_partkey, round(CASE WHEN j >= 0.5 THEN j END, 6) AS max_jaccard FROM t LEFT JOIN b USING (s) WHERE p_size % 2 = 1""")
def q_max_similarity(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.concat_ws(" ", "p_type", "p_name").alias("t"))
    cand, ref = (M.token_sets(p.where(f"p_size % 2 = {k}"), "p_partkey", "t") for k in (1, 0))
    return r6(M.max_similarity_to_reference(cand, ref, "p_partkey", 0.5))
