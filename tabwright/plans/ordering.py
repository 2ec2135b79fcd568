"""Global order without a one-task window.

A window with no ``partitionBy`` runs in a single task.  Whole-table positions
(row numbers, running totals, exact ranks and quantiles) are computed instead by

1. ``repartitionByRange`` on a *total* order (ties broken by a key, so a hot
   value is spread over many range partitions) and ``sortWithinPartitions``;
2. a partition-local running total (one Arrow batch pass per partition);
3. per-partition totals — a table with at most one row per range partition —
   turned into exclusive offsets and broadcast back (its size is bounded by the
   partition count, not by the data).

The range-partitioned, sorted frame is written once as a reliable checkpoint
(the shared folder named by ``spark.checkpoint.dir``): the partitioner samples
its bounds at random, so two separately planned range exchanges could disagree;
after the checkpoint every branch (local positions, per-partition totals) reads
the same materialised partitions, and a lost executor recomputes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.session import cut_lineage

_PID = "_tw_pid"
_LOCAL = "_tw_local"


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _order_exprs(order_cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def _range_sorted(df: DataFrame, order_cols, num_partitions: int | None) -> DataFrame:
    """Range partition + sort + (partition id, index within partition), checkpointed."""
    n = _num_partitions(df, num_partitions)
    order = _order_exprs(order_cols)
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn(_PID, F.spark_partition_id())
         .withColumn(_LOCAL, F.monotonically_increasing_id()
                     - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    return cut_lineage(s)


def _local_running(df: DataFrame, weight_cols: list[str], out_cols: list[str]) -> DataFrame:
    """Partition-local inclusive running sums of ``weight_cols`` (rows already sorted)."""
    import numpy as np

    schema = T.StructType(df.schema.fields + [T.StructField(o, T.DoubleType()) for o in out_cols])

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is None:
                carry = np.zeros(len(weight_cols))
            for i, (w, o) in enumerate(zip(weight_cols, out_cols)):
                v = pdf[w].astype("float64").fillna(0.0).to_numpy()
                cs = np.cumsum(v) + carry[i]
                if len(v):
                    carry[i] = cs[-1]
                pdf[o] = cs
            yield pdf

    return df.mapInPandas(run, schema)


def running_totals(df: DataFrame, order_cols, weight_cols, out_cols=None,
                   num_partitions: int | None = None) -> DataFrame:
    """Inclusive whole-table running sums of ``weight_cols`` in ``order_cols`` order.

    ``order_cols`` should be a total order (unique); equal keys in different
    range partitions would still get distinct, consistent positions.
    """
    weight_cols = list(weight_cols)
    out_cols = list(out_cols or [f"{w}_cum" for w in weight_cols])
    s = _range_sorted(df, order_cols, num_partitions).drop(_LOCAL)
    local_names = [f"_tw_l{i}" for i in range(len(weight_cols))]
    local = _local_running(s, weight_cols, local_names)
    totals = s.groupBy(_PID).agg(*[F.sum(F.col(w).cast("double")).alias(f"_tw_t{i}")
                                   for i, w in enumerate(weight_cols)])
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(_PID, *[F.coalesce(F.sum(f"_tw_t{i}").over(w), F.lit(0.0)).alias(f"_tw_o{i}")
                                 for i in range(len(weight_cols))])
    # offsets: at most one row per range partition -> safe to broadcast
    out = local.join(F.broadcast(offs), _PID, "left")
    for i, o in enumerate(out_cols):
        out = out.withColumn(o, F.col(local_names[i]) + F.coalesce(F.col(f"_tw_o{i}"), F.lit(0.0)))
    return out.drop(_PID, *local_names, *[f"_tw_o{i}" for i in range(len(weight_cols))])


def global_row_number(df: DataFrame, order_cols, name: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position of every row in ``order_cols`` order, distributed.

    Uses the range partition + per-partition offset scheme; the within-partition
    index comes from ``monotonically_increasing_id`` (partition id in the upper
    bits, record index in the lower 33 bits), so no Python is involved.
    """
    s = _range_sorted(df, order_cols, num_partitions)
    counts = s.groupBy(_PID).agg(F.count(F.lit(1)).alias("_tw_n"))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(_PID, F.coalesce(F.sum("_tw_n").over(w), F.lit(0)).alias("_tw_off"))
    out = s.join(F.broadcast(offs), _PID, "left")
    out = out.withColumn(name, (F.coalesce(F.col("_tw_off"), F.lit(0)) + F.col(_LOCAL) + 1).cast("long"))
    return out.drop(_PID, _LOCAL, "_tw_off")


def value_ladder(df: DataFrame, name_col: str, value_col: str, weight_col: str | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Distinct (name, value) with count and cumulative position within ``name``.

    Input: a long table ``(name, value[, weight])`` without NULL values.
    Output columns: name, value, cnt, cum_before (rows of the same name with a
    smaller value), cum_after = cum_before + cnt, n (rows of that name).

    The ``groupBy`` is combined map-side, so a value that holds a third of all
    rows becomes one row before any shuffle: the ladder is skew-free.
    """
    w = F.count(F.lit(1)) if weight_col is None else F.sum(weight_col)
    counts = df.groupBy(name_col, value_col).agg(w.cast("double").alias("cnt"))
    run = running_totals(counts, [name_col, value_col], ["cnt"], ["_tw_cum"], num_partitions)
    per_name = counts.groupBy(name_col).agg(F.sum("cnt").alias("_tw_first_total"))
    # cumulative position restarted per name: subtract the total of all smaller names
    wn = Window.orderBy(name_col).rowsBetween(Window.unboundedPreceding, -1)
    name_off = per_name.select(name_col, F.col("_tw_first_total").alias("n"),
                               F.coalesce(F.sum("_tw_first_total").over(wn), F.lit(0.0)).alias("_tw_noff"))
    # one row per column name: bounded by the number of profiled columns
    out = run.join(F.broadcast(name_off), name_col)
    return out.select(name_col, value_col, "cnt",
                      (F.col("_tw_cum") - F.col("cnt") - F.col("_tw_noff")).alias("cum_before"),
                      (F.col("_tw_cum") - F.col("_tw_noff")).alias("cum_after"),
                      "n")


def stack_columns(df: DataFrame, columns, name_col: str = "col_name", value_col: str = "value",
                  value_type: str = "double", keep=(), drop_null: bool = True) -> DataFrame:
    """Unpivot ``columns`` into (name, value) rows — a narrow explode, no shuffle."""
    columns = list(columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("n"),
                               (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
                                if value_type == "double" else F.col(c).cast(value_type)).alias("v"))
                      for c in columns])
    out = df.select(*keep, F.inline(pairs)).withColumnRenamed("n", name_col).withColumnRenamed("v", value_col)
    if drop_null:
        out = out.where(F.col(value_col).isNotNull())
    return out


def exact_quantiles(df: DataFrame, columns, probs, approx: bool = False,
                    num_partitions: int | None = None, bins: int = 1024) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / ``quantile_cont``) of many columns.

    Returns one row per column: ``col_name`` and ``q<i>`` for each requested prob.

    Distributed selection, no sort: the order statistics at ranks ⌊(n−1)p⌋ and
    ⌈(n−1)p⌉ are found by histogram refinement.  Each pass is ONE scan that
    counts, for every unresolved target, the values of its current cell in
    ``bins`` equal-width sub-bins (map-side combined, result ≤ bins × targets
    rows); the sub-bin holding the wanted rank becomes the next cell.  A cell
    with at most ``bins`` rows, or one that can't be cut any further, is resolved
    by collecting its (value, count) pairs.  Cells are defined by the
    same bin expressions in every pass, so boundaries are exact.  A hot value
    only makes a cell resolve sooner (min = max).  Columns that reach beyond
    10^15 (infinities included) are cut on sign(v)·log(1 + |v|), where every
    pass still divides the cell; about 500 doubles at most share one such
    value, so passes end and what is collected stays small at any size.  ``approx=True`` uses
    ``percentile_approx`` (bounded-memory sketch) instead.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "col_name string")
    schema = "col_name string, " + ", ".join(f"q{i} double" for i in range(len(probs)))
    vals = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    if approx:
        row = df.agg(*[F.percentile_approx(v, probs, 10000).alias(f"_a{i}") for i, v in enumerate(vals)]).first()
        rows = [(c, *[None if row[f"_a{i}"] is None else float(row[f"_a{i}"][j]) for j in range(len(probs))])
                for i, c in enumerate(columns)]
        return spark.createDataFrame(rows, schema)
    st = df.agg(*[x for i, v in enumerate(vals) for x in (F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"),
                                                          F.max(v).alias(f"hi{i}"))]).first()
    # targets: (column index, rank) -> value
    want = {}
    for i in range(len(columns)):
        n = st[f"n{i}"]
        if not n:
            continue
        for p in probs:
            h = (n - 1) * p
            for r in (int(math.floor(h)), int(math.ceil(h))):
                want[(i, r)] = None
    # cell of a target: list of (a, b) refinements; rank offset inside the cell
    cells = {t: ([], 0) for t in want}
    scale = list(vals)
    lo = {i: st[f"lo{i}"] for i in range(len(columns))}
    hi = {i: st[f"hi{i}"] for i in range(len(columns))}
    for t in list(want):
        if lo[t[0]] == hi[t[0]]:
            want[t] = lo[t[0]]
    for i, v in enumerate(vals):
        if st[f"n{i}"] and max(abs(lo[i]), abs(hi[i])) > 1e15:
            scale[i] = F.signum(v) * F.least(F.log1p(F.abs(v)), F.lit(_LOG_TOP))
            lo[i], hi[i] = (math.copysign(min(math.log1p(abs(x)), _LOG_TOP), x) for x in (lo[i], hi[i]))

    def in_cell(i, path):
        cond = vals[i].isNotNull()
        for (a, b, j) in path:
            cond = cond & (_bin(scale[i], a, b, bins) == j)
        return cond

    while True:
        todo = [t for t in want if want[t] is None]
        if not todo:
            break
        # group targets that share a cell (same column, same path)
        groups = {}
        for t in todo:
            path, off = cells[t]
            groups.setdefault((t[0], tuple(path)), []).append(t)
        meta = []
        for g_idx, ((i, path), ts) in enumerate(groups.items()):
            path = list(path)
            a, b = _cell_range(path, lo[i], hi[i], bins)
            meta.append((i, path, a, b, ts))
        # one scan: every row contributes (cell group, sub-bin, value) for the cells it lies in
        parts = []
        for g, (i, path, a, b, ts) in enumerate(meta):
            cond = in_cell(i, path)
            parts.append(F.struct(F.when(cond, F.lit(g)).alias("g"), _bin(scale[i], a, b, bins).alias("j"),
                                  vals[i].alias("v")))
        # ``inline`` of a struct array (no lambda) keeps the scan in generated code
        ex = df.select(F.inline(F.array(*parts))).where(F.col("g").isNotNull())
        hist = (ex.groupBy("g", "j")
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).collect())
        by_g = {}
        for r in hist:
            by_g.setdefault(r["g"], []).append((r["j"], r["n"], r["mn"], r["mx"]))
        collect_req = []
        for g, (i, path, a, b, ts) in enumerate(meta):
            hb = sorted(by_g.get(g, []))
            for t in ts:
                off = cells[t][1]
                need = t[1] - off
                acc = 0
                for j, n, mn, mx in hb:
                    if need < acc + n:
                        if mn == mx:
                            want[t] = mn
                        else:
                            newpath = path + [(a, b, j)]
                            cells[t] = (newpath, off + acc)
                            na, nb = _cell_range(newpath, lo[i], hi[i], bins)
                            if n <= bins or nb - na >= b - a or na + (nb - na) / bins <= na:
                                collect_req.append((t, i, newpath))
                        break
                    acc += n
        if collect_req:
            uniq = {}
            for t, i, path in collect_req:
                uniq.setdefault((i, tuple(path)), []).append(t)
            parts = []
            keys = list(uniq.items())
            for g, ((i, path), ts) in enumerate(keys):
                parts.append(F.struct(F.when(in_cell(i, list(path)), F.lit(g)).alias("g"), vals[i].alias("v")))
            ex = df.select(F.inline(F.array(*parts))).where(F.col("g").isNotNull())
            got = ex.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).collect()
            per = {}
            for r in got:
                per.setdefault(r["g"], []).append((r["v"], r["n"]))
            for g, ((i, path), ts) in enumerate(keys):
                vc = sorted(per.get(g, []))
                for t in ts:
                    need = t[1] - cells[t][1]
                    acc = 0
                    for v, n in vc:
                        if need < acc + n:
                            want[t] = v
                            break
                        acc += n
    rows = []
    for i, c in enumerate(columns):
        n = st[f"n{i}"]
        if not n:
            rows.append((c, *[None] * len(probs)))
            continue
        qs = []
        for p in probs:
            h = (n - 1) * p
            a_, b_ = want[(i, int(math.floor(h)))], want[(i, int(math.ceil(h)))]
            qs.append(float(a_ if a_ == b_ else a_ + (h - math.floor(h)) * (b_ - a_)))
        rows.append((c, *qs))
    return spark.createDataFrame(rows, schema)


_LOG_TOP = 1000.0      # stands for log(1 + |v|) of an infinity; finite doubles stay under 710


def _bin(v, a: float, b: float, bins: int):
    """Sub-bin index of v inside the cell [a, b] (last bin closed)."""
    if b <= a:
        return F.lit(0)
    return F.least(F.greatest(F.floor((v - F.lit(a)) / F.lit(b - a) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def _cell_range(path, lo, hi, bins):
    """Numeric range of the cell reached by ``path`` (used only to place the
    next sub-bins; membership is always decided by the bin expressions)."""
    a, b = lo, hi
    for (pa, pb, j) in path:
        w = (pb - pa) / bins
        a, b = pa + j * w, (pa + (j + 1) * w if j < bins - 1 else pb)
    return a, b


def average_ranks(df: DataFrame, columns, suffix: str = "_rank", num_partitions: int | None = None,
                  key: str | None = None) -> DataFrame:
    """Add ``<c>_rank`` = average rank (ties share the mean position, 1-based) per column.

    Ranks come from the value ladder (distinct values only) joined back on the
    value; NULL values keep a NULL rank.  The ladder has one row per distinct
    value — AQE broadcasts it when small, otherwise a shuffle join whose hot
    keys the skew-join rule splits.
    """
    out = df
    long = stack_columns(df, columns)
    lad = value_ladder(long, "col_name", "value", num_partitions=num_partitions)
    lad = lad.select("col_name", "value", ((F.col("cum_before") + F.col("cum_after") + 1) / 2).alias("_r"))
    for c in columns:
        rc = lad.where(F.col("col_name") == c).select(F.col("value").alias(f"_tw_v_{c}"),
                                                     F.col("_r").alias(c + suffix))
        out = (out.withColumn(f"_tw_v_{c}", F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
               .join(rc, f"_tw_v_{c}", "left").drop(f"_tw_v_{c}"))
    return out
