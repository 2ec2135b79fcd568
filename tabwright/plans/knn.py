"""Exact k-nearest neighbours in blocks.

Points are ordered along one unit direction u (the first principal axis): projection is 1-Lipschitz, so
|uᵀa − uᵀb| ≤ ‖a − b‖.  Runs of ``block`` positions form blocks.  Round 1 scores every block against itself; a query's
k-th distance D found there bounds its answer.  Round 2 pairs each query with the blocks whose range of projections comes
within D of its own (where the data have no such gaps, with all of them), block against block, so a task holds two blocks
whatever the number of rows.  A pair of blocks is scored by one matrix product; only pairs that its rounding can't exclude
get the exact distance, summed dimension by dimension: the product is in single precision, in double where that excludes
too little.  Ties in distance are broken by key.  Of equal vectors in a block 2k are enough.  Rows without a whole vector are neither queries nor neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.plans.ordering import global_row_number

_TILE = 4_000_000                          # distances held at once
_EXACT = 4_000_000                         # coordinates of exactly compared pairs held at once


def _dot(arr_col, vec):
    lit = F.array(*[F.lit(float(x)) for x in vec])
    return F.aggregate(F.zip_with(arr_col, lit, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def _principal_axis(df: DataFrame, vec: str, dim: int) -> np.ndarray:
    """First principal axis from Spark ML PCA (covariance by one distributed
    tree aggregate).  Any unit vector keeps the search exact — the axis only
    makes the bands narrow."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    v = df.where(F.col(vec).isNotNull()).select(array_to_vector(F.col(vec).cast("array<double>")).alias("_tw_f"))
    u = PCA(k=1, inputCol="_tw_f", outputCol="_tw_pc").fit(v).pc.toArray()[:, 0]
    return u / (np.linalg.norm(u) or 1.0)


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column).fill_null(np.nan)).astype(float).reshape(-1, dim)


def _few_copies(c: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``c`` (ordered by key) that can be among the k nearest of any query: of equal vectors the first 2k, each
    key k times at most, so that k are left when a query's own key is passed over."""
    def place(group):
        order = np.argsort(group, kind="stable")
        new = np.r_[True, np.diff(group[order]) != 0] if len(group) else np.zeros(0, bool)
        at = np.empty(len(group), int)
        at[order] = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        return at
    same = np.unique(np.ascontiguousarray(c + 0.0).view(f"V{c.shape[1] * 8}").ravel(), return_inverse=True)[1]
    keep = np.flatnonzero(place(same * (int(ids.max(initial=0)) + 1) + ids) < k)
    return keep[place(same[keep]) < 2 * k]


def _nearest(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, limit: np.ndarray, k: int):
    """(row of q, row of c, distance): the k nearest rows of ``c`` (ordered by key) to each row of ``q``, those within
    ``limit`` only.  A row of c whose ``ids`` is the query's ``own`` is passed over."""
    keep = _few_copies(c, ids, k)
    c, ids = c[keep], ids[keep]
    middle = c.mean(0) if len(c) else 0.0
    at, to = q - middle, c - middle
    qq, cc = (at * at).sum(1), (to * to).sum(1)
    most = cc.max(initial=0.0)
    hold = k + int(np.bincount(ids).max(initial=0))                     # so many rows hold k beside any one key
    step, out = max(1, _TILE // max(1, len(c))), []

    def products(kind):
        """‖x − c‖² ≤ t as x·c − ‖c‖²/2 ≥ (‖x‖² − t)/2, by one product of rows with one more column each."""
        return np.c_[at, np.ones(len(at))].astype(kind), np.ascontiguousarray(np.c_[to, cc / -2].T.astype(kind))

    def slack(kind):
        return 8.0 * (q.shape[1] + 8) * float(np.finfo(kind).eps)

    quick = products(np.float32) if max(most, qq.max(initial=0.0)) < 1e30 else None
    fine = None
    for i in range(0, len(q), step):
        x, part, few = q[i:i + step], slice(i, i + step), False
        top = limit[part] ** 2 * (1 + 1e-12)
        if quick is not None and np.isfinite(top).all():
            near = quick[0][part] @ quick[1] >= ((qq[part] - top - slack(np.float32) * (qq[part] + most)) / 2)[:, None].astype(np.float32)
            few = np.count_nonzero(near) <= 16 * k * len(x)
        if not few:
            fine = fine or products(float)
            score = fine[0][part] @ fine[1]
            loose = slack(float) * (qq[part] + most)
            least = (qq[part] - top - loose) / 2
            near = score >= least[:, None]
            if np.count_nonzero(near) > 16 * k * len(x) and len(c) > hold:
                least = np.maximum(least, np.partition(score, len(c) - hold, axis=1)[:, len(c) - hold] - loose)
                near = score >= least[:, None]
        row, col = np.divmod(np.flatnonzero(near), max(1, len(c)))
        other = own[i + row] != ids[col]
        row, col = row[other], col[other]
        dist = np.empty(len(row))
        for j in range(0, len(row), some := max(1, _EXACT // q.shape[1])):
            gap = x[row[j:j + some]] - c[col[j:j + some]]
            acc = np.zeros(len(gap))
            for d in range(gap.shape[1]):
                acc += gap[:, d] * gap[:, d]
            dist[j:j + some] = np.sqrt(acc)
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        first = np.searchsorted(row, np.arange(len(x)))
        best = np.flatnonzero(np.arange(len(row)) - first[row] < k) if len(row) else np.zeros(0, int)
        out.append((i + row[best], keep[col[best]], dist[best]))
    return [np.concatenate([o[j] for o in out]) if out else np.zeros(0, int) for j in range(3)]


def _score(q: pa.Table, c: pa.Table, dim: int, k: int, exclude_self: bool, limit: np.ndarray):
    """:func:`_nearest` of two tables (id, v); rows of ``c`` in the order of their ids."""
    order = pc.sort_indices(c.column("id"), null_placement="at_start")
    both = pa.chunked_array(q.column("id").chunks + c.column("id").take(order).chunks, c.schema.field("id").type)
    codes = np.asarray(pc.fill_null(pc.rank(both, tiebreaker="dense"), 0)).astype(int) if len(both) else np.zeros(0, int)
    own = codes[:q.num_rows] if exclude_self else np.full(q.num_rows, -1)
    row, col, dist = _nearest(_matrix(q.column("v"), dim), _matrix(c.column("v"), dim)[np.asarray(order)], own,
                              codes[q.num_rows:], limit, k)
    return row, np.asarray(order)[col] if len(col) else col, dist


def knn(reference: DataFrame, queries: DataFrame, key: str, vec: str, k: int = 5, h0: int = 32,
        exclude_self: bool = False, sample_size: int = 1000, block: int | None = None) -> DataFrame:
    """(query, neighbor, dist, rank) — the exact k nearest reference points of
    every query (Euclidean on the ``vec`` array column).

    A block has ``block`` positions (by default as many as make four blocks a task, at most 4 million coordinates),
    at least 2 · ``h0`` + 1 and never so few that there are more than ``sample_size`` blocks of a million rows.  To the
    driver comes one row per block."""
    from tabwright.session import cut_lineage
    spark = reference.sparkSession
    name = "`" + key.replace("`", "``") + "`"
    out = f"query {queries.select(name).schema[0].dataType.simpleString()}, neighbor {reference.select(name).schema[0].dataType.simpleString()}, dist double"
    first = reference.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v")).first()
    if first is None:
        return spark.createDataFrame([], out + ", rank int")
    dim = len(first["v"])
    u = _principal_axis(reference, vec, dim)
    full = (F.size(F.col(vec)) == dim) & F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x))
    whole = lambda d: d.where(full).where(F.col(key).isNotNull() if exclude_self or d is queries else F.lit(True))
    ref = whole(reference).select(F.col(key).alias("id"), F.col(vec).alias("v"), F.lit(1).alias("_is_ref"))
    if queries is reference:
        pts = ref.withColumn("_is_q", F.lit(1))
    else:
        pts = ref.unionByName(whole(queries).select(F.col(key).alias("id"), F.col(vec).alias("v"), F.lit(0).alias("_is_ref")))
        pts = pts.withColumn("_is_q", 1 - F.col("_is_ref"))
    pts = pts.withColumn("p", _dot(F.col("v").cast("array<double>"), u))
    pos = global_row_number(pts, ["p", "_is_ref", "id"], "_pos")
    n = pos.count()
    if block is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        most = max(256, min(8192, 4_000_000 // max(1, dim)))
        block = min(most, max(256, math.ceil(n / max(1.0, 2 * math.sqrt(tasks)))))
    block = max(block, 2 * h0 + 1, math.ceil(min(n, 1_000_000) / sample_size))
    pos = pos.withColumn("b", ((F.col("_pos") - 1) / block).cast("int"))
    refs = pos.where("_is_ref = 1")
    elem = pos.schema["v"].dataType.simpleString()
    kt = pos.schema["id"].dataType.simpleString()

    # round 1: each block against itself bounds its queries' k-th distance
    def bound(points):
        q, c = points.filter(pc.equal(points.column("_is_q"), 1)), points.filter(pc.equal(points.column("_is_ref"), 1))
        got = np.full(q.num_rows, np.inf)
        if q.num_rows and c.num_rows:
            row, _, dist = _score(q, c, dim, k, exclude_self, got)
            count = np.bincount(row, minlength=q.num_rows)
            last = np.cumsum(count) - 1
            got = np.where(count >= k, dist[np.maximum(last, 0)] if len(dist) else np.inf, np.inf)
        v = q.column("v").cast(pa.list_(q.schema.field("v").type.value_type))                # the schema allows null elements
        return pa.table([q.column("id"), v, q.column("b"), q.column("p"), pa.array(got, pa.float64())], ["id", "v", "b", "p", "d"])
    bounded = cut_lineage(pos.groupBy("b").applyInArrow(bound, f"id {kt}, v {elem}, b int, p double, d double"))

    # round 2: every block that may hold something as near
    ranges = refs.groupBy("b").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("b").collect()
    spans = F.array(*[F.struct(F.lit(r["b"]).alias("b"), F.lit(float(r["lo"])).alias("lo"), F.lit(float(r["hi"])).alias("hi")) for r in ranges])
    reach = F.col("d") + 1e-9 * (F.col("d") + F.abs("p")) + 1e-300
    meets = F.filter(spans, lambda s: (s["lo"] - F.col("p") <= reach) & (F.col("p") - s["hi"] <= reach))
    parted = bounded.select("id", "v", "d", F.col("b").alias("qb"), F.explode(F.transform(meets, lambda s: s["b"])).alias("cb"))
    pairs = cut_lineage(bounded.select(F.col("b").alias("qb"), F.explode(F.transform(meets, lambda s: s["b"])).alias("cb")).distinct())
    cands = refs.select("id", "v", F.col("b").alias("cb")).join(pairs, "cb").select("id", "v", "qb", "cb")

    def score(q, c):
        if not (q.num_rows and c.num_rows):
            return pa.table({"query": q.column("id").slice(0, 0), "neighbor": c.column("id").slice(0, 0), "dist": pa.array([], pa.float64())})
        row, col, dist = _score(q, c, dim, k, exclude_self, np.asarray(q.column("d")))
        return pa.table({"query": q.column("id").take(pa.array(row)), "neighbor": c.column("id").take(pa.array(col)), "dist": pa.array(dist)})
    top = parted.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb")).applyInArrow(score, out)
    w = Window.partitionBy("query").orderBy("dist", "neighbor")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_self(df: DataFrame, key: str, vec: str, k: int = 5, **kw) -> DataFrame:
    """k nearest *other* rows of every row."""
    return knn(df, df, key, vec, k, exclude_self=True, **kw)


def mutual_knn_share_exact(neigh: DataFrame) -> DataFrame:
    """J6 — share of (i, j ∈ kNN(i)) with i ∈ kNN(j), from an exact kNN table."""
    rev = neigh.select(F.col("neighbor").alias("query"), F.col("query").alias("neighbor"), F.lit(1).alias("_m"))
    j = neigh.select("query", "neighbor").join(rev, ["query", "neighbor"], "left")
    return j.agg(F.avg(F.coalesce("_m", F.lit(0)).cast("double")).alias("mutual_share"))


def knn_predict(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 5,
                task: str = "regression") -> DataFrame:
    """M7 — k-NN regression (mean of the neighbours' labels) or classification
    (majority vote, ties to the smallest label) for every test row."""
    nb = knn(train, test, key, vec, k)
    lab = train.select(F.col(key).alias("neighbor"), F.col(label).alias("_y"))
    j = nb.join(lab, "neighbor")
    if task == "regression":
        return j.groupBy(F.col("query").alias(key)).agg(F.avg(F.col("_y").cast("double")).alias("prediction"))
    votes = j.groupBy("query", "_y").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("query").orderBy(F.desc("_c"), F.asc("_y"))
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("query").alias(key),
                                                                                  F.col("_y").alias("prediction"))
