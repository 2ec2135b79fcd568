"""Skyline in k objectives (J12, O7): rows that no other row beats.

A row is beaten when another is at least as good in every objective and better in one.  Equal objective vectors are one
point.  Every point that beats another has the smaller sum of normalised objectives, so

1. the ``lead`` points with the smallest sums, of a fixed number, go to all tasks and remove what they beat;
2. each partition, sorted by the sum, keeps its own skyline (a point is only compared with survivors before it), in
   blocks: memory is bounded by ``block`` points at a time, never by the skyline;
3. the survivors form blocks of about ``block`` points of one cell of a quantile grid.  A block's best corner and worst
   corner (a table of one row per block) say which points can beat something in it: a point is sent to the blocks whose
   worst corner it doesn't exceed in any objective, unless a block's best corner is beaten outright, which drops the block;
4. each block streams past the points sent to it.

Anti-correlated data, where hardly any point is beaten, costs one comparison per point and block corner plus those that
corners can't decide; nothing is paired with the whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.session import cut_lineage


def beaten(points: np.ndarray, by: np.ndarray, step: int = 256) -> np.ndarray:
    """Which of ``points`` a row of ``by`` beats."""
    out = np.zeros(len(points), bool)
    for lo in range(0, len(by), step):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        p, q = points[left][:, None, :], by[None, lo:lo + step, :]
        out[left] = ((q <= p).all(2) & (q < p).any(2)).any(1)
    return out


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _rows(v: np.ndarray, *more) -> pa.RecordBatch:
    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
    return pa.record_batch([vec, *[pa.array(x) for x in more]], ["v", *[f"c{i}" for i in range(len(more))]])


def _local(block: int):
    """Skyline of a sorted partition: each block is compared with itself and the survivors of the blocks before."""
    def run(batches):
        kept: list[np.ndarray] = []
        for batch in batches:
            v = _vectors(batch.column(0))
            for lo in range(0, len(v), block):
                own = v[lo:lo + block]
                for past in kept:
                    own = own[~beaten(own, past)]
                own = own[~beaten(own, own)]
                if len(own):
                    kept = (kept + [own])[-8:]                           # the latest survivors; what they miss is settled later
                    yield _rows(own)
    return run


def _send(worst, number):
    """(block, role, v): each point for its own block (role 0) and for the blocks where it may beat something (role 1)."""
    def run(batches):
        w, ids = worst.value, number.value
        step = max(1, 4_000_000 // max(w.size, 1))
        for batch in batches:
            v, own = _vectors(batch.column(0)), batch.column(1).to_numpy()
            for lo in range(0, len(v), step):
                p, o = v[lo:lo + step], own[lo:lo + step]
                may = (p[:, None, :] <= w[None]).all(2) & (p[:, None, :] < w[None]).any(2) & (ids[None] != o[:, None])
                at, to = np.nonzero(may)
                yield pa.record_batch([pa.array(np.concatenate([o, ids[to]])), pa.array(np.concatenate([np.zeros(len(o), np.int32), np.ones(len(at), np.int32)])),
                                       _rows(np.concatenate([p, p[at]])).column(0)], ["block", "role", "v"])
    return run


def _settle(batches):
    """Blocks come one after the other, own points first; the points sent to them stream past."""
    now, own = None, None
    for batch in batches:
        blocks, roles, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _vectors(batch.column(2))
        at = 0
        while at < len(v):
            end = at + int(np.argmax(np.append((blocks[at:] != blocks[at]) | (roles[at:] != roles[at]), True)))
            part = v[at:end]
            if blocks[at] != now:
                if own is not None and len(own):
                    yield _rows(own)
                now, own = blocks[at], part[:0]
            if roles[at] == 0:
                own = np.concatenate([own, part])
                own = own[~beaten(own, own)]
            else:
                own = own[~beaten(own, part)]
            at = end
    if own is not None and len(own):
        yield _rows(own)


def skyline(df: DataFrame, objectives: dict, lead: int = 512, block: int = 1024, cells: int = 256) -> DataFrame:
    """Rows of ``df`` on the skyline of ``objectives`` (column → "min" | "max"), all copies of a point included.

    Rows with a null or NaN objective are left out.  A table without rows gives none."""
    cols = list(objectives)
    if not cols or any(d not in ("min", "max") for d in objectives.values()):
        raise ValueError("objectives must map columns to 'min' or 'max'")
    k = len(cols)
    better = [F.nanvl(B.as_double(c), F.lit(None).cast("double")) * F.lit(1.0 if objectives[c] == "min" else -1.0) + F.lit(0.0) for c in cols]
    tagged = df.withColumn("_tw_v", F.when(~F.greatest(*[x.isNull() for x in better], F.lit(False)), F.array(*better))).where("_tw_v IS NOT NULL")
    points = cut_lineage(tagged.select(F.col("_tw_v").alias("v")).distinct())
    at = [F.get("v", F.lit(i)) for i in range(k)]
    ends = points.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(at) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends["lo0"] is None:
        return df.limit(0)
    scale = [(x - F.lit(ends[f"lo{i}"])) / F.lit((ends[f"hi{i}"] - ends[f"lo{i}"]) or 1.0) for i, x in enumerate(at)]
    score = sum(scale[1:], scale[0])
    spark = df.sparkSession
    first = np.array([r["v"] for r in points.orderBy(score, "v").limit(lead).collect()])
    front = spark.sparkContext.broadcast(first[~beaten(first, first)])

    def lead_filter(batches):
        for batch in batches:
            v = _vectors(batch.column(0))
            yield _rows(v[~beaten(v, front.value)])
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    left = points.mapInArrow(lead_filter, "v array<double>").repartition(n).sortWithinPartitions(score, "v")
    left = cut_lineage(left.mapInArrow(_local(block), "v array<double>"))
    # a grid of about ``cells`` cells, split further by hash where a cell holds more than a block
    g = max(1, int(cells ** (1 / k) + 1e-9))
    cuts = [i / g for i in range(1, g)]
    edges = left.agg(*[F.percentile_approx(x, cuts or [0.5], 1000).alias(f"e{i}") for i, x in enumerate(at)]).first()
    cell = [sum([(x > F.lit(e)).cast("int") for e in edges[f"e{i}"]], F.lit(0)) for i, x in enumerate(at)]
    placed = left.select("v", F.xxhash64(*cell).alias("cell"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))       # at most (g)^k rows
    placed = placed.join(F.broadcast(parts), "cell").select("v", F.xxhash64("cell", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block"))
    placed = cut_lineage(placed)
    corner = lambda f: F.array(*[f(x) for x in at])
    table = placed.groupBy("block").agg(corner(F.min).alias("best"), corner(F.max).alias("worst")).toArrow()   # one row per block
    best, worst, ids = _vectors(table.column("best").combine_chunks()), _vectors(table.column("worst").combine_chunks()), table.column("block").to_numpy()
    lost = beaten(best, worst) if len(ids) > 1 else np.zeros(len(ids), bool)                    # wholly beaten by another block
    share = spark.sparkContext.broadcast
    sent = (placed.mapInArrow(_send(share(worst[~lost]), share(ids[~lost])), "block long, role int, v array<double>")
            .join(F.broadcast(spark.createDataFrame([(int(x),) for x in ids[lost]], "block long")), "block", "left_anti"))
    front_points = (sent.repartition(n, "block").sortWithinPartitions("block", "role").select("block", "role", "v")
                    .mapInArrow(_settle, "v array<double>"))
    return tagged.join(cut_lineage(front_points).withColumnRenamed("v", "_tw_v"), "_tw_v", "left_semi").drop("_tw_v")
