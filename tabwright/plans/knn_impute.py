"""KNN imputation (E3) on the columns that two rows both have.

The squared distance of a row and a donor is p/|S| · Σ_S (x − y)² over the set S of columns that neither misses (p columns
in all).  A missing value becomes the mean of that column over the ``k`` nearest donors that have it; equal distances go by
the donor's values, equal donors count as often as they occur.  Where nothing can be compared the column mean stands in.

Rows with equal values are one donor and one query.  For one pattern of missing values on either side S is fixed, so the
donors of such a pair of patterns (of donors equal in S, k) are dealt into the boxes of a tree that halves them along
their widest column; the cuts come from a bounded sample, every donor is filed.  Round 1 looks into the box around a
query and takes the k-th distance found as a limit; round 2 looks into every box that the limit can't exclude, found by
walking the tree with many queries at once.  A box and the queries that ask for it meet in one task as two matrices; a box
that many ask for is dealt to several.  The search is exact and has no cap on donors.

To the driver come the patterns (at most 2^p, those that occur), the sample and one row per box; never the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import boundary as B
from tabwright.operators.prep import Model
from tabwright.session import cut_lineage

SAMPLE = 200_000                               # donors, over all patterns, from which the trees take their cuts
QUERIES = 50_000                               # queries that walk a tree together, and at most meet a box in one task


def _vector(columns):
    return F.array(*[F.nanvl(B.as_double(c), F.lit(None).cast("double")) + F.lit(0.0) for c in columns])


def _mask(v):
    return F.array_join(F.transform(v, lambda x: F.when(x.isNull(), "0").otherwise("1")), "")


def _floats(column, p: int) -> np.ndarray:
    """Rows of a list column; missing values are NaN."""
    return np.array(column.flatten().fill_null(np.nan)).astype(float).reshape(-1, p)


def _has(mask: str) -> np.ndarray:
    return np.frombuffer(mask.encode(), np.uint8) == 49


@dataclass
class _Boxes:
    """Tree over some columns: ``dim`` is -1 in a leaf; the leaves below a node are ``first`` … ``last``."""
    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray | None = None              # box of the donors below a node
    high: np.ndarray | None = None
    n: np.ndarray | None = None                # their weight

    @classmethod
    def of(cls, x: np.ndarray, size: int) -> "_Boxes":
        """Halved at medians until at most ``size`` rows of the sample ``x`` are left."""
        dim, cut, left, right, first, last = [], [], [], [], [], []
        leaves = 0

        def grow(rows):
            nonlocal leaves
            me = len(dim)
            for col, val in ((dim, -1), (cut, 0.0), (left, me), (right, me), (first, leaves), (last, leaves)):
                col.append(val)
            wide = np.nan_to_num(rows.max(0) - rows.min(0)) if len(rows) > size else np.zeros(1)
            if wide.max() > 0:
                d = int(wide.argmax())
                v = rows[:, d]
                m = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
                m = m if m < v.max() else v[v < m].max()
                dim[me], cut[me] = d, m
                left[me] = grow(rows[v <= m])
                right[me] = grow(rows[v > m])
                last[me] = leaves - 1
            else:
                leaves += 1
            return me
        grow(x)
        return cls(*(np.array(c) for c in (dim, cut, left, right, first, last)))

    def fill(self, leaf, low, high, n) -> None:
        """Boxes and weights of the leaves, and from them those of the nodes above."""
        size, p = len(self.dim), low.shape[1]
        self.low, self.high, self.n = np.full((size, p), np.inf), np.full((size, p), -np.inf), np.zeros(size)
        node = np.zeros(int(self.last.max()) + 1, int)
        node[self.first[self.dim < 0]] = np.flatnonzero(self.dim < 0)
        self.low[node[leaf]], self.high[node[leaf]], self.n[node[leaf]] = low, high, n
        for i in range(size - 1, -1, -1):                                                   # children come after their parent
            if self.dim[i] >= 0:
                two = [self.left[i], self.right[i]]
                self.low[i], self.high[i], self.n[i] = self.low[two].min(0), self.high[two].max(0), self.n[two].sum()

    def around(self, x: np.ndarray, least: float = 0) -> np.ndarray:
        """The lowest node around each row that weighs ``least`` or more."""
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows):
            rows = rows[self.dim[at[rows]] >= 0]
            i = at[rows]
            to = np.where(x[rows, self.dim[i]] <= self.cut[i], self.left[i], self.right[i])
            if least:
                ok = self.n[to] >= least
                rows, to = rows[ok], to[ok]
            at[rows] = to
        return at

    def within(self, x: np.ndarray, limit: np.ndarray):
        """(rows, leaf) of each leaf whose box may hold a point at a squared distance up to the rows' ``limit``."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            i, rows = todo.pop()
            off = np.maximum(0, np.maximum(self.low[i] - x[rows], x[rows] - self.high[i]))
            rows = rows[~((off * off).sum(1) > limit[rows])]
            if not len(rows):
                continue
            if self.dim[i] < 0:
                yield rows, int(self.first[i])
            else:
                todo += [(self.left[i], rows), (self.right[i], rows)]


def _tie_order(y: np.ndarray) -> np.ndarray:
    """Donors in the order of their values, missing ones first."""
    keys = []
    for c in range(y.shape[1]):
        keys += [~np.isnan(y[:, c]), np.nan_to_num(y[:, c], nan=0.0, posinf=np.inf, neginf=-np.inf)]
    return np.lexsort(keys[::-1])


def _nearest(x: np.ndarray, y: np.ndarray, shared: np.ndarray, k: int):
    """(row of x, row of y, distance) of the k nearest donors of every query; of equal distances, the first rows of y."""
    p, step = len(shared), max(1, (1 << 20) // max(1, len(y)))
    for lo in range(0, len(x), step):
        d = np.zeros((min(step, len(x) - lo), len(y)))
        for c in np.flatnonzero(shared):
            gap = x[lo:lo + step, c, None] - y[None, :, c]
            gap *= gap
            d += gap
        d *= float(p) / shared.sum()
        near = ~(d > np.partition(d, k - 1, axis=1)[:, k - 1:k]) if len(y) > k else np.ones(d.shape, bool)
        i, j = np.nonzero(near)
        dist = d[i, j]
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[keep] + lo, j[keep], dist[keep]


@dataclass
class KnnImputerModel(Model):
    donors: DataFrame                      # (v, n): distinct donors
    means: dict
    k: int
    ring: int
    inputs: list = field(default_factory=list)
    indicator: bool = False

    def _filed(self, patterns: list[str]):
        """(donors filed as (g, leaf, v, n); groups; their trees) for these patterns of queries."""
        p, spark = len(self.inputs), self.donors.sparkSession
        masks = sorted(r["m"] for r in self.donors.select("m").distinct().collect())
        groups = [(q, d) for q in patterns for d in masks if (_has(q) & _has(d)).any() and (~_has(q) & _has(d)).any()]

        def grouped(batches):
            for batch in batches:
                v, m = _floats(batch.column(0), p), np.array(batch.column(2).to_pylist(), object)
                for g, (q, d) in enumerate(groups):
                    at = np.flatnonzero(m == d)
                    if len(at):
                        rows, seen = batch.take(pa.array(at)), np.where(_has(q) & _has(d), v[at], np.nan)
                        yield pa.record_batch([pa.array(np.full(len(at), g, np.int32)), rows.column(0), rows.column(1), _lists(seen)],
                                              ["g", "v", "n", "seen"])
        filed = self.donors.select("v", "n", "m").mapInArrow(grouped, "g int, v array<double>, n long, seen array<double>")
        # donors that look the same to a pattern of queries are equally far from each: k of them, in the order of ties, will do
        alike = Window.partitionBy("g", "seen").orderBy("v")
        filed = cut_lineage(filed.withColumn("at", F.row_number().over(alike)).where(F.col("at") <= self.k).drop("at", "seen"))
        share = min(1.0, SAMPLE / max(1, filed.count()))
        some = filed.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20))).select("g", "v").toArrow()
        of, at = some.column("g").to_numpy(), _floats(some.column("v").combine_chunks(), p)
        size = max(int(share * self.ring), 1 if share == 1.0 else 8)
        trees = [_Boxes.of(at[of == g][:, _has(q) & _has(d)], size) for g, (q, d) in enumerate(groups)]
        held = spark.sparkContext.broadcast((groups, trees))

        def file(batches):
            of, boxes = held.value
            for batch in batches:
                g, v = batch.column(0).to_numpy(), _floats(batch.column(1), p)
                leaf = np.zeros(len(g), np.int32)
                for i in np.unique(g):
                    q, d = of[i]
                    leaf[g == i] = boxes[i].first[boxes[i].around(v[g == i][:, _has(q) & _has(d)])]
                yield pa.record_batch([batch.column(0), pa.array(leaf), batch.column(1), batch.column(2)], ["g", "leaf", "v", "n"])
        filed = cut_lineage(filed.select("g", "v", "n").mapInArrow(file, "g int, leaf int, v array<double>, n long"))
        ends = [f(F.get("v", F.lit(c))).alias(f"{k}{c}") for c in range(p) for k, f in (("lo", F.min), ("hi", F.max))]
        stats = filed.groupBy("g", "leaf").agg(F.sum("n").alias("n"), *ends).toPandas()
        for g, (q, d) in enumerate(groups):
            mine, cols = stats[stats["g"] == g], np.flatnonzero(_has(q) & _has(d))
            trees[g].fill(mine["leaf"].to_numpy(), *(mine[[f"{e}{c}" for c in cols]].to_numpy(float) for e in ("lo", "hi")), mine["n"].to_numpy())
        return filed, groups, trees

    def fills(self, df: DataFrame) -> DataFrame:
        """(v, f): for each distinct list of values with gaps that occurs in ``df``, column index → fill."""
        p, k, spark = len(self.inputs), self.k, df.sparkSession
        v = _vector(self.inputs)
        queries = df.select(v.alias("v")).distinct().withColumn("m", _mask(F.col("v"))).where(F.col("m").contains("0") & F.col("m").contains("1"))
        queries = cut_lineage(queries.withColumn("q", F.monotonically_increasing_id()))
        patterns = sorted(r["m"] for r in queries.select("m").distinct().collect())
        filed, groups, trees = self._filed(patterns)
        held = spark.sparkContext.broadcast((groups, trees))

        def requests(limited: bool):
            """(q, v, t, g, leaf): the boxes to look into for the gaps of each query."""
            def asked(rows: pa.Table):
                of, boxes = held.value
                x, m = _floats(rows.column("v").combine_chunks(), p), np.array(rows.column("m").to_pylist(), object)
                top = _floats(rows.column("top").combine_chunks(), p) if limited else None
                for g, (mq, d) in enumerate(of):
                    at = np.flatnonzero(m == mq)
                    if not len(at):
                        continue
                    shared, tree = _has(mq) & _has(d), boxes[g]
                    z = x[at][:, shared]
                    if not limited:
                        node = tree.around(z, k)
                        many = tree.last[node] - tree.first[node] + 1
                        who = np.repeat(np.arange(len(at)), many)
                        leaf = np.repeat(tree.first[node], many) + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                    for t in np.flatnonzero(~_has(mq) & _has(d)):
                        if not limited:
                            yield at[who], t, g, leaf
                            continue
                        limit = np.where(np.isnan(top[at, t]), np.inf, top[at, t] * (1 + 1e-9) + 1e-300) * shared.sum() / p
                        for some, box in tree.within(z, limit):
                            yield at[some], t, g, np.full(len(some), box)

            def out(rows: pa.Table):
                rows = rows.combine_chunks()
                parts, size = [], 0
                for who, t, g, leaf in asked(rows):
                    parts.append((who, np.full(len(who), t), np.full(len(who), g), leaf))
                    size += len(who)
                    if size >= 100_000:
                        yield from _requested(rows, parts)
                        parts, size = [], 0
                if parts:
                    yield from _requested(rows, parts)

            def run(batches):
                wait, size = [], 0
                for batch in batches:
                    wait.append(batch)
                    size += batch.num_rows
                    if size >= QUERIES:                                                     # a walk through the tree serves them all
                        yield from out(pa.Table.from_batches(wait))
                        wait, size = [], 0
                if size:
                    yield from out(pa.Table.from_batches(wait))
            return run

        def compared(left: pa.Table, right: pa.Table) -> pa.Table:
            """The k nearest donors of a box for the queries that ask for it."""
            q, t = left.column("q").to_numpy(), left.column("t").to_numpy()
            y, n = _floats(right.column("v").combine_chunks(), p), right.column("n").to_numpy()
            found = [(q[:0], t[:0], np.zeros(0), y[:0], n[:0])]
            if len(q) and len(y):
                x, (mq, d) = _floats(left.column("v").combine_chunks(), p), held.value[0][left.column("g")[0].as_py()]
                order = _tie_order(y)
                y, n = y[order], n[order]
                found += [(q[i], t[i], dist, y[j], n[j]) for i, j, dist in _nearest(x, y, _has(mq) & _has(d), k)]
            q, t, dist, y, n = (np.concatenate(c) for c in zip(*found))
            return pa.table([pa.array(q), pa.array(t, pa.int32()), pa.array(dist), _lists(y), pa.array(n)], ["q", "t", "d", "y", "n"])

        def nearest(asked: DataFrame) -> DataFrame:
            """(q, t, d, y, n) of the k nearest donors in the boxes asked for."""
            asked = cut_lineage(asked)
            parts = asked.groupBy("g", "leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))   # a row per box
            ask = asked.join(F.broadcast(parts), ["g", "leaf"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).drop("parts")
            have = filed.join(F.broadcast(parts), ["g", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            by = ("g", "leaf", "part")
            near = ask.groupBy(*by).cogroup(have.groupBy(*by)).applyInArrow(compared, "q long, t int, d double, y array<double>, n long")
            w = Window.partitionBy("q", "t").orderBy("d", "y")
            return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)

        first = Window.partitionBy("q", "t").orderBy("d", "y")
        asked = "q long, v array<double>, t int, g int, leaf int"
        seen = nearest(queries.select("q", "v", "m").mapInArrow(requests(False), asked))
        before = F.coalesce(F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        limit = (seen.withColumn("before", before).where(F.col("before") < k).groupBy("q", "t")
                 .agg(F.when(F.sum("n") >= k, F.max("d")).alias("d")))
        limit = limit.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("t", "d"))).alias("by"))       # at most p entries
        bounded = cut_lineage(queries.join(limit, "q").select("q", "v", "m", F.array(*[F.col("by")[F.lit(t)] for t in range(p)]).alias("top")))
        take = nearest(bounded.mapInArrow(requests(True), asked)).withColumn("before", before).where(F.col("before") < k)
        used = F.least(F.col("n"), F.lit(k) - F.col("before"))
        fill = F.sum(F.element_at("y", F.col("t") + 1) * used) / F.sum(used)
        fill = take.groupBy("q", "t").agg(fill.alias("f")).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("t", "f"))).alias("f"))
        return cut_lineage(queries.join(fill, "q").select("v", "f"))

    def transform(self, df: DataFrame, keep_other: bool = True) -> DataFrame:
        fills = self.fills(df).select(F.col("v").alias("_tw_v"), F.col("f").alias("_tw_f"))
        got = df.withColumn("_tw_v", _vector(self.inputs))
        got = got.join(fills, "_tw_v", "left")
        rest = [c for c in df.columns if c not in self.inputs] if keep_other else []
        out = [F.coalesce(F.get("_tw_v", F.lit(t)), F.col("_tw_f")[F.lit(t)], F.lit(self.means[c]).cast("double")).alias(c)
               for t, c in enumerate(self.inputs)]
        if self.indicator:
            out += [F.get("_tw_v", F.lit(t)).isNull().cast("double").alias(f"missingindicator_{c}") for t, c in enumerate(self.inputs)]
        return got.select(*rest, *out)


def _lists(x: np.ndarray) -> pa.Array:
    flat = x.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, x.shape[1], dtype=np.int32)), pa.array(flat, mask=np.isnan(flat)))


def _requested(rows: pa.Table, parts):
    who, t, g, leaf = (np.concatenate(c) for c in zip(*parts))
    at = pa.array(who)
    made = pa.table([rows.column("q").take(at), rows.column("v").take(at)] + [pa.array(c.astype(np.int32)) for c in (t, g, leaf)],
                    ["q", "v", "t", "g", "leaf"])
    yield from made.to_batches(max_chunksize=20_000)


@dataclass
class KnnImputer:
    """E3 — fit keeps the table's distinct rows as donors; ``ring`` is about the number of donors in a box."""
    n_neighbors: int = 5
    add_indicator: bool = False
    ring: int = 1024

    def fit(self, df: DataFrame, columns) -> KnnImputerModel:
        columns = list(columns)
        rows = df.select(_vector(columns).alias("v"))
        donors = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("m", _mask(F.col("v"))).where(F.col("m").contains("1"))
        means = df.agg(*[F.avg(F.nanvl(B.as_double(c), F.lit(None).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return KnnImputerModel(cut_lineage(donors), {c: means[i] for i, c in enumerate(columns)}, self.n_neighbors, self.ring, columns, self.add_indicator)
