"""Exact n-gram Jaccard join through group counts: signatures of token groups, a count-vector R-tree, verification.

A document's set holds its distinct k-word shingles (with fewer words, the whole sequence as one).  Two sets link
when 100·|A∩B| ≥ pct·|A∪B|.  Equal sets are one class from the start; a class is known by its smallest doc_id.

1. Hash the tokens into groups.  Linked sets differ in at most D = (100 − pct)·|A|/pct tokens, |A| the smaller size.
   With D + 3 + S groups at least S + 3 groups hold the same tokens on both sides, so sets of one size class meet in
   the signatures of such groups; a signature of an empty group is only given by sets with three empty groups, so
   that linked sets have S + 1 signatures in common at least.  Each set then leaves out its S most frequent ones:
   in one order of all signatures, the rarest that two linked sets share stands behind S others in both.  No linked
   pair is missed, and a common shingle or passage that fills a group of its own brings few sets together.  (An R-tree over the whole table prunes nothing here: the counts of unrelated
   documents of one size lie closer together in every coordinate than the threshold allows pairs to differ, so
   its boxes all overlap.  It therefore indexes each block of sets that share a group.)
2. Contraction: in turns, each set is tried against one other set of its blocks that lies outside its component.  A
   pair goes if the summed coordinate minima of the group counts can't reach the threshold, else the sets decide.
   Verified links merge components; blocks inside one component are done.  This lasts while trials still link
   members (a quarter of them, 2 % of all) or a block holds two large components, so a large group of copies
   shrinks to a point and never expands into its pairs.
3. The blocks that still hold several components go to their hubs, and each hub gets an R-tree: points in order of
   set size, packed into leaves whose box is the coordinate maxima with the least and largest size.  Leaf pairs,
   then pairs of points of different components, are bounded by summed coordinate minima; what survives and shares
   a block is verified on the sets.  Large hubs are dealt into cells, and pairs of cells to different tasks.
4. Verification: a pair is first judged by bitmaps of one to two bits a token.  A bit that only one side has stands
   for a token that only that side has, which bounds what both can share; the pairs left are judged by whole sets.

Null text or no words: empty set, n_shingles 0, linked with nothing.  A null doc_id names no class: such rows take
part in nothing and get their set size and a null component.  Repeated rows are one class.  Sets are compared by
64-bit shingle hashes.
"""

from __future__ import annotations

import itertools
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm import textnum as tn

COORDS, LEAF, CELL = 256, 64, 1024
BATCH_ROWS, BATCH_BYTES, BLOCK_BYTES = 2000, 4 << 20, 250_000
SPARE = 16
SETTLED, HEAVY = 0.02, 256
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


@contextmanager
def _batches_of(spark, rows: int, size: int):
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes for the jobs inside.  A pair carries two whole sets: at
    Spark's 10 000 rows a batch of them takes tens of MB, and hundreds where the sets are large, in the worker and beside
    the heap of its executor, for every running task."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in most}
    for key, n in most.items():
        now = int(before[key]) if before[key].lstrip("-").isdigit() else 0       # bytes may carry a unit
        spark.conf.set(key, str(min(n, now) if now > 0 else n))
    try:
        yield
    finally:
        for key, n in before.items():
            spark.conf.set(key, n)


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of every text."""
    for lo, hi, buf, off in tn.text_blocks(column, BLOCK_BYTES):
        low = tn.LOWER[buf]
        start, end, first = tn.words(low, off)
        h = tn.substring_hash(tn.prefix_sums(low), start, end) if len(start) else np.zeros(0, np.uint64)
        n = max(0, len(h) - k + 1)
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s = s * _C[0] + tn.mix(h[j:j + n] + _C[j % 5])
        s = tn.mix(s)
        for r in range(hi - lo):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= k:
                yield lo + r, np.unique(s[a:b - k + 1])
            elif b > a:
                x = _C[4]
                for v in tn.mix(h[a:b]):
                    x = np.bitwise_xor(tn.mix(np.array([x]))[0], v)
                yield lo + r, tn.mix(np.array([x]) + np.uint64(b - a))
            else:
                yield lo + r, h[:0]


def identity(u: np.ndarray) -> int:
    return int(tn.mix(u ^ _C[1]).sum(dtype=np.uint64))


def _counts(u: np.ndarray) -> np.ndarray:
    """The set as a point: tokens per group, a byte each; all 255 if one doesn't fit, which rules nothing out."""
    c = np.bincount((u & np.uint64(COORDS - 1)).astype(np.int64), minlength=COORDS)
    return (c if c.max() <= 255 else np.full(COORDS, 255)).astype(np.uint8)


def size_classes(pct: int, top: int = 1 << 40) -> list[int]:
    """Lower bounds of the set-size classes; each spans a factor 1.5, more than linked sizes differ by."""
    b = [1]
    while b[-1] < top:
        b.append(max(b[-1] + 1, b[-1] * 3 // 2))
    assert 2 * 100 < 3 * pct, "a class must span more than linked sizes can differ by"
    return b


_EDGES: dict[int, np.ndarray] = {}


def _differ(k: int, bounds: list[int], pct: int) -> int:
    """Tokens by which linked sets of size class k differ at most."""
    return (100 - pct) * (bounds[k + 1] - 1) // pct


def signatures(u: np.ndarray, bounds: list[int], pct: int) -> np.ndarray:
    """Group signatures of one set in the scheme of its size class and, near its lower bound, of the class below; the
    lowest bit tells which of the two."""
    n, out = len(u), []
    own = int(np.searchsorted(bounds, n, "right")) - 1
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tn.mix(u))])
    for k in (own, own - 1):
        if k < 0 or (k < own and n * pct > 100 * (bounds[own] - 1)):
            continue
        d = _differ(k, bounds, pct)
        if d == 0:                                             # linked sets of this class are equal
            continue
        g = d + 3 + d // SPARE
        if g not in _EDGES:
            _EDGES[g] = np.array([(i << 64) // g for i in range(1, g)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(u, _EDGES[g]), [n]])
        size = np.diff(at).astype(np.uint64)
        sig = tn.mix(tn.mix(cum[at[1:]] - cum[at[:-1]] + size * _C[0]) + np.arange(k << 32, (k << 32) + g, dtype=np.uint64) * _C[1])
        sig = (sig & ~np.uint64(1)) | np.uint64(k & 1)
        out.append(sig if (size == 0).sum() >= 3 else sig[size > 0])
    return np.concatenate(out) if out else u[:0]


def _documents(docs: DataFrame, k: int) -> DataFrame:
    """_id, _n, _set (identity of the set) and _vec (group counts) of every row."""
    def run(batches):
        for b in batches:
            n, own, vec = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), []
            for r, u in shingle_sets(b.column("t"), k):
                n[r], own[r] = len(u), identity(u)
                vec.append(_counts(u).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n), tn.i64(own), pa.array(vec, pa.binary())],
                                             ["_id", "_n", "_set", "_vec"])
    return (docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("t"))
            .mapInArrow(run, "_id long, _n long, _set long, _vec binary"))


def _signatures(docs: DataFrame, k: int, pct: int) -> DataFrame:
    """(sig, v) of every set v, once per task for equal sets."""
    bounds = size_classes(pct)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            sig, own = [], []
            for _, u in shingle_sets(b.column("t"), k):
                s1 = identity(u)
                if len(u) and s1 not in seen:
                    seen.add(s1)
                    sig.append(signatures(u, bounds, pct))
                    own.append(np.full(len(sig[-1]), s1, np.uint64))
            if sig:
                yield pa.RecordBatch.from_arrays([tn.i64(np.concatenate(sig)), tn.i64(np.concatenate(own))], ["sig", "v"])

    return (docs.where(F.col("doc_id").isNotNull()).select(F.col("text").cast("string").alias("t"))
            .mapInArrow(run, "sig long, v long"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of signatures that at least two different sets have; one pass over rows sorted by signature."""
    def run(batches):
        sig0, s0, live = None, None, False                     # last row, and whether its run is known to be shared
        for b in batches:
            sig, s1 = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(sig):
                continue
            fresh = np.empty(len(sig), bool)                   # not a repeat of the row before
            fresh[0] = not (sig0 == sig[0] and s0 == s1[0])
            fresh[1:] = (sig[1:] != sig[:-1]) | (s1[1:] != s1[:-1])
            sig, s1 = sig[fresh], s1[fresh]
            if not len(sig):
                continue
            same = np.empty(len(sig), bool)                    # same signature as the row before
            same[0] = sig0 == sig[0]
            same[1:] = sig[1:] == sig[:-1]
            nxt = np.append(same[1:], False)
            out_sig, out_s = sig[same | nxt], s1[same | nxt]
            if same[0] and not live:                           # the run's first row was held back
                out_sig, out_s = np.append(out_sig, sig0), np.append(out_s, s0)
            live = bool(same[-1])
            sig0, s0 = sig[-1], s1[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out_sig), pa.array(out_s)], ["sig", "v"])

    return rows.repartition("sig").sortWithinPartitions("sig", "v").mapInArrow(run, "sig long, v long")


def _rarest(block: DataFrame, points: DataFrame, pct: int) -> DataFrame:
    """``block`` (sig, v) without the most frequent signatures of each set, as many as its size class can spare.

    Signatures that one set alone has are gone by now; they are the rarest, so the others keep their places."""
    from tabwright.session import cut_lineage
    bounds = size_classes(pct)
    spare = [_differ(k, bounds, pct) // SPARE for k in range(len(bounds) - 1)]
    own = F.expr(f"size(filter(array({', '.join(f'{b}L' for b in bounds)}), b -> b <= n))")              # from 1
    pick = lambda k: F.when(k >= 1, F.element_at(F.lit(spare), F.greatest(k, F.lit(1)))).otherwise(0)
    low = points.select("v", own.alias("k")).select("v", F.pmod(F.col("k") - 1, F.lit(2)).alias("bit"), pick(F.col("k")).alias("of_own"),
                                                    pick(F.col("k") - 1).alias("of_below"))
    often = cut_lineage(block.groupBy("sig").agg(F.count(F.lit(1)).alias("often")))     # written, so that the join can split a frequent one
    ranked = block.join(often, "sig").withColumn("side", F.col("sig").bitwiseAND(F.lit(1).cast("long")))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("v", "side").orderBy(F.desc("often"), "sig")))
    return (ranked.join(low, "v").where(F.col("place") > F.when(F.col("side") == F.col("bit"), F.col("of_own")).otherwise(F.col("of_below")))
            .select("sig", "v"))


def _possible(na, nb, most, pct: int):
    """Whether sets of these sizes with at most so many common tokens can link."""
    return ((100 + pct) * most >= pct * (na + nb)) | (most >= 255 * COORDS)


def _points(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, COORDS)


def _bounded(pairs: DataFrame, points: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima can reach the threshold."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                most = np.minimum(_points(b.column("va").to_pylist()), _points(b.column("vb").to_pylist())).sum(1, dtype=np.int64)
                ok = pa.array(_possible(b.column("na").to_numpy(), b.column("nb").to_numpy(), most, pct))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])
    side = lambda c: points.select(F.col("v").alias(c), F.col("n").alias("n" + c), F.col("vec").alias("v" + c))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "va", "nb", "vb")
            .mapInArrow(run, "a long, b long"))


def bitmap(u: np.ndarray) -> np.ndarray:
    """The set as bits, one to two a token: bit h mod 2^p of every token h."""
    bits = np.zeros(max(64, 1 << (len(u) - 1).bit_length()), bool)
    bits[(u & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def most_common(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """A bound on the tokens that sets of n and m tokens have in common, from their bitmaps."""
    while len(x) > len(y):                                         # the longer one folds onto the bits of the other
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    both = x & y
    common = int(np.bitwise_count(both).sum(dtype=np.int64))
    return min(n + common - int(np.bitwise_count(x).sum(dtype=np.int64)), m + common - int(np.bitwise_count(y).sum(dtype=np.int64)))


def _sets(docs: DataFrame, ids: DataFrame, k: int, broadcast_rows: int, short: bool) -> DataFrame:
    """(v, n, set) of the given (v, id) representatives, the set as 8-byte tokens or as a bitmap; ids are broadcast only
    when counted to be few."""
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids

    def run(batches):
        for b in batches:
            n, sets = [], []
            for _, u in shingle_sets(b.column("t"), k):
                n.append(len(u))
                sets.append((bitmap(u) if short and len(u) else u).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array(n, pa.int64()), pa.array(sets, pa.binary())], ["v", "n", "set"])
    return (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
            .join(ids, "id").select("v", "t").mapInArrow(run, "v long, n long, set binary"))


def _compared(pairs: DataFrame, sets: DataFrame, pct: int, short: bool) -> DataFrame:
    """The pairs that link; by bitmaps, those that may link (never fewer)."""
    def run(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for r, (n, m, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))):
                x, y = (np.frombuffer(z, np.uint8 if short else np.uint64) for z in (x, y))
                if not n or not m:                                 # another row of the same doc_id, without words
                    both = 0
                elif short:
                    both = most_common(x, y, n, m)
                else:
                    x, y = (x, y) if n <= m else (y, x)
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok[r] = (100 + pct) * both >= pct * (n + m)
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])
    side = lambda c: sets.select(F.col("v").alias(c), F.col("n").alias("n" + c), F.col("set").alias("s" + c))
    return (pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(run, "a long, b long"))


def _verified(docs: DataFrame, pairs: DataFrame, points: DataFrame, k: int, pct: int, broadcast_rows: int) -> DataFrame:
    """The pairs that link: first by bitmaps, which move a fiftieth of the bytes and rule most out, then by whole sets."""
    from tabwright.session import cut_lineage, release
    for short in (True, False):
        release(docs.sparkSession)
        ends = cut_lineage(pairs.select(F.col("a").alias("v")).unionAll(pairs.select("b")).distinct().join(points.select("v", "id"), "v"))
        sets = _sets(docs, ends, k, broadcast_rows, short)
        pairs = cut_lineage(_compared(pairs, sets, pct, short).distinct())
    return pairs


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """Each list as a copy of its own, so that a batch goes once its last unit is done."""
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    return [flat[i:j].copy() for i, j in zip(off[:-1], off[1:])]


def _block_pairs(members: DataFrame, points: DataFrame, pct: int) -> DataFrame:
    """Pairs of different components that share a block and that the blocks' R-trees can't rule out.

    ``members``: sig, v, label.  Blocks of near copies overlap in nearly all their pairs, so each block goes to its
    hub, the member with the most blocks, and one R-tree serves all blocks of a hub: a member's point travels once,
    with the list of its blocks there, and a pair is formed once.  A hub with more than CELL members is dealt into
    cells, and each pair of cells is a unit of work of its own; a task holds one unit at a time."""
    often = members.groupBy("v").agg(F.count(F.lit(1)).alias("often"))
    hub = members.join(often, "v").groupBy("sig").agg(F.max(F.struct("often", "v")).alias("h")).select("sig", F.col("h.v").alias("hub"))
    own = members.join(hub, "sig").groupBy("hub", "v").agg(F.min("label").alias("label"), F.sort_array(F.collect_list("sig")).alias("sigs"))
    cells = own.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    own = own.join(cells, "hub").join(points.select("v", "n", "vec"), "v").withColumn("c", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int"))
    unit = own.select("hub", "v", "label", "n", "vec", "sigs", "c", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("d"))
    unit = unit.select("hub", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "c", "v", "label", "n", "vec", "sigs")

    def probe(c, v, label, n, vec, sigs):
        """Pairs inside one unit: leaves of LEAF points in order of size, boxes first, then points, then blocks."""
        lo, hi = int(c.min()), int(c.max())
        cut = range(0, len(v), LEAF)
        boxes = [(vec[i:i + LEAF].max(0), int(n[i]), int(n[min(len(v), i + LEAF) - 1])) for i in cut]
        for x, i in enumerate(cut):
            for y in range(x, len(boxes)):
                j = y * LEAF
                if boxes[y][1] * pct > boxes[x][2] * 100:
                    break                                          # all further leaves hold larger sets still
                top = int(np.minimum(boxes[x][0], boxes[y][0]).sum(dtype=np.int64))
                if not _possible(boxes[x][1], boxes[y][1], top, pct):
                    continue
                p, q = slice(i, i + LEAF), slice(j, j + LEAF)
                ok = label[p, None] != label[None, q]
                if lo != hi:
                    ok &= c[p, None] != c[None, q]                 # pairs inside a cell belong to that cell's own unit
                if x == y:
                    ok &= np.arange(ok.shape[0])[:, None] < np.arange(ok.shape[1])[None, :]
                a, b = np.nonzero(ok)
                a, b = a + i, b + j
                most = np.minimum(vec[a], vec[b]).sum(1, dtype=np.int64)
                for k in np.flatnonzero(_possible(n[a], n[b], most, pct)):
                    if np.isin(sigs[a[k]], sigs[b[k]], assume_unique=True).any():
                        yield min(v[a[k]], v[b[k]]), max(v[a[k]], v[b[k]])

    def run(batches):
        held, key = [], None

        def done():
            if sum(len(x[1]) for x in held) > 1:
                cols = [np.concatenate(x) for x in zip(*(h[:5] for h in held))]
                found = probe(*cols, [x for h in held for x in h[5]])
                while ab := list(itertools.islice(found, 50_000)):
                    a, b = zip(*ab)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            hub, lo, hi, *rest = (b.column(c).to_numpy() for c in ("hub", "lo", "hi", "c", "v", "label", "n"))
            vec, sigs = _points(b.column("vec").to_pylist()), _lists(b.column("sigs"))
            edge = np.flatnonzero((hub[1:] != hub[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for i, j in zip([0, *edge], [*edge, len(hub)]):
                now = (hub[i], lo[i], hi[i])
                if now != key:
                    yield from done()
                    key = now
                held.append((*(x[i:j] for x in rest), vec[i:j], sigs[i:j]))
        yield from done()

    order = ["hub", "lo", "hi", "n", "v"]
    return (unit.repartition("hub", "lo", "hi").sortWithinPartitions(*order).select("hub", "lo", "hi", "c", "v", "label", "n", "vec", "sigs")
            .mapInArrow(run, "a long, b long").distinct())


def _two_heavy(named: DataFrame) -> bool:
    """Whether some block holds two components with more than HEAVY members each."""
    heavy = named.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HEAVY)
    return heavy.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0


def _linked(docs: DataFrame, k: int, pct: int, broadcast_rows: int):
    """Rows with their sets (_id, _n, _set, _vec), and (id, component) of the linked sets or None; neither has Python work left."""
    from tabwright.plans.components import component_labels
    from tabwright.session import cut_lineage, release
    spark = docs.sparkSession
    rows = cut_lineage(_documents(docs, k))
    points = (rows.where("_n > 0 and _id is not null").groupBy(F.col("_set").alias("v"))
              .agg(F.min("_id").alias("id"), F.min("_n").alias("n"), F.min("_vec").alias("vec")))
    block = cut_lineage(_shared(_signatures(docs, k, pct)))
    points = cut_lineage(points.join(block.select("v").distinct(), "v", "left_semi"))       # the others link with nothing
    block = cut_lineage(_rarest(block, points, pct))
    links, label, turn = None, None, 0
    while True:
        release(spark)                                         # signatures and the turns before are written anew by now
        named = block.withColumn("label", F.col("v")) if label is None else block.join(
            label, block.v == label.id, "left").select("sig", "v", F.coalesce("component", "v").alias("label"))
        open_ = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
        named = cut_lineage(named.join(open_, "sig", "left_semi"))
        block, members = named.select("sig", "v"), named.select("v").distinct().count()
        # one trial per member: the first member, in this turn's order, that a block of its shows outside its component
        hub = named.groupBy("sig").agg(F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), "v", "label")).alias("hub"))
        trial = (named.join(hub, "sig").where("label <> hub.label").groupBy("v").agg(F.min("hub").alias("hub"))
                 .select(F.least("v", "hub.v").alias("a"), F.greatest("v", "hub.v").alias("b")).distinct())
        trial = cut_lineage(_bounded(trial, points, pct))
        tried = trial.count()
        if not tried:
            break
        got = _verified(docs, trial, points, k, pct, broadcast_rows)
        found = got.count()
        if found:
            links = got if links is None else links.unionAll(got)
            label = component_labels(links, "a", "b")
        turn += 1
        # the R-trees do the rest once trials hardly link any more and no block holds two large components
        if 4 * found < tried or found < SETTLED * members and not _two_heavy(named):
            break
    if label is not None:
        named = named.drop("label").join(label, F.col("v") == label.id, "left").select("sig", "v", F.coalesce("component", "v").alias("label"))
        open_ = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
        named = cut_lineage(named.join(open_, "sig", "left_semi"))
    release(spark)
    rest = cut_lineage(_block_pairs(named, points, pct))       # only the written frame is kept: a name for the other would
    more = _verified(docs, rest, points, k, pct, broadcast_rows)                        # hold on to its shuffle files
    if more.limit(1).count():
        links = more if links is None else links.unionAll(more)
        label = component_labels(links, "a", "b")
    return rows, label


def link_components(docs: DataFrame, k: int = 4, pct: int = 85, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) per row."""
    with _batches_of(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        rows, label = _linked(docs, k, pct, broadcast_rows)
    out = rows.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), "_set")
    first = rows.where("_n > 0 and _id is not null").groupBy("_set").agg(F.min("_id").alias("first"))
    if label is not None:
        group = first.join(label, F.col("_set") == F.col("id")).select("_set", "first", "component")
        low = group.groupBy("component").agg(F.min("first").alias("low"))
        first = first.join(group.join(low, "component").select("_set", "low"), "_set", "left").select(
            "_set", F.coalesce("low", "first").alias("first"))
    return out.join(first, "_set", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).when(
        F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).cast("long").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, pct: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; rows that repeat that id stay as they are."""
    from tabwright.session import cut_lineage
    comp = link_components(docs, k, pct, broadcast_rows)
    name = "_gone"
    while name in docs.columns:
        name += "_"
    gone = cut_lineage(comp.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    if gone.count() <= broadcast_rows:                         # counted; beyond that a shuffle join
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
