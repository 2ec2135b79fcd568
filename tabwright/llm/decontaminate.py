"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands.

Texts and benchmark items are folded first: lower case, every run of characters that are not letters or digits
becomes one space.  An item of m characters has leaked into a document if some stretch of the folded document is
within k = min(rate·m, (m − q) / q) edits of the whole folded item.

An edit destroys at most q of the item's m − q + 1 q-grams and moves the diagonal (document position less item
position) by at most one.  So a leak leaves at least T = m − q + 1 − k·q shared q-grams on k + 1 neighbouring
diagonals.  All m − q + 1 of them on one diagonal are an exact copy.  Bands of 2(k + 1) diagonals that start every k + 1 contain any such run whole; a band with at
least T shared q-grams is a region, and an alignment restricted to the band (with room for k edits on either side)
decides.  The filter is lossless, the alignment exact.

The benchmark's q-gram index is sent to the tasks, at most ``chunk_chars`` characters of it per pass; a larger
benchmark takes several passes over the documents instead of a larger broadcast.  Documents never shuffle.

Null or empty texts and items match nothing.  Items shorter than q folded characters identify nothing and are
not searched.  A repeated row is reported once per row; equal items are reported each under its own id; of
several places in a document the one with the fewest edits, then the first, is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 12
_TABLE: list[np.ndarray] = []


def _member() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each followed by one 0, and the text offsets."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    end = np.zeros(len(cp), bool)
    end[off[1:] - 1] = True
    word = _member()[cp] & ~end
    lead = np.empty(len(cp), bool)
    lead[:1], lead[1:] = False, word[:-1]
    keep = word | lead | end                                   # the first character after a word stands for the gap
    out = np.where(word, cp, np.uint32(32))
    out[end] = 0
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def gram_hashes(cp: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of every q-gram; grams that reach over a text's end (0) are never equal to an item's."""
    base, h, n, out, used = 0x9E3779B97F4A7C15, cp.astype(np.uint64), 1, None, 0
    while True:                                                # binary method: 1, 2, 4, … characters at a time
        if q & n:
            out = h if out is None else out[:len(h[used:])] * np.uint64(pow(base, n, 1 << 64)) + h[used:][:len(out)]
            used += n
        if n * 2 > q:
            break
        h = h[:-n] * np.uint64(pow(base, n, 1 << 64)) + h[n:] if len(h) > n else h[:0]
        n *= 2
    from tabwright.llm.textnum import mix
    return mix(out[:max(0, len(cp) - q + 1)])


class Index:
    """The q-grams of one chunk of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, q: int = Q):
        self.q, self.ids, self.text, self.m, self.k = q, [], [], [], []
        grams, item, at = [], [], []
        for i, t in items:
            cp, _ = fold([t])
            cp = cp[:-1]
            while len(cp) and cp[-1] == 32:
                cp = cp[:-1]
            if len(cp) < q:
                continue
            g = gram_hashes(cp, q)
            grams.append(g)
            item.append(np.full(len(g), len(self.ids), np.int64))
            at.append(np.arange(len(g), dtype=np.int64))
            self.ids.append(i)
            self.text.append(cp)
            self.m.append(len(cp))
            self.k.append(min(int(rate * len(cp)), (len(cp) - q) // q))
        cat = lambda x, d: np.concatenate(x) if x else np.zeros(0, d)
        g = cat(grams, np.uint64)
        order = np.argsort(g, kind="stable")
        self.grams, self.item, self.at = g[order], cat(item, np.int64)[order], cat(at, np.int64)[order]
        self.m, self.k = np.array(self.m, np.int64), np.array(self.k, np.int64)
        self.need = self.m - q + 1 - self.k * q
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, cp: np.ndarray, off: np.ndarray):
        """(text number, item number, edits, first, end) of each leak, best place per text and item."""
        h = gram_hashes(cp, self.q)
        pos = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.grams, h[pos], "left"), np.searchsorted(self.grams, h[pos], "right")
        pos, lo, n = pos[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(pos):
            return
        k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pos = np.repeat(pos, n)
        item, diag = self.item[k], pos - self.at[k]
        # one number per (item, band); positions run over the whole block, so bands of two texts only meet at an end
        step = self.k[item] + 1
        band = np.floor_divide(diag, step)
        span = len(cp) + int(self.m.max()) + 2
        shift = int(self.m.max()) + 1
        key = np.concatenate([item * (span + shift + 2) + band + shift, item * (span + shift + 2) + band + shift - 1])
        both, count = np.unique(key, return_counts=True)
        it = both // (span + shift + 2)
        ok = count >= self.need[it]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        one, all_ = np.unique(item * (span + shift + 2) + diag + shift, return_counts=True)
        it1 = one // (span + shift + 2)
        whole = all_ == self.m[it1] - self.q + 1                # every q-gram on one diagonal: no edit at all
        for i, d in zip(it1[whole], (one % (span + shift + 2) - shift)[whole]):
            row = int(np.searchsorted(off, int(d), "right")) - 1
            best.setdefault((row, int(i)), (0, int(d), int(d + self.m[i])))
        for i, b in zip(it[ok], (both % (span + shift + 2) - shift)[ok]):
            w, m = int(self.k[i]) + 1, int(self.m[i])
            first, last = int(b) * w, (int(b) + 2) * w          # diagonals first .. last - 1
            lo_row = int(np.searchsorted(off, max(0, first), "right")) - 1
            hi_row = int(np.searchsorted(off, min(len(cp) - 1, last + m), "right")) - 1
            for row in range(lo_row, hi_row + 1):               # a band may touch the end of one text and the next
                if (row, int(i)) in best and best[row, int(i)][0] == 0:
                    continue
                got = align(self.text[i], cp, first, last, w - 1, int(off[row]), int(off[row + 1]) - 1)
                if got and ((row, int(i)) not in best or got < best[row, int(i)]):
                    best[row, int(i)] = got
        for (row, i), (edits, a, b) in best.items():
            yield row, i, edits, a - int(off[row]), b - int(off[row])


def align(item: np.ndarray, cp: np.ndarray, first: int, last: int, k: int, lo: int, hi: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most k), start and end of the item in cp[lo:hi] on diagonals first − k .. last + k − 1."""
    big, width, m = 1 << 20, last - first + 2 * k, len(item)
    d0 = first - k                                              # column j of row r is text position r + d0 + j
    col = np.arange(width)
    at = d0 + col
    dist = np.where((at >= lo) & (at <= hi), 0, big)
    start = at.copy()
    for r in range(m):
        at = r + d0 + col                                       # text position consumed by a match in this row
        inside = (at >= lo) & (at < hi)
        same = np.zeros(width, bool)
        same[inside] = cp[at[inside]] == item[r]
        new = np.where(inside, dist + ~same, big)               # diagonal step
        src = start.copy()
        up = np.full(width, big)                                # the item's character is missing in the text
        up[:-1] = dist[1:] + 1
        take = up < new
        take[:-1] &= (at[:-1] + 1 >= lo) & (at[:-1] + 1 <= hi)
        new[take] = up[take]
        src[:-1][take[:-1]] = start[1:][take[:-1]]
        run = new - col                                         # characters in the text that the item lacks
        low = np.minimum.accumulate(run)
        from_ = np.maximum.accumulate(np.where(run == low, col, 0))
        dist, start = low + col, src[from_]
        dist[(at + 1 < lo) | (at + 1 > hi)] = big
        if dist.min() > k:
            return None
    j = int(np.argmin(dist))
    return int(dist[j]), int(start[j]), m + d0 + j


def find_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", rate: float = 0.05,
               chunk_chars: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, edits, first, end (in the folded document) for every item found in a row of docs."""
    return _passes(docs.select("doc_id", F.col("text").cast("string").alias("t")), items, item_id, item_text, rate, chunk_chars,
                   f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, edits int, first long, end long",
                   _report)


def drop_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", rate: float = 0.05,
               chunk_chars: int = 2_000_000) -> DataFrame:
    """The rows of docs (all columns) in which no item is found; decided where the row lies."""
    out = docs
    for index in _chunks(items, item_id, item_text, rate, chunk_chars):
        out = out.mapInArrow(_run(index, _keep), docs.schema)
    return out


def _chunks(items: DataFrame, item_id: str, item_text: str, rate: float, chunk_chars: int):
    """Broadcast indexes over parts of the benchmark, each of about ``chunk_chars`` characters at most."""
    it = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    total = it.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-int(total) // chunk_chars))
    for part in range(parts):
        rows = it.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).distinct().orderBy("i", "t").collect()
        yield items.sparkSession.sparkContext.broadcast(Index([(r.i, r.t) for r in rows], rate))


def _blocks(texts: list[str], size: int = 1_000_000):
    lo = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= size or k == len(texts) - 1:
            yield lo, texts[lo:k + 1]
            lo, n = k + 1, 0


def _run(index, emit):
    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index("t" if "t" in b.schema.names and emit is _report else "text"))
                     .cast(pa.string()).to_pylist()]
            found = [(lo + row, i, e, f, z) for lo, part in _blocks(texts)
                     for row, i, e, f, z in sorted(index.value.matches(*fold(part)))] if len(index.value.ids) else []
            yield emit(b, index.value, found)
    return run


def _report(b: pa.RecordBatch, index: Index, found: list) -> pa.RecordBatch:
    row, item, edits, first, end = zip(*found) if found else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(pa.array(row, pa.int64())), pa.array([index.ids[i] for i in item], pa.int64()),
         pa.array(edits, pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
        ["doc_id", "item_id", "edits", "first", "end"])


def _keep(b: pa.RecordBatch, index: Index, found: list) -> pa.RecordBatch:
    ok = np.ones(b.num_rows, bool)
    ok[[f[0] for f in found]] = False
    return b.filter(pa.array(ok))


def _passes(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, rate: float, chunk_chars: int, schema: str,
            emit) -> DataFrame:
    out = None
    for index in _chunks(items, item_id, item_text, rate, chunk_chars):
        part = rows.mapInArrow(_run(index, emit), schema)
        out = part if out is None else out.unionAll(part)
    return out
