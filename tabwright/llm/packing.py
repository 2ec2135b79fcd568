"""Packing into optimal length buckets.

The lengths' global histogram (lengths rounded up to ``multiple``; one row per distinct rounded length, so its
size follows the longest document and not the row count) goes to the driver, where dynamic programming picks
the bucket boundaries with the least total padding: best[k][j] = min over i of best[k-1][i] + cost(i, j].  The
cost is a Monge array, so each layer is solved by divide and conquer in O(V log V).

Inside a bucket rows are ordered by (length, doc_id) and cut into batches of ``budget // boundary`` rows (one
at least), so that no batch of more than one row exceeds the token budget after padding.  Positions come from
one distributed row number over (bucket, length, doc_id) less the bucket's offset, which the histogram
already tells; no bucket is ever gathered in one task.

Length: number of words `[^\\x20\\x09-\\x0D]+` (any integer column can be given instead).  Null or empty text
has length 0 and goes to the smallest bucket.  Ties in (length, doc_id) get adjacent positions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text.cast("string"), "^" + SPACE, ""), SPACE + "$", "")
    return F.when(t.isNull() | (t == ""), 0).otherwise(F.size(F.split(t, SPACE))).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bucket bounds (ascending, the last is the largest length) with the least total padding."""
    v = len(lengths)
    if v == 0:
        return []
    n = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    t = np.concatenate([[0.0], np.cumsum(counts * lengths.astype(float))])
    best, back = np.full(v + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, v)):
        new, arg = np.full(v + 1, np.inf), np.zeros(v + 1, int)
        new[0] = 0.0
        stack = [(1, v, 0, v - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (n[j] - n[i]) - (t[j] - t[i])
            k = int(np.argmin(cost))
            new[j], arg[j] = cost[k], i[k]
            stack += [(lo, j - 1, a, i[k]), (j + 1, hi, i[k], b)]
        best = new
        back.append(arg)
    out, j = [], v
    for arg in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = arg[j]
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 12, multiple: int = 8,
         budget: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, bucket (padded length), batch (number within the bucket), slot (place in the batch)."""
    from tabwright.plans.ordering import global_row_number
    n = F.coalesce((word_count(F.col("text")) if length is None else length).cast("long"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", n.alias("n_tokens"))
    unit = F.greatest(F.ceil(F.col("n_tokens") / multiple) * multiple, F.lit(multiple)).cast("long")
    hist = rows.groupBy(unit.alias("u")).agg(F.count(F.lit(1)).alias("c")).orderBy("u").toPandas()
    bounds = boundaries(hist.u.to_numpy(np.int64), hist.c.to_numpy(np.int64), buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket", "batch", "slot")])
    bucket, first = F.lit(bounds[-1]), F.lit(0)
    for low, b in reversed(list(zip([0, *bounds], bounds))):
        before = int(hist.c[hist.u <= low].sum())
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
        first = F.when(F.col("bucket") == b, before).otherwise(first)
    rows = rows.withColumn("bucket", bucket.cast("long"))
    pos = global_row_number(rows, ["bucket", "n_tokens", "doc_id"], "_row")
    at = (F.col("_row") - 1 - first).cast("long")
    per = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1)).cast("long")
    return pos.select("doc_id", "n_tokens", "bucket", F.floor(at / per).cast("long").alias("batch"),
                      (at % per).cast("long").alias("slot"))
