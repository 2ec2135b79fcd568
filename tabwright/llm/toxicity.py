"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashed unigrams, bigrams and one-word skip-grams of its lower-cased
letter/digit tokens, each present or absent.  The optimiser keeps per-coordinate rates (the sum of squared
gradients) and an L1 threshold on the accumulated gradient, so most of the 2^20 weights are exactly zero and
the model that is sent to the executors is a short (index, weight) list, at most 2^20 entries by construction.

Training: at most ``max_rows`` labelled documents (a documented bound; the rows with the smallest hash of
doc_id, so the choice spreads over all rows), featurised where they lie; one task runs FTRL over that bounded
sample (averaging the models of several shards lost a quarter of the recall).  Scoring reads every whole text.

Null or empty texts have no features: their score is that of the bias alone.  Null labels, labels other than
0/1 and doc_ids with conflicting labels are not learnt from; repeated label rows count once.  With no usable
label every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm import textnum as tn

BITS = 20
#: A worker keeps what a block or a slice once took, for its later tasks as well.
BLOCK_BYTES, SLICE_ROWS = 250_000, 500


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct feature indices) of every text in the column."""
    mask = np.uint64((1 << BITS) - 1)
    for lo, hi, buf, off in tn.text_blocks(column, BLOCK_BYTES):
        low = tn.LOWER[buf]
        start, end, first = tn.words(low, off, ~tn.ALNUM)
        h = tn.substring_hash(tn.prefix_sums(low), start, end) if len(start) else np.zeros(0, np.uint64)
        two = tn.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & mask
        skip = tn.mix(h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]) & mask
        one = h & mask
        for r in range(hi - lo):
            a, b = first[r], first[r + 1]
            yield lo + r, np.unique(np.concatenate([one[a:b], two[a:max(a, b - 1)], skip[a:max(a, b - 2)]])).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float,
         epochs: int, min_rows: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (feature indices, label) rows in the given order; weights and bias.

    Features seen in fewer than ``min_rows`` rows get no weight.  The bias coordinate starts at the rows' log
    odds and is not thresholded."""
    seen = np.zeros(1 << BITS, np.int32)
    for x, _ in rows:
        seen[x] += 1
    rows = [(x[seen[x] >= min_rows], y) for x, y in rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    pos = sum(y for _, y in rows)
    bias, bias_n = float(np.log((pos + 0.5) / (len(rows) - pos + 0.5))), 1.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2)
            w[np.abs(zx) <= l1] = 0.0
            g = 1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, float(w.sum()) + bias)))) - y
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(n[x]) - np.sqrt(nx)) / alpha * w
            bias_n += g * g
            bias -= alpha * g / np.sqrt(bias_n)
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    w[np.abs(z) <= l1] = 0.0
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 16_000, min_rows: int = 5,
        alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0,
        epochs: int = 6) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Non-zero weight indices, weights and bias learnt from ``labels`` (doc_id, label); bias None: nothing to learn."""
    y = (labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y"))
         .where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_y2"))
         .where("_y = _y2").select("_id", "_y", F.xxhash64("_id").alias("_h"))
         .orderBy("_h", "_id").limit(max_rows))                      # max_rows × 20 bytes: bounded, broadcast
    rows = (docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_t"))
            .join(F.broadcast(y), "_id").select(F.col("_h").alias("h"), F.col("_y").alias("y"), F.col("_t").alias("t")))

    def featurise(batches):
        for b in batches:
            xs = [x.tobytes() for _, x in features(b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(xs, pa.binary())], ["h", "y", "x"])

    def train(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["h", "x"], kind="stable")             # one order, however the rows arrived
        w, bias = ftrl([(np.frombuffer(x, np.int32), int(y)) for x, y in zip(pdf.x, pdf.y)],
                       alpha, beta, l1, l2, epochs, min_rows)
        k = np.flatnonzero(w)
        return pd.DataFrame({"i": np.append(k, -1), "w": np.append(w[k], bias)})

    got = (rows.mapInArrow(featurise, "h long, y int, x binary").groupBy(F.lit(0).alias("all"))
           .applyInPandas(train, "i long, w double").toPandas().sort_values("i"))   # at most 2^20 + 1 rows
    if got.empty:
        return np.zeros(0, np.int32), np.zeros(0, np.float64), None
    i, w = got.i.to_numpy(), got.w.to_numpy()
    return i[1:].astype(np.int32), w[1:], float(w[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float | None]) -> DataFrame:
    """doc_id, score: the model applied to every row's whole text."""
    idx, w, bias = model
    bc = docs.sparkSession.sparkContext.broadcast((idx, w, bias))

    def apply(batches):
        i, v, b0 = bc.value
        dense = np.zeros(1 << BITS)
        dense[i] = v
        for b in batches:
            s = np.zeros(b.num_rows)
            if b0 is not None:
                for r, x in features(b.column("t")):
                    s[r] = 1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, float(dense[x].sum()) + b0))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return (docs.select("doc_id", F.col("text").cast("string").alias("t"))
            .mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"))


def held_out(doc_id) -> F.Column:
    """One fifth of the ids by crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    """doc_id, held_out, score, predicted per row; learns from the labelled rows that are not held out."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), **fit_options)
    return (score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit_options) -> DataFrame:
    """The rows (all columns) whose score is under the threshold.

    The decision is made where the row lies: scoring adds a column to the row, no join back."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), **fit_options)
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        i, v, b0 = bc.value
        dense = np.zeros(1 << BITS)
        dense[i] = v
        cut = np.log(threshold / (1 - threshold))
        for b in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            if b0 is None:
                yield b
                continue
            ok = np.ones(b.num_rows, bool)
            for r, x in features(b.column(b.schema.get_field_index("text")).cast(pa.string())):
                ok[r] = float(dense[x].sum()) + b0 < cut
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
