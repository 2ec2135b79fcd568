"""Phrase collocations by top-order marginalisation: only longest windows are counted, ROLLUP sums their prefixes.

A-Z are lower-cased, texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and pieces into words ``[^\\x20\\x09]+``.  A word position
carries its window as lead columns w0 … w4, padded with '' past the end; equal windows are counted once, and
``ROLLUP(lang, w0 … w4)`` of those counts gives the frequency of every shorter phrase: a phrase occurs where a window starts
with it.

A phrase of frequency ``min_count`` holds no word, pair or triple of neighbours that is rarer.  So words are counted first, then
hashes of pairs of frequent words, then hashes of triples of frequent pairs; a window ends where the next pair or triple isn't
frequent, and windows of one word are not formed (words are counted already).  These prunings go through bitmaps of at
most ``BITS`` bits, whatever the size of the corpus; a false hit only leaves a window longer than need be: pairs and longer
phrases get their counts from the ROLLUP alone, which is exact.

Per lang (null: ``und``): n = all word occurrences, a = f(phrase) ≥ min_count, and of the cuts of a phrase the one with the
least floor(1000·a·n / (l·r)), ties to the shorter first part; products are 38-digit decimals.  A candidate goes when a
candidate with one word more, before or after, has 100·f ≥ 100·a (a longer one that fits implies one with one word more).

Null and empty texts have no words; repeated rows count each time; other columns are not read, whatever their names; a
table without rows gives no phrases.  Texts are read whole, runs of about ``BLOCK`` bytes at a time (a longer text alone).
A hot word, pair or passage is one row per task before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.textnum import LOWER, i64, mix, prefix_sums, spans, substring_hash, text_blocks

BITS = 1 << 26                      # of a bitmap: 8 MB at most are broadcast
BLOCK = 1_000_000
LONGEST = 5
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 9]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(buf, start, end, lang) -> np.ndarray:
    return mix(substring_hash(prefix_sums(buf), start, end) + lang.astype(np.uint64) * _STEP)


class _Words:
    """Words of one block: bytes, starts, ends, hashes (lang included), and whether the next word follows in the same piece."""

    def __init__(self, buf, off, langs):
        self.buf = LOWER[buf]
        self.start, self.end, first = spans(~_GAP[self.buf], off)
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        self.lang = langs[row]
        breaks = np.cumsum(_BREAK[self.buf], dtype=np.int32)
        self.follows = np.zeros(len(self.start), bool)
        if len(self.start):
            self.follows[:-1] = (row[1:] == row[:-1]) & (breaks[self.start[1:]] == breaks[self.end[:-1] - 1])
        self.hash = _word_hash(self.buf, self.start, self.end, self.lang)

    def linked(self, frequent: list[np.ndarray]) -> list[np.ndarray]:
        """Per m from 1 on: whether the m words from here on are in one piece and frequent, as far as bitmaps are given for m."""
        out = [_hit(frequent[0], self.hash)]
        for m in range(2, len(frequent) + 2):
            both = out[-1] & np.roll(out[-1], -1) & (self.follows if m == 2 else True)
            if m <= len(frequent):
                both[both] = _hit(frequent[m - 1], self.run(m)[both])
            out.append(both)
        return out

    def run(self, m: int) -> np.ndarray:
        """Hash of each word with the m − 1 after it (of no use at the block's end)."""
        h = self.hash
        for j in range(1, m):
            h = mix(h * np.uint64(3) + np.roll(self.hash, -j) * np.uint64(5) + _STEP)
        return h

    def text(self, at: np.ndarray) -> pa.Array:
        """The words at these indices; '' for -1."""
        none = at < 0
        start = np.where(none, 0, self.start[at]) if len(self.start) else np.zeros(len(at), np.int64)
        size = np.where(none, 0, self.end[at] - self.start[at]) if len(self.start) else np.zeros(len(at), np.int64)
        offs = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=offs[1:])
        data = self.buf[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _langs(column: pa.Array) -> tuple[np.ndarray, dict]:
    """A number for each row's lang, alike in all tasks (a hash of its name), and the names of the numbers."""
    lang = column.cast(pa.string()).fill_null("und").dictionary_encode()
    codes = {}
    for name in lang.dictionary.to_pylist():
        raw = np.frombuffer(name.encode(), np.uint8)
        codes[substring_hash(prefix_sums(raw), np.zeros(1, np.int64), np.full(1, len(raw)))[0]] = name
    return np.array(list(codes), np.uint64)[lang.indices.to_numpy(zero_copy_only=False)], codes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, dict]]:
    """Words and the names of the langs of each block."""
    for batch in batches:
        number, names = _langs(batch.column(1))
        for lo, hi, buf, off in text_blocks(batch.column(0), BLOCK):
            yield _Words(buf, off, number[lo:hi]), names


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and count of each distinct value."""
    _, at, count = np.unique(h, return_index=True, return_counts=True)
    return at, count


def _names(lang: np.ndarray, names: dict) -> pa.Array:
    codes, at = np.unique(lang, return_inverse=True)
    return pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array([names[x] for x in codes], pa.string())).cast(pa.string())


def _hit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 8 - 1)
    return bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


def _bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes' low ends; combined in the tasks and by their index, at most BITS / 64 rows reach the driver."""
    size = 1 << 16
    while size < BITS and size < 64 * hashes.count():
        size *= 2
    at = F.col(column).bitwiseAND(F.lit(size - 1))
    words = (hashes.select(F.shiftright(at, 6).cast("int").alias("i"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("b"))
             .groupBy("i").agg(F.bit_or("b").alias("b"))).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("i").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def _count_words(batches):
    for w, names in _blocks(batches):
        at, count = _unique(w.hash)
        yield pa.record_batch([_names(w.lang[at], names), w.text(at), pa.array(count.astype(np.int64))], ["lang", "word", "c"])


def _hash_words(batches):
    """(lang, word, f) with the hash that the word has in texts."""
    for batch in batches:
        number, _ = _langs(batch.column(0))
        for lo, hi, buf, off in text_blocks(batch.column(1), BLOCK):
            h = _word_hash(buf, off[:-1], off[1:], number[lo:hi])
            part = batch.slice(lo, hi - lo)
            yield pa.record_batch([part.column(0), part.column(1), i64(h), part.column(2)], ["lang", "phrase", "h", "f"])


def _count_runs(m, bitmaps):
    """Hashes of the runs of m words whose shorter runs are all frequent."""
    def run(batches):
        frequent = [b.value for b in bitmaps]
        for w, _ in _blocks(batches):
            at, count = _unique(h := w.run(m)[w.linked(frequent)[m - 1]])
            yield pa.record_batch([i64(h[at]), pa.array(count.astype(np.int64))], ["h", "c"])
    return run


def _count_windows(bitmaps, longest):
    def run(batches):
        frequent = [b.value for b in bitmaps]
        top = min(len(frequent), longest)                                # runs longer than the bitmaps know grow by those that they do
        for w, names in _blocks(batches):
            linked = w.linked(frequent)[:top]
            n = len(w.hash)
            size = np.zeros(n, np.int64)
            for m in range(1, longest + 1):                              # a run of m words is a run of m - 1 words and a known one at its end
                last = linked[m - 1] if m <= top else np.roll(linked[-1], top - m)
                size[(size == m - 1) & last] = m
            first = np.flatnonzero(size >= 2)
            size = size[first]
            key = np.zeros(len(first), np.uint64)
            for j in range(longest):                                     # the window's hash, padding included
                here = np.where(j < size, w.hash[np.minimum(first + j, n - 1)], np.uint64(j + 1)) if n else key
                key = mix(key * np.uint64(3) + here + _STEP)
            at, count = _unique(key)
            first, size = first[at], size[at]
            lead = [w.text(np.where(j < size, first + j, -1)) for j in range(longest)]
            yield pa.record_batch([_names(w.lang[first], names), *lead, pa.array(count.astype(np.int64))],
                                  ["lang", *[f"w{j}" for j in range(longest)], "c"])
    return run


def phrase_counts(docs: DataFrame, min_count: int = 100, longest: int = LONGEST, text_col: str = "text",
                  lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, phrase, words, f) of every phrase of up to ``longest`` words with f ≥ min_count."""
    from tabwright.session import cut_lineage
    sc = docs.sparkSession.sparkContext
    texts = docs.select(docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("l"))
    words = texts.mapInArrow(_count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("f"))
    # rare words matter for n only: they go on as one row per lang
    words = cut_lineage(words.groupBy("lang", F.when(F.col("f") >= min_count, F.col("word")).alias("phrase")).agg(F.sum("f").alias("f")))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    single = words.where("phrase IS NOT NULL")
    known = [sc.broadcast(_bitmap(cut_lineage(single.mapInArrow(_hash_words, "lang string, phrase string, h long, f long").select("h")), "h"))]
    for m in range(2, min(3, longest) + 1):
        runs = texts.mapInArrow(_count_runs(m, known), "h long, c long").groupBy("h").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count)
        known = [*known, sc.broadcast(_bitmap(cut_lineage(runs.select("h")), "h"))]
    lead = [f"w{j}" for j in range(longest)]
    windows = (texts.mapInArrow(_count_windows(known, longest), "lang string, " + ", ".join(f"{c} string" for c in lead) + ", c long")
               .groupBy("lang", *lead).agg(F.sum("c").alias("c")))
    level = F.grouping_id()                                               # 2^k - 1: the last k columns are summed over
    sums = windows.rollup("lang", *lead).agg(F.sum("c").alias("f"), level.alias("out")).where(F.col("f") >= min_count)
    size = F.element_at(F.create_map(*[F.lit(x) for k in range(longest + 2) for x in (2 ** k - 1, longest - k)]), F.col("out").cast("int"))
    sums = sums.withColumn("words", size).where("words >= 2").withColumn("ws", F.slice(F.array(*lead), F.lit(1), F.col("words")))
    sums = sums.where(~F.array_contains("ws", ""))
    many = sums.select("lang", F.array_join("ws", " ").alias("phrase"), "words", "f")
    return total, cut_lineage(single.select("lang", "phrase", F.lit(1).alias("words"), "f").unionAll(many))


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, longest: int = LONGEST, **columns) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``top`` phrases."""
    total, freq = phrase_counts(docs, min_count, longest, **columns)
    cand = freq.where("words >= 2")
    cut = cand.select("lang", "phrase", "words", "f", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    ws = F.split("phrase", " ")
    cut = cut.withColumns({"head": F.array_join(F.slice(ws, F.lit(1), F.col("k")), " "),
                           "tail": F.array_join(F.slice(ws, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    part = lambda name, f: freq.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(total, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"up": exact("f") * exact("n") * F.lit(1000).cast("decimal(4,0)"), "down": exact("l") * exact("r")})
    best = (cut.withColumn("score", F.expr("up div down"))
            .groupBy("lang", "phrase", "words", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")))
    inner = (cand.where("words >= 3").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(ws, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(ws, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < 100 * F.col("f"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase"))   # group limits run before the shuffle
    return (kept.select("lang", "phrase", "f", "n", "b.score", "b.l", "b.r").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score"))


#: The same with one explosion per length and a check against every longer phrase.
ORACLE = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM listed GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM listed, unnest(range(1, 6)) AS ms(m), unnest(range(1, greatest(len(w) - m + 2, 1)::BIGINT)) AS pos(i) WHERE i + m - 1 <= len(w)),
freq AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM freq WHERE m >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.f, k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cand c, unnest(range(1, m)) AS ks(k)
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')
  JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (
  SELECT 1 FROM cand o WHERE o.lang = b.lang AND len(o.ws) > len(string_split(b.phrase, ' '))
  AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.f >= 100 * b.f)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, f AS a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
