"""Line dedup by distinct-site spread.

A line (white space collapsed, outer space trimmed; lines without a word don't count) is boilerplate when it
stands on at least ``min_sites`` distinct sites.  One HyperLogLog sketch of the sites per line hash, merged by
a plain aggregation (a line that fills a third of the table shrinks to one sketch per task before the
shuffle), settles every line whose estimate lies clear of the threshold; only the lines within three standard
errors of it get an exact distinct count.

Boilerplate lines are removed from every document, whatever their share.  Only a whole copy is exempt: where all lines of a
document are boilerplate and other rows have the same text, the copy with the smallest doc_id (null last) keeps it.

Null text: no lines, text stays null.  Null site: one site of its own.  Rows are told apart by (doc_id, text),
so repeated rows get the same answer once each, and null ids work; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACE, " "))


def _size(array: Column) -> Column:
    return F.when(array.isNull(), 0).otherwise(F.size(array)).cast("long")


def _lines(docs: DataFrame, site_col: str) -> DataFrame:
    line = docs.select(F.xxhash64(F.lit(1), "doc_id", "text").alias("_k1"), F.xxhash64(F.lit(2), "doc_id", "text").alias("_k2"),
                       F.col(site_col).cast("string").alias("_site"),
                       F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("_pos", "_line"))
    line = line.select("_k1", "_k2", F.coalesce(F.concat(F.lit("="), "_site"), F.lit("")).alias("_site"), "_pos",
                       _norm(F.col("_line")).alias("_line")).where("_line <> ''")
    return line.select("_k1", "_k2", "_site", "_pos",
                       F.xxhash64(F.lit(3), "_line").alias("_h1"), F.xxhash64(F.lit(4), "_line").alias("_h2"))


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    """(_h1, _h2) of the lines on at least ``min_sites`` sites."""
    error = 3 * 1.04 / math.sqrt(2 ** lg_k)
    lo, hi = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error)) + 1
    est = (lines.groupBy("_h1", "_h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("_est"))
           .where(F.col("_est") >= lo))
    near = est.where(F.col("_est") < hi).select("_h1", "_h2")
    exact = (lines.select("_h1", "_h2", "_site").distinct().join(near, ["_h1", "_h2"], "left_semi")
             .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_sites))
    return est.where(F.col("_est") >= hi).select("_h1", "_h2").unionAll(exact.select("_h1", "_h2"))


def _kept_copies(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """(_k1, _k2) of the row that keeps its text, for each text of boilerplate lines only that stands in two rows or more."""
    lines = F.size(F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x: _norm(x) != ""))
    rows = keyed.select("_k1", "_k2", lines.alias("_n"), F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2").alias("_row"),
                        F.xxhash64(F.lit(5), "text").alias("_t1"), F.xxhash64(F.lit(6), "text").alias("_t2"))
    return (rows.join(hits.select("_k1", "_k2", F.size("_at").alias("_hit")), ["_k1", "_k2"]).where("_n = _hit")
            .groupBy("_t1", "_t2").agg(F.count(F.lit(1)).alias("_copies"), F.min("_row").alias("_row")).where("_copies > 1")
            .select("_row._k1", "_row._k2"))


def _cut(docs: DataFrame, site_col: str = "source", min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """doc_id, text with the lines cut, _n_lines, _n_spread (lines with a word / of them boilerplate), _n_removed, and
    the input's columns packed into _row, so that no name of theirs can clash."""
    from tabwright.session import cut_lineage
    docs = docs.select("doc_id", "text", F.col(site_col).alias("_site"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    lines = _lines(docs, "_site")
    spread = cut_lineage(spread_lines(lines, min_sites, lg_k))
    hits = (lines.join(spread, ["_h1", "_h2"], "left_semi").select("_k1", "_k2", "_pos").distinct()
            .groupBy("_k1", "_k2").agg(F.collect_list("_pos").alias("_at")))
    hits = cut_lineage(hits)                                   # positions only; read twice
    keyed = docs.withColumns({"_k1": F.xxhash64(F.lit(1), "doc_id", "text"), "_k2": F.xxhash64(F.lit(2), "doc_id", "text")})
    hits = hits.join(_kept_copies(keyed, hits).withColumn("_keep", F.lit(True)), ["_k1", "_k2"], "left")
    got = keyed.join(hits, ["_k1", "_k2"], "left")
    parts = F.split(F.col("text").cast("string"), "\n")
    got = got.withColumns({"_n_lines": _size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), "_n_spread": _size(F.col("_at")),
                           "_goes": F.col("_at").isNotNull() & F.col("_keep").isNull()})
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_at", i)), "\n")
    return (got.withColumns({"text": F.when(F.col("_goes"), kept).otherwise(F.col("text")),
                             "_n_removed": F.when(F.col("_goes"), F.col("_n_spread")).otherwise(F.lit(0)).cast("long")})
            .select("doc_id", "text", "_n_lines", "_n_spread", "_n_removed", "_row"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_spread, n_removed and the remaining text of every row."""
    return _cut(docs, **options).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_spread").alias("n_spread"),
                                        F.col("_n_removed").alias("n_removed"), "text")


def drop_spread_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the boilerplate lines gone; n_chars, where there is one, follows the text."""
    got = _cut(docs, **options)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return got.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


#: The same rule with an exact count for every line.
ORACLE = r"""
WITH parts AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, raw, pos, source, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM parts),
spread AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 10),
flagged AS (SELECT c.*, s.line IS NOT NULL AS hit FROM lines c LEFT JOIN spread s USING (line)),
per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE hit) AS n_spread,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS rest
  FROM flagged GROUP BY doc_id),
copies AS (
  SELECT min(doc_id) AS doc_id FROM documents JOIN per_doc USING (doc_id) WHERE n_spread > 0 AND n_spread = n_lines
  GROUP BY text HAVING count(*) > 1),
judged AS (
  SELECT d.doc_id, d.text, coalesce(p.n_lines, 0) AS n_lines, coalesce(p.n_spread, 0) AS n_spread, p.rest,
         coalesce(p.n_spread, 0) > 0 AND c.doc_id IS NULL AS goes
  FROM documents d LEFT JOIN per_doc p USING (doc_id) LEFT JOIN copies c USING (doc_id))
SELECT doc_id, n_lines, n_spread, CASE WHEN goes THEN n_spread ELSE 0 END AS n_removed, CASE WHEN goes THEN rest ELSE text END AS text FROM judged
"""
