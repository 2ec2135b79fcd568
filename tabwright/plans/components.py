"""Connected components of an edge list, in rounds that grow with the logarithm of the longest path.

Alternating star contraction (large-star, small-star): every vertex hooks its larger, then its smaller
neighbours onto the smallest vertex it knows, until the edges are stars around each component's smallest
vertex.  There is no limit on rounds; the edge list never grows.  Each round is written to the shared
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                           F.max("u"), F.min("v")).first())


def component_labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every vertex of an edge that joins two different vertices; component = smallest id.

    Null ends and loops are ignored; vertices without an edge don't appear."""
    x, y = F.col(a), F.col(b)
    e = cut_lineage(edges.where(x.isNotNull() & y.isNotNull() & (x != y))
                    .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = cut_lineage(small)
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
