"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step groups the edges by node and points neighbours at the smallest one; grouping is a partial minimum, never a
collected list, and the join behind it is one that Spark splits if a node has very many edges. The edges are written
to the shared checkpoint folder after each round, which also cuts their lineage; the number of rounds grows with the
logarithm of a component's size. Only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import ensure_checkpoint_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) longs -> (node, root): each node of an edge with the smallest node of its component."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(20,0)))")).first())
        # Done when every edge points at a node that points nowhere, and nothing moves any more.
        if now == mark or not now[0]:
            break
        mark = now
        edges = _star(_star(edges, True), False).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
