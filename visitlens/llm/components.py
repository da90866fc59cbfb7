"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from visitlens.llm.common import written


def _fingerprint(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """`node`, `component` (its smallest node) for every node of an edge with two ends that differ.

    Each round points every neighbour of a node at the smallest one (large star), then every node's smaller
    neighbours (small star), until only stars are left; rounds grow with the logarithm of the longest path. Minima are
    aggregated before they are joined back, and the joins split heavy nodes, so a node may hold any share of the edges.
    Edges with a null end are left out.
    """
    pairs = edges.select(F.col(left).alias("l"), F.col(right).alias("r")).distinct().filter("l != r")
    edges = written(pairs.select(F.greatest("l", "r").alias("u"), F.least("l", "r").alias("v")).distinct())
    known = _fingerprint(edges)
    while known[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        least = written(least)  # a table of its own, so that the join may split heavy nodes
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small)
        before, known = known, _fingerprint(edges)
        if before == known:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
