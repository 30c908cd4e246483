"""Connected components with DataFrame operations alone.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014). Each half round is one map-side-combined minimum per node and one join back, so that no node's
neighbours are gathered in one place; hubs are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from burrow.llm.store import discard, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of `edges`, the smallest node that it is connected to.

    Rows with a null end and loops link nothing; nodes that have no other edge aren't returned. An empty table
    gives an empty result. Repeated and reversed edges count once. The node type must be orderable.
    """
    known = written(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while (now := _digest(known)) != before and now[0]:
        stars = _small_star(_large_star(known))
        discard(known)
        known, before = stars, now
    roots = known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(linked.distinct(), "large")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Rows have u > v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    discard(least)
    discard(edges)
    return out
