"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node that has an edge to another node.

    Alternates large stars and small stars: each round hangs neighbours below the smallest node known to
    them, until every component is one star. A node with very many edges is only ever a grouping key of a
    minimum, combined before the shuffle, and a join key whose partition adaptive execution may split.
    Edges with a null end and loops are ignored, repeated edges count once; no edge gives no row.
    """
    e = (
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") < F.col("hi")))
        .distinct()
    )
    seen = None
    while True:
        e = written(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        e = _small_star(_large_star(e))
    star = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return star.union(e.select("lo", F.col("lo").alias("component")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    others = e.join(least, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return others.union(least.select(F.col("m").alias("lo"), "hi")).distinct()
