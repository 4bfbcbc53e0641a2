"""Connected components by alternating star contractions, one shuffle each, tables in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; only nodes that have a link.

    ``links`` holds pairs (a, b) in either order.  A large star hangs every larger neighbour of a
    node on its smallest neighbour, a small star hangs the smaller ones there; both keep what is
    connected, and the pairs become stars around the smallest node of each component.  A node with
    very many neighbours is reduced by a minimum, so it is never gathered into one task."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_least")).select("u", F.least("u", "_least").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "small-star")
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == state:
            break
        state = (seen.n, seen.h)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
