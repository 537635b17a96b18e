"""Connected components of a graph held as edges, by stars: each round links all neighbours of a node to the smallest.

Rounds alternate between larger and smaller neighbours until nothing changes; their number grows with the logarithm of the
longest path. A node with very many neighbours is one row per task in the minima, and its edges are joined with one row, a
join that Spark splits. Each round is written to the shared folder, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.session import settle

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), none null: (node, component), the smallest node of each component, for all nodes of edges."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = settle(e.distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        if not e.take(1):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(smaller.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        sign = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(e.select(F.col("u").alias("node"), F.col("v").alias("component"))).distinct()
