"""Groups of linked rows: connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.session import discard, settle

ROUNDS = 64


def connected(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """links (a long, b long): (node, root) for every node of a link; root is the smallest node that it reaches.

    Each round hooks every node to its smallest smaller neighbour, follows these hooks to their ends, and goes on with the
    ends alone: only nodes without a smaller neighbour are left, so a group is done after a few rounds. Hooks are
    followed by doubling, so a chain of n nodes takes log2(n) steps. A node with very many links is one row per task
    in the minima, and its links are joined with one row, a join that Spark splits. Every step is written to the shared
    folder, and removed when the next one is there; more than `rounds` rounds or steps raise an error, they never give an
    unfinished result. NULL ends and loops link nothing; an empty table gives no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = settle(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "links")
    roots = settle(links.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    for _ in range(rounds):
        if links.isEmpty():
            discard(links)
            return roots
        ends = _followed(settle(links.groupBy("x").agg(F.min("y").alias("up")), "hooks"), rounds)
        x, y = ends.select("x", F.col("up").alias("ux")), ends.select(F.col("x").alias("y"), F.col("up").alias("uy"))
        ux, uy = F.coalesce("ux", "x"), F.coalesce("uy", "y")
        ahead = links.join(x, "x", "left").join(y, "y", "left").where(ux != uy)
        ahead = settle(ahead.select(F.greatest(ux, uy).alias("x"), F.least(ux, uy).alias("y")).distinct(), "links")
        after = roots.join(ends.select(F.col("x").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        after = settle(after, "roots")
        discard(links, roots, ends)
        links, roots = ahead, after
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def _followed(hooks: DataFrame, rounds: int) -> DataFrame:
    """hooks (x, up), up < x: the same with the end of each chain of hooks, settled."""
    for _ in range(rounds):
        on = hooks.select(F.col("x").alias("up"), F.col("up").alias("next"))
        step = hooks.select("x", "up").join(on, "up", "left")
        ahead = settle(step.select("x", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "hooks")
        discard(hooks)
        if ahead.where("moved").isEmpty():
            return ahead
        hooks = ahead
    raise RuntimeError(f"hooks did not settle in {rounds} steps")
