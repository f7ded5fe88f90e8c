"""Connected components of link tables, by joins and partial minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark.llm.common import settle


def forest_roots(parents: DataFrame) -> DataFrame:
    """``node`` and ``root`` from ``node`` and ``parent``, one parent each and no circles.

    Every round doubles the steps taken, so the rounds grow with the logarithm of the depth.
    """
    jumped = settle(parents.select("node", F.col("parent").alias("root")))
    while True:
        above = jumped.select(F.col("node").alias("root"), F.col("root").alias("above"))
        further = settle(
            jumped.join(above, "root", "left")
            .select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        )
        jumped = further.select("node", "root")
        if not further.where("moved").take(1):
            return jumped


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for all nodes of links ``a``, ``b``; nodes of a component share it.

    In each round every node with a smaller neighbour hangs below the smallest, the trees are
    contracted to their roots, and links between different roots go on to the next round.
    """
    open_ = settle(links.where("a <> b").select("a", "b").distinct())
    found = None
    while open_.take(1):
        both = open_.union(open_.select("b", "a"))
        parents = (
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
            .where("parent < node")
        )
        roots = forest_roots(parents)
        everyone = both.select(F.col("a").alias("node")).distinct()
        step = everyone.join(roots, "node", "left").select(
            "node", F.coalesce("root", "node").alias("root")
        )
        if found is None:
            found = settle(step)
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = settle(
                found.join(onward, "root", "left")
                .select("node", F.coalesce("above", "root").alias("root"))
            )
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        open_ = settle(
            open_.join(left, "a", "left").join(right, "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            .where("a <> b").distinct()
        )
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return found
