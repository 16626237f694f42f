"""Connected components by alternating star steps; every step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.storage import discard, stored


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b.

    Large star: the larger neighbours of a node link to its smallest neighbour.
    Small star: the smaller neighbours, and the node, link to it.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    linked = both.join(least, "a")
    if small:
        new = linked.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        new = linked.where("b > a").select(F.col("b").alias("x"), "m")
    return new.where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components", most: int = 64) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Ends when a round changes nothing; the rounds needed grow with the
    logarithm of the longest chain.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(ordered, name)
    for _ in range(most):
        after = stored(_stars(_stars(current, small=False), small=True), name)
        n, was = after.count(), current.count()
        # both are sets of edges: equal sizes and no edge that is new mean that nothing changed
        if n == was and after.join(current, ["a", "b"], "left_anti").isEmpty():
            discard(after)
            break
        discard(current)
        current = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
