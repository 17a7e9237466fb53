"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def component_roots(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: long): root is the smallest node of its component.

    Each round points every node at the smallest of itself and its neighbours, doubles pointers
    until none moves (so a chain of n nodes takes log n steps), and rewrites the edges between what
    is pointed at; edges inside a component vanish, so the table shrinks until none is left.  A hub
    meets one row of pointers, so a skewed join of it can be split.  Loops, repeated edges, null
    ends and an empty table are fine.
    """
    spark = edges.sparkSession
    left = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p"))
        parents, moving = written(parents, "parents"), 1
        while moving:
            up = parents.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            followed = written(parents.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parents")
            moving = followed.filter("moved").limit(1).count()
            parents = followed.select("node", "p")
        rounds.append(parents)
        of_a = parents.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        of_b = parents.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = left.join(of_a, "a").join(of_b, "b").filter("pa <> pb")
        left = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    roots = rounds[-1].select("node", F.col("p").alias("root"))
    for parents in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("p"), "root")
        roots = parents.join(later, "p", "left").select("node", F.coalesce("root", "p").alias("root"))
    return roots
