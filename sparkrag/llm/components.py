"""Connected components of an edge table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.session import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b of one orderable type): root is the least node reachable.

    Each round points every node at its least neighbour or itself, follows pointers twice, and replaces the ends of
    edges by where they point; what has met disappears, so the table shrinks by rounds. Rounds are written to the
    shared folder, which cuts their lineage. Null ends and loops are dropped; no edges, no rows.
    """
    rounds = []
    left = saved(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        points = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "points")
        for _ in range(2):
            points = points.alias("x").join(points.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", F.col("y.to").alias("to"))
        points = saved(points, "points")
        rounds.append(points)
        moved = left.join(points.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(points.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        left = saved(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.where("1 = 0").select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for later in rounds[1:]:
        out = out.alias("x").join(later.alias("y"), F.col("x.to") == F.col("y.node"), "left").select("x.node", F.coalesce("y.to", "x.to").alias("to"))
    return out.select("node", F.col("to").alias("root"))
