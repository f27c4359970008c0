"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` -> ``node``, ``root``: every node of an edge, with one node of its component.

    Each round hooks every node to its smallest neighbour, replaces edges by edges between the hooks and drops loops
    and repeats. Nodes should be hashes, so that what is left shrinks by a factor each round. Rounds are written to
    the shared folder; nothing but the question whether edges are left reaches the driver.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        hooks = materialize(hooks.select("node", F.least("node", "m").alias("root")))
        # a second step along the hooks
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
        hooks = materialize(hooks.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        left, right = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if found is None:
            found = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = materialize(found.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
