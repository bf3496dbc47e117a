"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nodes without an edge are absent.

    In each round every node points to its smallest neighbour, if smaller, and edges
    are moved to what their ends point to; edges inside a node fall away. Node ids
    must not follow the shape of the graph (hash order does not), then the number of
    rounds grows with the logarithm of its size. A node of high degree is a group key
    with map-side minima; nothing but a count reaches the driver.
    """
    left = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    roots = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        step = written(step.select("node", F.least("node", "to").alias("to")), "steps")
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(roots, "roots")
        first = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        second = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = left.join(first, "a").join(second, "b").where("x != y")
        left = written(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
