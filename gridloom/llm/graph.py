"""Connected components by contraction, and sorted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b``; all nodes of a component share the root, one of them.

    Each round sends a node to its least neighbour (or itself), which keeps what is connected together, and goes on
    with the edges between different images. Rounds are written, so lineage stays short; a node with very many edges
    costs one row per task in the grouping. Edges that fall together are not told apart: the grouping takes them as
    one, and a round never has more edges than the last.
    """
    now = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "edges")
    roots = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("image")), "images")
        if roots is None:
            roots = step.withColumnRenamed("image", "root")
        else:
            moved = roots.join(step.withColumnRenamed("node", "root"), "root", "left")
            roots = materialise(moved.select("node", F.coalesce("image", "root").alias("root")), "roots")
        left, right = (step.select(F.col("node").alias(c), F.col("image").alias(f"to_{c}")) for c in "ab")
        images = now.join(left, "a").join(right, "b").where("to_a <> to_b")
        now = materialise(images.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")), "edges")
        if now.isEmpty():
            return roots


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` after more edges than those that ``roots`` came from: only these are worked through, between the
    components that there are."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    over = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = components(over.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    alone = more.join(roots.select("node"), "node", "left_anti")  # had no edge before
    return materialise(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(alone), "roots")
