"""Positions in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import attach, materialise


def numbered(rows: DataFrame, group: str, order: list[Column], size: Column | None = None) -> DataFrame:
    """Written ``rows`` with ``idx`` (position within the group, from 0) and ``n`` (rows of the group); with ``size``
    also ``ahead``, the sizes before the row in its group.

    Rows that tie in ``order`` come in any order; they are told apart by a number of their own, so that a row repeated
    very often spreads as well. Rows are range-partitioned by (group, order): a group of any share is dealt over
    partitions, and only one row per group and partition is summed up in windows. ``rows`` is written before it is
    sampled for the ranges, and the sorted rows are, which fixes the partitions that the sums refer to. ``group`` holds
    no nulls.
    """
    keys = [F.col(group), *order, F.col("_tie")]
    placed = materialise(rows.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    here = F.monotonically_increasing_id()
    placed = materialise(placed.select("*", F.shiftright(here, 33).alias("_part"), here.bitwiseAND(2**33 - 1).alias("_at"),
                                       (F.lit(0) if size is None else size).cast("bigint").alias("_size")), "ordered")
    blocks = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"), F.sum("_size").alias("_sizes"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    blocks = blocks.select(
        group, "_part", "_first", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"), F.coalesce(F.sum("_sizes").over(before), F.lit(0)).alias("_sizes_before"),
    )
    out = attach(placed, blocks, [group, "_part"], derived=True).withColumn("idx", F.col("_at") + F.col("_shift"))
    names = [F.col(f"`{c}`") for c in rows.columns]
    if size is None:
        return out.select(*names, "idx", "n")
    within = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(*names, "idx", "n", (F.col("_sizes_before") + F.coalesce(F.sum("_size").over(within), F.lit(0))).alias("ahead"))
