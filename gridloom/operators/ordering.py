"""Ordered operators that stay parallel when one series holds most of the rows.

A window over a whole series runs in one task. Here the order column is cut into calendar buckets: the
window runs within (series, bucket), and a small table with one row per bucket carries the state across
bucket borders. Results are the same as those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import col


def calendar_bucket(time, unit: str = "year") -> Column:
    return F.date_trunc(unit, col(time))


def previous_row(df: DataFrame, keys, time: str, columns, unit: str = "month", suffix: str = "_prev") -> DataFrame:
    """Add ``<column>_prev`` from the preceding row of the same series (``lag`` by one)."""
    keys, columns = list(keys), [c for c in columns if c != time]
    bucketed = df.withColumns({"_bucket": calendar_bucket(time, unit), "_carry": F.lit(False)})
    # The last row of each bucket also enters the next bucket of its series, as a row to look back to. A union
    # rather than a join: both branches then read the same exchange.
    known = {*keys, "_bucket", time, *columns}
    tails = (
        bucketed.groupBy(*keys, "_bucket").agg(F.max(time).alias(time), *[F.max_by(c, time).alias(c) for c in columns])
        .withColumn("_bucket", F.lead("_bucket").over(_over(keys, "_bucket"))).where("_bucket is not null")
        .withColumns({f.name: F.lit(None).cast(f.dataType) for f in df.schema.fields if f.name not in known})
        .withColumn("_carry", F.lit(True))
    )
    along = Window.partitionBy(*keys, "_bucket").orderBy(time)
    looked = bucketed.unionByName(tails).withColumns({c + suffix: F.lag(c).over(along) for c in [*columns, time]})
    return looked.where("not _carry").drop("_bucket", "_carry")


def positions(df: DataFrame, keys, order, bucket: Column, name: str = "position") -> DataFrame:
    """Add a 1-based ``row_number`` within each series.

    ``bucket`` must not decrease along ``order``; its counts give the offset of each bucket.
    """
    keys = list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(_over(keys, "_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, [*keys, "_bucket"])
        .select(*[F.col(c) for c in df.columns], (F.col("_offset") + F.col("_inside")).cast("bigint").alias(name))
    )


def running_total(df: DataFrame, keys, time: str, amount: str, name: str, unit: str = "year") -> DataFrame:
    """Add the running sum of ``amount`` along ``time`` within each series."""
    keys = list(keys)
    bucketed = df.withColumn("_bucket", calendar_bucket(time, unit))
    sums = bucketed.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_sum"))
    before = F.sum("_sum").over(_over(keys, "_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.sum(amount).over(
        Window.partitionBy(*keys, "_bucket").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, [*keys, "_bucket"])
        .select(*[F.col(c) for c in df.columns], (F.col("_offset") + F.col("_inside")).alias(name))
    )


def _over(keys, order):
    # One row per bucket and series: bounded by the calendar, never by the row count.
    return (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order)
