"""Difference skill kept up to date as days arrive, and the merge of stored partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import new_path


def difference_sums(pairs: DataFrame, keys=("run",), time: str = "time", step: str = "1 day") -> DataFrame:
    """Mergeable sums per window and run; the same call serves batch and stream."""
    d = F.col("a") - F.col("b")
    return pairs.groupBy(F.window(time, step).alias("_w"), *keys).agg(
        F.count(d).alias("n"), F.sum(F.abs(d)).alias("sum_abs"), F.sum(d * d).alias("sum_sq"), F.max(F.abs(d)).alias("max_abs")
    ).select(F.col("_w.start").alias("window_start"), *keys, "n", "sum_abs", "sum_sq", "max_abs")


def skill_from_sums(sums: DataFrame, keys=("run",)) -> DataFrame:
    """Merge partial sums into one row per run; without any pair only the count is given."""
    n, square, absolute = F.sum("n"), F.sum("sum_sq"), F.sum("sum_abs")
    return sums.groupBy(*keys).agg(
        n.alias("count"), F.try_divide(absolute, n).alias("mean_abs_diff"), F.sqrt(F.try_divide(square, n)).alias("rmse"), F.max("max_abs").alias("max_abs_diff")
    )


def start_skill_stream(stream: DataFrame, path: str, keys=("run",), step: str = "1 day", checkpoint: str | None = None, **trigger):
    """Start a query that writes every batch's window sums below ``path``.

    The sums can be merged, so each batch is aggregated for itself: no state is kept, and a row counts however late it
    comes. A batch is written to its own folder and overwritten on a replay, so a restart neither loses nor doubles rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        timed = batch.withColumn("time", F.col("time").cast("timestamp"))
        difference_sums(timed, keys, step=step).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    checkpoint = checkpoint or new_path(stream.sparkSession, "stream-state")
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def latest_sums(spark, path: str, keys=("run",)) -> DataFrame:
    """The sums of every window over all batches so far."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy("window_start", *keys).agg(
        F.sum("n").alias("n"), F.sum("sum_abs").alias("sum_abs"), F.sum("sum_sq").alias("sum_sq"), F.max("max_abs").alias("max_abs"))
