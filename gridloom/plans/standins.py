"""The given tables read as gridded data, once as DataFrames and once as SQL fragments.

A supplier is a grid cell, a ship date a time step, a quantity the observed value. Three formulas of
quantity, tax and discount play the raw, bias-corrected and model series. Events are sub-daily series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIODS = [("train_hist", "1995-01-01", "1998-12-31"), ("test_hist", "1999-01-01", "2000-12-31"), ("test_future", "2001-01-01", "2001-12-31")]
WINDOWS = [("early", "1995-01-01", "1997-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31")]
METHODS = ["raw", "bc", "ml"]
NY, NX = 10, 10

CTES = {
    "line_rows": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_tax, l_discount, "
        "l_shipdate AS time, CAST(l_suppkey // 10 AS INTEGER) AS iy, CAST(l_suppkey % 10 AS INTEGER) AS ix, "
        "CAST((l_suppkey % 100) // 10 AS INTEGER) AS ty, "
        "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE l_quantity END AS obs, "
        "l_quantity * (1 + l_tax - l_discount) AS raw, l_quantity + 10 * (l_tax - l_discount) AS bc, "
        "l_quantity + 2 * (l_tax - l_discount) AS ml FROM lineitem"
    ),
    "daily_points": "SELECT time, iy, ix, avg(obs) AS obs, avg(raw) AS raw, avg(bc) AS bc, avg(ml) AS ml FROM line_rows GROUP BY 1, 2, 3",
    "monthly_points": (
        "SELECT date_trunc('month', time)::TIMESTAMP AS time, iy, ix, avg(obs) AS obs, avg(raw) AS raw, avg(bc) AS bc, avg(ml) AS ml FROM line_rows GROUP BY 1, 2, 3"
    ),
    "tile_points": "SELECT time, ty AS iy, ix, avg(obs) AS obs, avg(raw) AS raw, avg(bc) AS bc, avg(ml) AS ml FROM line_rows GROUP BY 1, 2, 3",
    "valid_points": "SELECT time, iy, ix, obs, raw AS pred FROM daily_points WHERE obs IS NOT NULL",
    "valid_months": "SELECT time, iy, ix, obs, raw AS pred FROM monthly_points WHERE obs IS NOT NULL",
    "method_points": (
        "SELECT 'raw' AS method, time, iy, ix, obs, raw AS pred FROM daily_points WHERE obs IS NOT NULL UNION ALL "
        "SELECT 'bc', time, iy, ix, obs, bc FROM daily_points WHERE obs IS NOT NULL UNION ALL "
        "SELECT 'ml', time, iy, ix, obs, ml FROM daily_points WHERE obs IS NOT NULL"
    ),
    "grid_cells": (
        "SELECT CAST(s_suppkey // 10 AS INTEGER) AS iy, CAST(s_suppkey % 10 AS INTEGER) AS ix, (s_suppkey % 10) * 36.0::DOUBLE AS lon, "
        "80.0::DOUBLE * (s_suppkey // 10 + 1) / (s_suppkey // 10 + 20.0::DOUBLE) AS lat, s_acctbal AS height, s_nationkey AS region FROM supplier"
    ),
    "event_points": "SELECT CAST(user_id // 10 AS INTEGER) AS iy, CAST(user_id % 10 AS INTEGER) AS ix, ts AS time, value, event_type, event_id FROM events",
    "period_points": (
        "SELECT CASE WHEN year(time) <= 1998 THEN 'train_hist' WHEN year(time) <= 2000 THEN 'test_hist' ELSE 'test_future' END AS period, "
        "time, iy, ix, obs, raw, bc, ml FROM daily_points WHERE year(time) BETWEEN 1995 AND 2001"
    ),
    "vector_parts": "SELECT vec_id, label, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v FROM embeddings",
    "channel_values": "SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(table(spark, sf_dir, "lineitem"))


def _described(lines: DataFrame) -> DataFrame:
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    key = F.col("l_suppkey")
    return lines.select(
        "*", F.col("l_shipdate").alias("time"), F.floor(key / 10).cast("int").alias("iy"), (key % 10).cast("int").alias("ix"),
        F.floor((key % 100) / 10).cast("int").alias("ty"),
        F.when(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)), q).alias("obs"),
        (q * (1 + t - d)).alias("raw"), (q + 10 * (t - d)).alias("bc"), (q + 2 * (t - d)).alias("ml"),
    )


def _averages(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("obs", *METHODS)])


def daily_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, iy, ix, obs, raw, bc, ml), one row per day and cell that has data."""
    return _averages(line_rows(spark, sf_dir), "time", "iy", "ix")


def ordered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily_points`` in the order of cells and times, a cell's days of a year in one partition.

    What is then grouped by cell or month is combined before it is shuffled.
    """
    lines = table(spark, sf_dir, "lineitem").withColumn("_year", F.year("l_shipdate"))
    rows = _described(lines.repartition("l_suppkey", "_year"))
    points = _averages(rows, "l_suppkey", "_year", "time", "iy", "ix")
    return points.sortWithinPartitions("iy", "ix", "time").select("time", "iy", "ix", "obs", *METHODS)


def monthly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averages(line_rows(spark, sf_dir), F.date_trunc("month", "time").alias("time"), "iy", "ix")


def tile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily averages on a fixed 10 x 10 grid, to which every supplier contributes."""
    return _averages(line_rows(spark, sf_dir), "time", F.col("ty").alias("iy"), "ix")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_points(spark, sf_dir).select("time", "iy", "ix", "obs", F.col("raw").alias("pred"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_points(spark, sf_dir).select("time", "iy", "ix", "obs", F.col("raw").alias("pred"))


def method_pairs(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    points = (ordered_points if ordered else daily_points)(spark, sf_dir).where("obs is not null")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in METHODS])).alias("m")
    return points.select("time", "iy", "ix", "obs", each).select("m.method", "time", "iy", "ix", "obs", "m.pred")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_points(spark, sf_dir).select("time", "iy", "ix", F.col("obs").alias("value"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    row = F.floor(key / 10)
    return table(spark, sf_dir, "supplier").select(
        F.lit("supplier_grid").alias("grid_id"), row.cast("int").alias("iy"), (key % 10).cast("int").alias("ix"),
        ((key % 10) * 36.0).alias("lon"), (F.lit(80.0) * (row + 1) / (row + 20.0)).alias("lat"),
        F.col("s_acctbal").alias("height"), F.col("s_nationkey").alias("region"),
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.floor(key / 10).cast("int").alias("iy"), (key % 10).cast("int").alias("ix"), F.col("ts").alias("time"), "value", "event_type", "event_id"
    )


def period_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("time")
    period = F.when(year <= 1998, "train_hist").when(year <= 2000, "test_hist").otherwise("test_future")
    return daily_points(spark, sf_dir).where(year.between(1995, 2001)).select(period.alias("period"), "time", "iy", "ix", "obs", *METHODS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e[0].cast("double").alias("u"), e[1].cast("double").alias("v"))


def channel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding positions as channels: (vec_id, label, pos, value)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))
