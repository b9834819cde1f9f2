"""Area means, annual series, climate-change signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import rmse, safe_corr
from gridloom.operators.ordering import calendar_bucket, positions, previous_row
from gridloom.operators.timeops import in_dates

CELL = ["iy", "ix"]


def area_mean(df: DataFrame, keys=(), values=("value",)) -> DataFrame:
    return df.groupBy(*keys, "time").agg(*[F.avg(v).alias(v) for v in values])


def annual_mean(df: DataFrame, keys=(), value: str = "value") -> DataFrame:
    """Yearly mean of the area-mean series."""
    return area_mean(df, keys, [value]).groupBy(*keys, F.year("time").alias("year")).agg(F.avg(value).alias(value))


def annual_variability(df: DataFrame, keys=(), value: str = "value") -> DataFrame:
    """Population std over years of the annual mean area average."""
    return annual_mean(df, keys, value).groupBy(*keys).agg(F.stddev_pop(value).alias("annual_std"))


def time_mean_map(df: DataFrame, keys=(), values=("value",)) -> DataFrame:
    return df.groupBy(*keys, *CELL).agg(*[F.avg(v).alias(v) for v in values])


def change_map(df: DataFrame, reference, future, keys=(), value: str = "value") -> DataFrame:
    """Future minus reference mean per cell in one pass; windows are (start, end) dates."""
    def mean(w):
        return F.avg(F.when(in_dates("time", *w), F.col(value)))

    return df.groupBy(*keys, *CELL).agg((mean(future) - mean(reference)).alias("change"))


def signal_summary(changes: DataFrame, method: str = "method", keys=()) -> DataFrame:
    """Per method: means, bias, RMSE, correlation and stds of its change map against the ``truth`` map.

    ``changes`` holds (method, iy, ix, change, truth_change).
    """
    ok = changes.dropna(subset=["change", "truth_change"])
    return ok.groupBy(*keys, method).agg(
        F.avg("change").alias("mean_change"), F.avg("truth_change").alias("truth_mean_change"),
        F.avg(F.col("change") - F.col("truth_change")).alias("bias"), rmse("change", "truth_change").alias("rmse"),
        safe_corr("change", "truth_change").alias("corr"), F.stddev_pop("change").alias("std"),
        F.stddev_pop("truth_change").alias("truth_std"),
    )


def annual_variability_by_label(df: DataFrame, expected: dict[str, int], value: str = "value") -> DataFrame:
    """Yearly mean of the area-mean absolute day-to-day change for complete labels, one column per label."""
    cells = previous_row(df, ["label", *CELL], "time", [value])
    daily = cells.groupBy("label", "time").agg(F.avg(F.abs(F.col(value) - F.col(f"{value}_prev"))).alias("v"))
    table = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    complete = daily.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == F.try_element_at(table, F.col("label")))
    return (
        daily.join(complete, "label", "left_semi").groupBy(F.year("time").alias("year")).pivot("label", sorted(expected)).agg(F.avg("v"))
    )


def profile_slice(df: DataFrame, first: int = 1001, last: int = 2000, series=("obs", "raw", "corrected")) -> DataFrame:
    """Days ``first``..``last`` (by position in time) of the area means, series side by side."""
    means = area_mean(df, (), series)
    return positions(means, [], "time", calendar_bucket("time")).where(F.col("position").between(first, last))
