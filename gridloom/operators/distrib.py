"""Histograms, densities and distribution tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ecdf import exact_quantiles
from gridloom.session import attach

# Smoothing width in bins, and the range and bin count shared by the multi-series densities.
SIGMA_BINS = 1.8
COMMON_RANGE = (260.0, 310.0)
COMMON_BINS = 100
# Percentiles of the distribution report.
REPORT_PROBS = {"p00": 0.0, "p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def bin_index(value, lo, hi, bins: int) -> Column:
    """Bin of a value in [lo, hi]; the upper edge belongs to the last bin, values outside give NULL.

    A range without width is half a unit wide on both sides."""
    v, lo, hi = (c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c)) for c in (value, lo, hi))
    lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    at = F.floor((v - lo) * float(bins) / (hi - lo)).cast("int")
    return F.when(v.between(lo, hi), F.least(at, F.lit(bins - 1)))


def histogram(df: DataFrame, keys, bins: int, lo=None, hi=None, value: str = "value") -> DataFrame:
    """Counts and density per bin (empty bins left out); without lo/hi each group spans its own range."""
    keys = list(keys)
    data = df.where(F.col(value).isNotNull())
    if lo is None:
        low, high = F.min(value), F.max(value)  # a constant group gets half a unit on both sides
        span = data.groupBy(*keys).agg(F.when(low == high, low - 0.5).otherwise(low).alias("_lo"), F.when(low == high, high + 0.5).otherwise(high).alias("_hi"))
        data = attach(data, span, keys, derived=True)
        lo, hi = "_lo", "_hi"
    else:
        data = data.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    counted = (
        data.withColumn("bin", bin_index(value, "_lo", "_hi", bins)).where("bin is not null")
        .groupBy(*keys, "_lo", "_hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    # At most ``bins`` rows per group reach this window.
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    width = (F.col("_hi") - F.col("_lo")) / bins
    return counted.withColumn("_total", F.sum("n").over(whole)).select(
        *keys, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("center"), "n",
        (F.col("n") / (F.col("_total") * width)).alias("density"),
    )


def data_range(df: DataFrame, keys=(), value: str = "value", margin: float = 0.02) -> DataFrame:
    """Common range of all series, widened on both sides by 2 % (by 1.0 if it has no width)."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    extra = F.when(wide > 0, wide * margin).otherwise(F.lit(1.0))
    return span.select(*keys, (F.col("_lo") - extra).alias("lo"), (F.col("_hi") + extra).alias("hi"))


def kernel(sigma: float = SIGMA_BINS) -> list[float]:
    """Normalised Gaussian weights at offsets -r..r, r = ceil(3 sigma)."""
    radius = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth(hist: DataFrame, keys, bins: int, sigma: float = SIGMA_BINS) -> DataFrame:
    """Gaussian-smoothed density on all bins, zero beyond the edges.

    Every bin hands its weighted density to its neighbours; nothing is joined pairwise.
    """
    keys, weights = list(keys), kernel(sigma)
    radius = len(weights) // 2
    spread = F.array(*[F.struct(F.lit(k - radius).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    given = hist.withColumn("_s", F.explode(spread)).select(
        *keys, (F.col("bin") + F.col("_s.k")).alias("bin"), (F.col("density") * F.col("_s.w")).alias("d")
    )
    empty = hist.select(*keys).distinct() if keys else hist.agg(F.count(F.lit(1)).alias("_n"))
    empty = empty.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0.0).alias("d"))
    return (
        given.where(F.col("bin").between(0, bins - 1)).unionByName(empty)
        .groupBy(*keys, "bin").agg(F.sum("d").alias("density"))
    )


def density_difference(densities: DataFrame, reference: str, series: str = "series", keys=()) -> DataFrame:
    """Density of every other series minus that of the reference, per bin."""
    ref = densities.where(F.col(series) == reference).select(*keys, "bin", F.col("density").alias("_ref"))
    other = densities.where(F.col(series) != reference)
    return other.join(ref, [*keys, "bin"]).select(*keys, series, "bin", (F.col("density") - F.col("_ref")).alias("difference"))


def quantile_bias(df: DataFrame, reference: str, series: str = "series", keys=(), value: str = "value",
                  probs=(0.05, 0.5, 0.95), names=("q05", "q50", "q95")) -> DataFrame:
    """Quantiles of every series minus those of the reference series."""
    q = exact_quantiles(df, [*keys, series], value, probs)
    ref = q.where(F.col(series) == reference).select(*keys, F.col("quantiles").alias("_ref"))
    joined = q.where(F.col(series) != reference).join(ref, list(keys)) if keys else (
        q.where(F.col(series) != reference).withColumn("_ref", ref.select("_ref").scalar())
    )
    return joined.select(*keys, series, *[(F.col("quantiles")[i] - F.col("_ref")[i]).alias(f"{n}_bias") for i, n in enumerate(names)])


def distribution_stats(df: DataFrame, keys, value: str = "value", probs=REPORT_PROBS) -> DataFrame:
    """Count, mean, population std and exact percentiles per group."""
    keys = list(keys)
    base = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    q = exact_quantiles(df, keys, value, list(probs.values()))
    return base.join(q, keys).select(*keys, "count", "mean", "std", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(probs)])


def edge_days(df: DataFrame, break_date: str, end_date: str, around: int = 2, tail: int = 3, time: str = "time") -> DataFrame:
    """Rows of the days around the period break and of the last days."""
    day = F.to_date(time)
    gap = F.datediff(day, F.lit(break_date).cast("date"))
    last = F.datediff(F.lit(end_date).cast("date"), day)
    return df.where(gap.between(-around, around) | last.between(0, tail - 1))


def series_densities(series: DataFrame, keys=("series",), bins: int = COMMON_BINS, span=COMMON_RANGE, smoothed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Densities of several series on common bins, and the mean of each series."""
    hist = histogram(series, keys, bins, *span)
    curve = smooth(hist, keys, bins) if smoothed else hist.select(*keys, "bin", "density")
    return curve, series.groupBy(*keys).agg(F.avg("value").alias("mean"))


def curve_summary(curves: DataFrame, curve: str = "curve", value: str = "value") -> DataFrame:
    return curves.groupBy(curve).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def threshold_days_bias(df: DataFrame, low: float, high: float, series: str = "series", reference: str = "obs", cell=("iy", "ix")) -> DataFrame:
    """Per cell: share of cold and warm days of every series minus that of the reference."""
    share = df.where("value is not null").groupBy(*cell, series).agg(
        F.avg((F.col("value") < low).cast("double")).alias("cold"), F.avg((F.col("value") > high).cast("double")).alias("warm")
    )
    ref = share.where(F.col(series) == reference).select(*cell, F.col("cold").alias("_c"), F.col("warm").alias("_w"))
    return share.where(F.col(series) != reference).join(ref, list(cell)).select(
        *cell, series, (F.col("cold") - F.col("_c")).alias("cold_days_bias"), (F.col("warm") - F.col("_w")).alias("warm_days_bias")
    )


def future_trend_bias(df: DataFrame, low: float, high: float, cell=("iy", "ix")) -> DataFrame:
    """Additive trend (future - hist) of the corrected series minus that of the raw one, per cell.

    ``df`` holds (period in hist/future, series in raw/corrected, value); statistics are the mean, the 5 %
    and 95 % quantiles and the shares of cold and warm days.
    """
    ok = df.where("value is not null")
    keys = [*cell, "period", "series"]
    base = ok.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.avg((F.col("value") < low).cast("double")).alias("cold_days"),
        F.avg((F.col("value") > high).cast("double")).alias("warm_days"),
    )
    q = exact_quantiles(ok, keys, "value", [0.05, 0.95], cells=True)
    full = base.join(q, keys).select(*keys, "mean", F.col("quantiles")[0].alias("q05"), F.col("quantiles")[1].alias("q95"), "cold_days", "warm_days")
    sign = F.when(F.col("period") == "future", 1.0).otherwise(-1.0) * F.when(F.col("series") == "corrected", 1.0).otherwise(-1.0)
    names = ["mean", "q05", "q95", "cold_days", "warm_days"]
    # All four corners must exist, otherwise there is no trend to compare.
    return full.groupBy(*cell).agg(*[F.when(F.count(n) == 4, F.sum(sign * F.col(n))).alias(f"{n}_trend_bias") for n in names])
