"""Channel statistics and sample transforms in long form (time, role, channel, iy, ix, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import log10_1p
from gridloom.operators.geometry import crop, pad
from gridloom.operators.masks import footprint_mask
from gridloom.session import attach

# Fixed value: the input channel taken to log10(1 + x).
LOG_CHANNEL = "pr input"


def log_precipitation(df: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    return df.withColumn(value, F.when(F.col(channel) == LOG_CHANNEL, log10_1p(value)).otherwise(F.col(value)))


def channel_statistics(samples: DataFrame, keys=(), channel: str = "channel", value: str = "value") -> DataFrame:
    """Mean, population std, min and max per channel; the precipitation input is taken as log10(1 + x)."""
    logged = log_precipitation(samples, channel, value)
    return logged.where(F.col(value).isNotNull()).groupBy(*keys, channel).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def _is_x(df: DataFrame):
    return (F.col("role") == "x") if "role" in df.columns else F.lit(True)


def standardise(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(x - mean) / std per input channel; targets stay as they are."""
    out = attach(df, stats.select("channel", F.col("mean").alias("_m"), F.col("std").alias("_s")), "channel", "left", derived=True)
    z = F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))
    return out.withColumn("value", F.when(_is_x(df), z).otherwise(F.col("value"))).drop("_m", "_s")


def minmax(df: DataFrame, stats: DataFrame, target_channel: str, output_norm: bool = True, output_range: str = "zero_one") -> DataFrame:
    """Inputs to [0, 1] by their channel range; targets by the range of the last (target) channel, if asked.

    ``output_range='minus_one_one'`` stretches the target to [-1, 1].
    """
    ranges = stats.select("channel", F.col("min").alias("_lo"), F.col("max").alias("_hi"))
    own = F.when(_is_x(df), F.col("channel")).otherwise(F.lit(target_channel))
    out = attach(df.withColumn("_own", own), ranges.withColumnRenamed("channel", "_own"), "_own", "left", derived=True)
    z = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    y = F.col("value")
    if output_norm:
        y = 2.0 * z - 1.0 if output_range == "minus_one_one" else z
    return out.withColumn("value", F.when(_is_x(df), z).otherwise(y)).select(*df.columns)


def inverse_minmax(df: DataFrame, stats: DataFrame, target_channel: str, output_range: str = "zero_one", value: str = "value", clip: bool = True) -> DataFrame:
    """Predictions back to physical units by the target channel's range; [-1, 1] outputs are clipped first."""
    target = stats.where(F.col("channel") == target_channel)
    lo, hi = (target.select(c).scalar() for c in ("min", "max"))
    z = F.col(value)
    if output_range == "minus_one_one":
        z = F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0)) if clip else z
        z = (F.when(F.col(value).isNotNull(), z) + 1.0) / 2.0
    return df.withColumn(value, z * (hi - lo) + lo)


def inverse_minmax_inputs(df: DataFrame, stats: DataFrame) -> DataFrame:
    out = attach(df, stats.select("channel", F.col("min").alias("_lo"), F.col("max").alias("_hi")), "channel", "left", derived=True)
    raw = F.col("value") * (F.col("_hi") - F.col("_lo")) + F.col("_lo")
    return out.withColumn("value", F.when(_is_x(df), raw).otherwise(F.col("value"))).drop("_lo", "_hi")


def mask_inputs(df: DataFrame, fill: float, mask: DataFrame | None = None) -> DataFrame:
    """Inputs to ``fill`` where the target is NULL, or where a given (iy, ix, mask_value) is below 25."""
    if mask is not None:
        out = attach(df, mask.select("iy", "ix", "mask_value"), ["iy", "ix"], "left")
        # Fixed value: share of land below which a cell counts as sea.
        hidden = F.coalesce(F.col("mask_value") < 25, F.lit(False))
    else:
        target = df.where("role = 'y'").groupBy("time", "iy", "ix").agg(F.max("value").alias("mask_value"))
        out = df.join(target, ["time", "iy", "ix"], "left")
        hidden = F.col("mask_value").isNull()
    return out.withColumn("value", F.when(_is_x(df) & hidden, F.lit(fill)).otherwise(F.col("value"))).drop("mask_value")


def fill_missing(df: DataFrame, fill: float, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def crop_samples(samples: DataFrame, grid: DataFrame, domain) -> DataFrame:
    kept = crop(grid, domain).select("iy", "ix")
    return attach(samples, kept, ["iy", "ix"], "left_semi")


def transform_chain(samples: DataFrame, stats: DataFrame, target_channel: str, ny: int, nx: int, fill: float = 0.0,
                    output_norm: bool = True, output_range: str = "zero_one") -> DataFrame:
    """log10, min-max, mask, fill, pad, in that order; used for scoring and evaluation alike."""
    return (
        samples.transform(log_precipitation)
        .transform(minmax, stats, target_channel, output_norm, output_range)
        .transform(mask_inputs, fill)
        .transform(fill_missing, fill)
        .transform(pad, ny, nx, fill, ("time", "role", "channel"))
    )
