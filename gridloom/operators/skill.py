"""Skill scores of paired series (obs, pred), all from mergeable sums and grouped aggregates.

Every function takes ``keys``: extra grouping columns (run, method, window) that are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import rmse, safe_corr
from gridloom.operators.align import valid_pairs
from gridloom.operators.ordering import previous_row
from gridloom.operators.timeops import monthly_mean, season, tag_windows, with_seasons
from gridloom.session import materialise

CELL = ["iy", "ix"]
SEASONS = ["all", "summer", "winter"]


def paired_accumulator(pairs: DataFrame, keys, a: str = "pred", truth: str = "obs") -> DataFrame:
    """Count, means, bias, MAE, RMSE, population stds and correlation; an empty group gives its count only."""
    ok = F.col(a).isNotNull() & F.col(truth).isNotNull()
    x, y = F.when(ok, F.col(a)), F.when(ok, F.col(truth))
    d = x - y
    return pairs.groupBy(*keys).agg(
        F.count(d).alias("count"), F.avg(x).alias("a_mean"), F.avg(y).alias("truth_mean"),
        F.avg(d).alias("bias_a_minus_truth"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.stddev_pop(x).alias("a_std"), F.stddev_pop(y).alias("truth_std"), safe_corr(x, y).alias("corr"),
    )


def by_tag(df: DataFrame, keys, tags: dict, metrics, tag: str = "season") -> DataFrame:
    """One aggregation of ``df`` for several overlapping subsets: a row per ``keys`` and tag that has rows.

    ``tags`` maps names to conditions; ``metrics(only)`` gives aggregates by name, where ``only(column)`` is the column
    within the subset. The rows are read and shuffled once, whatever the number of subsets.
    """
    keys = list(keys)
    aggregates, shapes = [], []
    for i, (name, holds) in enumerate(tags.items()):
        found = metrics(lambda c, holds=holds: F.when(holds, F.col(c) if isinstance(c, str) else c))
        aggregates += [F.count_if(holds).alias(f"_{i}_rows"), *[c.alias(f"_{i}_{m}") for m, c in found.items()]]
        shapes.append(F.struct(F.lit(name).alias(tag), F.col(f"_{i}_rows").alias("_rows"), *[F.col(f"_{i}_{m}").alias(m) for m in found]))
    wide = df.groupBy(*keys).agg(*aggregates).select(*keys, F.explode(F.array(*shapes)).alias("_tag"))
    return wide.where("_tag._rows > 0").select(*keys, "_tag.*").drop("_rows")


def season_tags(time: str = "time") -> dict:
    return {"all": F.lit(True), **{s: F.coalesce(season(time) == s, F.lit(False)) for s in SEASONS[1:]}}


def skill_by_time(pairs: DataFrame, keys=()) -> DataFrame:
    """RMSE over cells and spatial correlation for each time."""
    return valid_pairs(pairs, "obs", "pred").groupBy(*keys, "time").agg(
        rmse("pred", "obs").alias("rmse"), safe_corr("pred", "obs").alias("corr")
    )


def skill_by_cell(pairs: DataFrame, keys=()) -> DataFrame:
    """RMSE, bias and temporal correlation for each cell."""
    return valid_pairs(pairs, "obs", "pred").groupBy(*keys, *CELL).agg(
        rmse("pred", "obs").alias("rmse"), F.avg(F.col("pred") - F.col("obs")).alias("bias"), safe_corr("pred", "obs").alias("corr")
    )


def increments(series: DataFrame, keys=(), values=("value",), max_gap_days: int | None = None, unit: str = "month") -> DataFrame:
    """Day-to-day change ``d_<value>`` per cell, given to the later day; the first day has none. ``unit``: calendar buckets
    that the series are cut into."""
    prev = previous_row(series, [*keys, *CELL], "time", values, unit)
    near = F.lit(True) if max_gap_days is None else F.datediff("time", "time_prev") <= max_gap_days
    return prev.select(
        *keys, "time", *CELL, *values, *[F.when(near, F.col(v) - F.col(f"{v}_prev")).alias(f"d_{v}") for v in values]
    )


def mean_abs_increment(series: DataFrame, keys=(), value: str = "value") -> DataFrame:
    return increments(series, keys, [value]).groupBy(*keys, *CELL).agg(F.avg(F.abs(f"d_{value}")).alias("variability"))


def variability_bias(pairs: DataFrame, keys=(), unit: str = "month") -> DataFrame:
    """Mean absolute increment of the prediction minus that of the observation, per season and cell."""
    steps = increments(valid_pairs(pairs, "obs", "pred"), keys, ["obs", "pred"], unit=unit)
    return by_tag(steps, [*keys, *CELL], season_tags(), lambda only: {
        "variability": F.avg(F.abs(only("d_pred"))) - F.avg(F.abs(only("d_obs")))})


def seasonal_skill(pairs: DataFrame, keys=()) -> tuple[DataFrame, DataFrame]:
    """Per-time and per-cell skill under the tags all / summer / winter."""
    by_time = with_seasons(skill_by_time(pairs, keys))
    by_cell = by_tag(valid_pairs(pairs, "obs", "pred"), [*keys, *CELL], season_tags(), lambda only: {
        "rmse": rmse(only("pred"), only("obs")), "bias": F.avg(only("pred") - only("obs")), "corr": safe_corr(only("pred"), only("obs"))})
    return by_time, by_cell


def skill_summary(pairs: DataFrame, keys=(), unit: str = "month") -> DataFrame:
    """Seven metrics by season: three rows per ``keys``, NULL where a season has no data.

    Temporal correlation is given for the whole series only. ``unit``: calendar buckets that increments are taken in.
    """
    keys = list(keys)
    by_time, by_cell = seasonal_skill(pairs, keys)
    group = [*keys, "season"]
    t = by_time.groupBy(*group).agg(F.avg("rmse").alias("rmse_temporal_mean"), F.avg("corr").alias("corr_spatial_mean"))
    c = by_cell.groupBy(*group).agg(
        F.avg("rmse").alias("rmse_spatial_mean"), F.avg("bias").alias("bias_spatial_mean"),
        F.stddev_pop("bias").alias("bias_spatial_std"),
        F.avg(F.when(F.col("season") == "all", F.col("corr"))).alias("corr_temporal_mean"),
    )
    v = variability_bias(pairs, keys, unit).groupBy(*group).agg(F.avg("variability").alias("variability_mean"))
    # A series without any pair has no row here; one with pairs has all three seasons.
    every = F.explode(F.array(*[F.lit(x) for x in SEASONS])).alias("season")
    frame = t.where("season = 'all'").select(*keys, every)
    return frame.join(t, group, "left").join(c, group, "left").join(v, group, "left").select(
        *group, "rmse_temporal_mean", "rmse_spatial_mean", "bias_spatial_mean", "bias_spatial_std",
        "corr_spatial_mean", "corr_temporal_mean", "variability_mean",
    )


def monthly_pairs(pairs: DataFrame, keys=(), skipna: bool = True) -> DataFrame:
    return monthly_mean(valid_pairs(pairs, "obs", "pred"), [*keys, *CELL], ["obs", "pred"], skipna=skipna)


def monthly_skill_summary(pairs: DataFrame, keys=()) -> DataFrame:
    # A month is one row of a series: buckets of years, as with months every row would also be carried to the next bucket.
    return skill_summary(materialise(monthly_pairs(pairs, keys), "months"), keys, unit="year")


def window_statistics(pairs: DataFrame, windows, method: str = "method") -> DataFrame:
    """Per window and method: days, bias, RMSE, MAE, means and three variability biases."""
    keys = ["window", method]
    valid = valid_pairs(pairs, "obs", "pred")
    d = F.col("pred") - F.col("obs")
    # Sums per time first; windows are tagged on these few rows.
    by_time = valid.groupBy(method, "time").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(d).alias("_d"), F.sum(d * d).alias("_d2"), F.sum(F.abs(d)).alias("_ad"),
        F.sum("pred").alias("_sp"), F.sum("obs").alias("_so"), F.stddev_pop("pred").alias("_dp"), F.stddev_pop("obs").alias("_do"),
    )
    tagged = tag_windows(by_time, windows)
    mean = lambda c: F.sum(c) / F.sum("_n")
    base = tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), mean("_d").alias("mean_bias"), F.sqrt(mean("_d2")).alias("rmse"),
        mean("_sp").alias("mean_value"), mean("_so").alias("truth_mean"), mean("_ad").alias("mean_abs_error"),
        F.avg(F.col("_dp") - F.col("_do")).alias("spatial_variability_bias"),
    )
    yearly = tagged.groupBy(*keys, F.year("time").alias("_year")).agg(F.avg(F.col("_sp") / F.col("_n")).alias("_p"), F.avg(F.col("_so") / F.col("_n")).alias("_o"))
    annual = yearly.groupBy(*keys).agg((F.stddev_pop("_p") - F.stddev_pop("_o")).alias("annual_variability_bias"))
    # A day's change lies in a window if the day before it in the series does too.
    changes = previous_row(valid, [method, *CELL], "time", ["obs", "pred"])
    day, before = F.to_date("time"), F.to_date("time_prev")
    inside = {w: F.coalesce(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")) & (before >= F.lit(a).cast("date")), F.lit(False)) for w, a, b in windows}
    steps = by_tag(changes, [method], inside, lambda only: {
        "day_to_day_variability_bias": F.avg(F.abs(only(F.col("pred") - F.col("pred_prev")))) - F.avg(F.abs(only(F.col("obs") - F.col("obs_prev"))))}, "window")
    return base.join(steps, keys, "left").join(annual, keys, "left")


def masked_errors(df: DataFrame, keys=(), pred: str = "pred", truth: str = "y", ignore: float | None = None, weight=None) -> DataFrame:
    """Masked RMSE and MAE (with the small constant of the metrics) and the root-MSE loss (without it)."""
    # Fixed value: constant added to the mask sum in the metrics.
    eps = 1e-8
    keep = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    if ignore is not None:
        keep = keep & (F.col(truth) != F.lit(ignore))
    w = F.lit(1.0) if weight is None else F.col(weight)
    e = F.col(pred) - F.col(truth)
    mass = F.sum(F.when(keep, w).otherwise(0.0))
    square, absolute = F.sum(F.when(keep, w * e * e).otherwise(0.0)), F.sum(F.when(keep, w * F.abs(e)).otherwise(0.0))
    return df.groupBy(*keys).agg(
        F.sqrt(square / (mass + eps)).alias("rmse"), (absolute / (mass + eps)).alias("mae"),
        F.sqrt(F.try_divide(square, mass)).alias("loss"),
    )


def summarise_metrics(per_sample: DataFrame, metrics=("loss", "rmse", "mae"), keys=()) -> DataFrame:
    """Mean, min, max and count of per-sample metrics, one row per metric."""
    long = per_sample.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n")
    )
