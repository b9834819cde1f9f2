"""Marginal, temporal and spatial diagnostics of a prediction against observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import rmse, safe_corr
from gridloom.operators.align import valid_pairs
from gridloom.operators.ecdf import quantiles_of, ranked_values, two_samples, wasserstein_of
from gridloom.operators.ordering import previous_row
from gridloom.session import attach, materialise

CELL = ["iy", "ix"]


def _keyed(df: DataFrame, keys):
    """Ungrouped calls get one constant-valued group column, so that every step is a keyed join."""
    if keys:
        return df, list(keys), False
    # Not NULL, so that joining on it adds no filter below the shared exchanges; not a literal, which Spark
    # would fold, turning the joins into products.
    name = F.coalesce(F.when(F.col("time").isNotNull(), "all"), F.lit("all"))
    return df.withColumn("_series", name), ["_series"], True


def long_series(pairs: DataFrame, keys=()) -> DataFrame:
    return pairs.select(*keys, "obs", "pred").unpivot(list(keys), ["obs", "pred"], "series", "value")


def marginal_metrics(pairs: DataFrame, keys=()) -> DataFrame:
    """Bias, std ratio, bias of the 5/50/95 % quantiles and Wasserstein distance."""
    df, keys, bare = _keyed(valid_pairs(pairs, "obs", "pred"), keys)
    moments = df.groupBy(*keys).agg(
        (F.avg("pred") - F.avg("obs")).alias("bias"), F.try_divide(F.stddev_pop("pred"), F.stddev_pop("obs")).alias("std_ratio")
    )
    # One ranking of both series, with a counter for each.
    ranked = materialise(ranked_values(long_series(df, keys), keys, "value", two_samples(F.col("series") == "obs"), following=("a", "b")), "ranked")
    probs, names = [0.05, 0.5, 0.95], ["q5", "q50", "q95"]
    of = lambda c, name: quantiles_of(ranked, keys, "value", probs, c, f"{c}_next", name)
    qb = of("a", "_q_obs").join(of("b", "_q_pred"), keys)
    qb = qb.select(*keys, *[(F.col("_q_pred")[i] - F.col("_q_obs")[i]).alias(f"{n}_bias") for i, n in enumerate(names)])
    w = wasserstein_of(ranked, keys, "value")
    out = moments.join(qb, keys).join(w, keys)
    return out.drop("_series") if bare else out


def lag1_autocorrelation(pairs: DataFrame, keys=(), max_gap_days: int | None = None) -> DataFrame:
    """Mean over cells of the lag-1 autocorrelation of obs and pred, and their difference.

    Both days of a pair must have both series; a cell needs more than one pair and some variance.
    """
    df, keys, bare = _keyed(valid_pairs(pairs, "obs", "pred"), keys)
    prev = previous_row(df, [*keys, *CELL], "time", ["obs", "pred"])
    if max_gap_days is not None:
        prev = prev.where(F.datediff("time", "time_prev") <= max_gap_days)
    prev = prev.where(F.col("obs_prev").isNotNull())
    cells = prev.groupBy(*keys, *CELL).agg(
        safe_corr("obs_prev", "obs").alias("_o"), safe_corr("pred_prev", "pred").alias("_p")
    )
    out = cells.groupBy(*keys).agg(
        F.avg("_o").alias("autocorr_obs_mean"), F.avg("_p").alias("autocorr_pred_mean"),
        (F.avg("_p") - F.avg("_o")).alias("autocorr_bias_mean"),
    )
    return out.drop("_series") if bare else out


def mean_map_skill(pairs: DataFrame, keys=()) -> DataFrame:
    """Spatial correlation and RMSE of the two time-mean maps over valid cells."""
    df, keys, bare = _keyed(valid_pairs(pairs, "obs", "pred"), keys)
    maps = df.groupBy(*keys, *CELL).agg(F.avg("obs").alias("_o"), F.avg("pred").alias("_p"))
    out = maps.groupBy(*keys).agg(safe_corr("_o", "_p").alias("spatial_corr"), rmse("_p", "_o").alias("spatial_rmse"))
    return out.drop("_series") if bare else out


def value_summary(pairs: DataFrame, keys=(), max_gap_days: int | None = None) -> DataFrame:
    """All diagnostics in one row per ``keys``, with the number of values and of matched days."""
    df, keys, bare = _keyed(valid_pairs(pairs, "obs", "pred"), keys)
    size = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distribution_sample_size"), F.countDistinct(F.to_date("time")).alias("matched_days")
    )
    out = (
        marginal_metrics(df, keys).join(size, keys)
        .join(lag1_autocorrelation(df, keys, max_gap_days), keys, "left").join(mean_map_skill(df, keys), keys, "left")
    )
    return out.drop("_series") if bare else out


def mean_spell_length(series: DataFrame, threshold: float, above: bool = True, keys=(), value: str = "value") -> DataFrame:
    """Mean length of runs of consecutive rows above (below) a threshold, per cell; 0.0 without any run."""
    group = [*keys, *CELL]
    active = F.coalesce((F.col(value) > threshold) if above else (F.col(value) < threshold), F.lit(False)).cast("int")
    flagged = series.select(*group, "time", active.alias("_active"))
    prev = previous_row(flagged, group, "time", ["_active"])
    starts = F.when((F.col("_active") == 1) & (F.coalesce(F.col("_active_prev"), F.lit(0)) == 0), 1).otherwise(0)
    # Every run is named by the number of starts so far, so a run crossing a bucket border stays one run.
    runs = prev.groupBy(*group).agg(F.sum("_active").alias("_days"), F.sum(starts).alias("_runs"))
    return runs.select(*group, F.coalesce(F.try_divide(F.col("_days"), F.col("_runs")), F.lit(0.0)).alias("mean_spell"))


def seeded_sample(pairs: DataFrame, per_day: int, seed: int = 0, total: int | None = None, key: Column | None = None) -> DataFrame:
    """At most ``per_day`` cells of each time step, chosen by a seeded hash; obs and pred keep their pairing.

    ``total`` bounds all steps together: exactly min(total, what ``per_day`` leaves) rows are kept. It is dealt like water
    poured over steps of unequal depth: every step gets the same number, or all it has if that is less; what is left
    over goes one each to the first of the steps that have more, by time. ``key`` orders the cells of a step (by default a
    hash of seed, time and cell); ties go by cell.

    A step is dealt to hash buckets first; each bucket keeps its own first ``per_day`` and only those meet.
    """
    h = F.xxhash64(F.lit(seed), F.col("time"), F.col("iy"), F.col("ix")) if key is None else key
    hashed = pairs.withColumn("_h", h).withColumn("_part", F.pmod(F.xxhash64("_h", *CELL), F.lit(64)))
    first = Window.partitionBy("time", "_part").orderBy("_h", *CELL)
    kept = hashed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_day)
    final = Window.partitionBy("time").orderBy("_h", *CELL)
    ranked = kept.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= per_day)
    if total is None:
        return ranked.select(*pairs.columns)
    quotas = day_quotas(pairs.groupBy("time").agg(F.least(F.count(F.lit(1)), F.lit(per_day)).alias("rows")), total)
    return attach(ranked, quotas, "time").where(F.col("_r") <= F.col("quota")).select(*pairs.columns)


def day_quotas(sizes: DataFrame, total: int) -> DataFrame:
    """``time, quota`` for (time, rows): quotas of at most ``rows`` that add up to min(total, all rows), as even as can be."""
    sizes = materialise(sizes, "day-sizes")
    # As many rows as there are different sizes, none above the cap per step.
    days = sorted((r["rows"], r["n"]) for r in sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("n")).collect())
    level, below, above = 0, 0, sum(n for _, n in days)
    for size, n in days:
        if below + size * above > total:
            break
        level, below, above = size, below + size * n, above - n
    if above:  # the water stands between two sizes
        level, extra = divmod(max(0, total - below), above)
    else:
        extra = 0
    quota = F.least(F.col("rows"), F.lit(level))
    deeper = sizes.where(F.col("rows") > level).orderBy("time").limit(extra).select("time", F.lit(1).alias("more"))
    return attach(sizes, deeper, "time", "left").select("time", (quota + F.coalesce("more", F.lit(0))).alias("quota"))
