"""Chains of operators that make up the usual jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import finite, geopotential_height
from gridloom.operators import biascorr, compare, distrib, geometry, masks, regrid, samples, signal, skill, timeops
from gridloom.session import attach, materialise
from gridloom.sources import sinks


def read_source(field: DataFrame, grid: DataFrame, domain, data_type: str, mask: DataFrame | None = None, mask_kind: str | None = None,
                source_height: DataFrame | None = None, target_height: DataFrame | None = None) -> DataFrame:
    """Standardise, correct for height, average to days, crop, mask and clean, in this order.

    The height correction comes before the crop, as it needs the whole source grid.
    """
    rows = field.withColumn("value", finite("value"))
    if source_height is not None:
        rows = regrid.lapse_rate_correction(rows, source_height, target_height)
    daily = timeops.daily_mean(rows, ["source", "variable", "iy", "ix"])
    cropped = attach(daily, geometry.crop(grid, domain).select("iy", "ix", "lon", "lat"), ["iy", "ix"])
    if mask is not None:
        cropped = masks.land_sea_mask(cropped, mask, mask_kind)
    return masks.clean_units(cropped.withColumn("data_type", F.lit(data_type)))


def training_samples(target: DataFrame, static: DataFrame, predictors: dict[str, DataFrame], bridge: DataFrame | regrid.Chain) -> DataFrame:
    """Target, elevation and bridged predictors, masked by the target footprint and stacked.

    ``bridge`` holds the chained weights of fine to coarse to target. Fields on every target cell are many times the rows that they
    come from: they are dealt by time and block of cells as they are made, the target with them, and not shuffled again.
    """
    if isinstance(bridge, regrid.Chain):
        lead = next(iter(predictors.values()))
        deal = regrid.Deal.of(bridge, lead.select("time").distinct().count())
        fields = {name: regrid.regrid(df, bridge, renormalise=True, deal=deal) for name, df in predictors.items()}
        stacked = samples.stack_channels(fields, static, target=deal.dealt(target), by=[regrid.BLOCK])
        return masks.footprint_mask(stacked, next(iter(fields)), by=[regrid.BLOCK], targeted=target)
    fields = {name: regrid.regrid(df, bridge, renormalise=True) for name, df in predictors.items()}
    stacked = samples.stack_channels(fields, static, target=target)
    return masks.footprint_mask(stacked, next(iter(fields)))


def simulation_samples(field: DataFrame, current: str, frequency: str, weights: DataFrame, static: DataFrame, channel: str, target: DataFrame | None = None,
                       corrected: DataFrame | None = None, historical_end: str | None = None) -> DataFrame:
    """Raw (and corrected) input on the target grid with elevation; the target for historical dates, or all."""
    steps = timeops.resample(field, ["iy", "ix"], current, frequency)
    fields = {channel: regrid.regrid(steps, weights, renormalise=True)}
    if corrected is not None:
        fields[f"{channel} corrected"] = regrid.regrid(corrected, weights, renormalise=True)
    if target is not None and historical_end:
        target = timeops.filter_dates(target, None, historical_end)
    return samples.stack_channels(fields, static, target=target)


def correction_bundle(sim: DataFrame, reference: DataFrame, reference_to_sim: DataFrame, periods) -> DataFrame:
    """Simulation and the reference regridded to its grid, paired by period."""
    obs = regrid.regrid(reference, reference_to_sim, renormalise=True)
    return sinks.build_bundle(sim, obs, periods)


def corrected_samples(bundle: DataFrame, weights: DataFrame, static: DataFrame, channel: str, target: DataFrame | None = None, guarded: bool = False,
                      pseudo_truth: DataFrame | None = None) -> DataFrame:
    """Correct a bundle, bring it to the target grid and stack it as samples with their ``period``.

    The target is ``target``, or for a perfect-model experiment ``pseudo_truth`` (time, iy, ix, value on the target grid),
    of the times that the bundle has.
    """
    corrected = biascorr.guarded_cdft(bundle) if guarded else biascorr.cdft(bundle)
    corrected = materialise(corrected.select("period", "time", "iy", "ix", F.col("corrected").alias("value")), "corrected")
    # A time belongs to one period.
    periods = corrected.groupBy("time").agg(F.min("period").alias("period"))
    stacked = samples.stack_channels({channel: regrid.regrid(corrected, weights, renormalise=True)}, static, target=pseudo_truth if target is None else target)
    return attach(stacked, periods, "time", derived=True)


def write_and_read(built: DataFrame, path: str, frequency: str = "daily") -> DataFrame:
    """Samples through the sink: what is committed there, each time once."""
    sinks.write_samples(built, path, frequency)
    return sinks.read_samples(built.sparkSession, path)


def prepare_target(target: DataFrame, grid: DataFrame, geopotential: DataFrame, geopotential_grid: DataFrame, domain) -> tuple[DataFrame, DataFrame]:
    """Cropped target and its elevation: geopotential height brought to the target cells bilinearly."""
    kept = geometry.crop(grid, domain)
    height = geopotential.withColumn("value", geopotential_height("value"))
    weights = regrid.bilinear_weights(geopotential_grid, kept)
    elevation = regrid.regrid(height, weights, keys=())
    return attach(target, kept.select("iy", "ix"), ["iy", "ix"]), elevation


def model_evaluation(pairs: DataFrame, windows, reference, future, bins: int = 80) -> dict[str, DataFrame]:
    """Window skill, ranking, window statistics, change signal and densities of one aligned fact.

    ``pairs`` holds (method, time, iy, ix, obs, pred); it is written once, as all parts read it.
    """
    pairs = materialise(pairs.select("method", "time", "iy", "ix", "obs", "pred"), "pairs")
    tagged = timeops.tag_windows(pairs, windows)
    by_window = skill.paired_accumulator(tagged, ["window", "method"])
    change = signal.change_map(pairs, reference, future, ["method"], "pred")
    truth = signal.change_map(pairs, reference, future, ["method"], "obs").withColumnRenamed("change", "truth_change")
    return {
        "skill": by_window,
        "ranking": compare.method_ranking(by_window, "method", "rmse", "bias_a_minus_truth"),
        "window_statistics": skill.window_statistics(pairs, windows),
        "signal": signal.signal_summary(change.join(truth, ["method", "iy", "ix"])),
        "densities": distrib.histogram(tagged.select("window", "method", F.col("pred").alias("value")), ["window", "method"], bins),
    }
