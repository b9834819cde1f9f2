"""Distribution mapping per cell: CDF-t, its running-window and two-variable forms, and gamma fits.

All fits reduce to quantile tables (a fixed number of nodes per cell) computed by distributed counting, so
no cell is ever gathered in one task, however many rows it holds.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import col, count_le, digamma, interpolate, interpolate_each, trigamma
from gridloom.functions.gamma import gamma_cdf
from gridloom.operators import rotations
from gridloom.operators.ecdf import LARGEST, SMALL, exact_quantiles, quantile_table, ranked_values, small_groups
from gridloom.session import attach, materialise

CELL = ["iy", "ix"]
TRAIN = "train_hist"
# Fixed value: fewest values in training and historical test below which a cell is left uncorrected.
MIN_VALUES = 10


def median_fill(df: DataFrame, value: str, keys=CELL, name: str = "filled", minimum: int = MIN_VALUES) -> DataFrame:
    """Add ``filled``: the value, or the median of its group; groups below ``minimum`` values get NULL."""
    keys = list(keys)
    med = exact_quantiles(df, keys, value, [0.5], cells=True).select(*keys, F.col("quantiles")[0].alias("_med"))
    size = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    small = size.join(med, keys, "left")
    out = attach(df, small, keys, "left", derived=True)
    enough = F.col("_n") >= minimum
    return out.withColumn(name, F.when(enough, F.coalesce(F.col(value), F.col("_med")))).drop("_med", "_n")


def _series(bundle: DataFrame, keys, periods) -> DataFrame:
    """Long (keys, series, value): training obs, and sim of every period."""
    obs = F.struct(F.lit("obs").alias("series"), F.when(F.col("period") == TRAIN, F.col("obs")).alias("value"))
    sim = F.struct(F.concat(F.lit("sim_"), F.col("period")).alias("series"), F.when(F.col("period").isin(*periods), F.col("sim")).alias("value"))
    return bundle.select(*keys, F.explode(F.array(obs, sim)).alias("_s")).select(*keys, "_s.series", "_s.value").where("value is not null")


def fit_cdft(bundle: DataFrame, keys=CELL, periods=(TRAIN, "test_hist", "test_future"), steps: int = 100, delta_shift: str = "additive") -> DataFrame:
    """Transfer tables of CDF-t: per (keys, period) arrays ``xs`` -> ``zs`` of steps + 1 nodes.

    For a value at probability p of its own period the corrected value is the p-quantile of
    F_obs(F_hist^-1(F_period)); at node p that is the period quantile found at the historical rank of the
    observed p-quantile. ``delta_shift`` first moves the simulation by the mean training error, so that the
    ranges overlap. Where the observed quantile still lies outside the historical range, the offset at
    the end of the range is kept.
    """
    keys = list(keys)
    series = _series(bundle, keys, periods)
    nodes = quantile_table(series, [*keys, "series"], "value", steps, cells=True)
    means = series.where(F.col("series").isin("obs", f"sim_{TRAIN}")).groupBy(*keys).agg(
        F.avg(F.when(F.col("series") == "obs", F.col("value"))).alias("_mo"),
        F.avg(F.when(F.col("series") != "obs", F.col("value"))).alias("_ms"),
    )
    pick = lambda s: F.max(F.when(F.col("series") == s, F.col("nodes")))
    wide = nodes.groupBy(*keys).agg(
        pick("obs").alias("_obs"), pick(f"sim_{TRAIN}").alias("_hist"), *[pick(f"sim_{p}").alias(f"_{p}") for p in periods]
    ).join(means, keys)
    # Moving both simulated ranges is the same as moving the observed quantile the other way and back.
    if delta_shift == "additive":
        there, back = (lambda y: y - (F.col("_mo") - F.col("_ms"))), (lambda z: z + (F.col("_mo") - F.col("_ms")))
    elif delta_shift == "multiplicative":
        there, back = (lambda y: y * F.try_divide(F.col("_ms"), F.col("_mo"))), (lambda z: z * F.try_divide(F.col("_mo"), F.col("_ms")))
    elif delta_shift == "none":
        there = back = lambda y: y
    else:
        raise ValueError(f"unknown delta_shift '{delta_shift}'")
    per_period = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"_{p}").alias("xs")) for p in periods])).alias("_p")
    long = wide.select(*keys, "_mo", "_ms", "_obs", "_hist", per_period).where("_p.xs is not null and _obs is not null and _hist is not null")
    zs = F.transform(interpolate_each(F.transform("_obs", there), "_hist", "_p.xs", bits=(steps + 1).bit_length()), back)
    return long.select(*keys, "_p.period", "_p.xs", zs.alias("zs"))


def apply_transfer(bundle: DataFrame, transfer: DataFrame, keys=CELL, value: str = "sim", name: str = "corrected", steps: int = 8190) -> DataFrame:
    """Map ``value`` through the transfer table (of ``steps`` + 1 nodes at most) of its keys and period; NULL stays NULL."""
    bits = (steps + 1).bit_length()
    joined = attach(bundle, transfer, [*keys, "period"], "left", derived=True).withColumn("_k", count_le("xs", F.col(value), bits))
    return joined.withColumn(name, interpolate(value, "xs", "zs", "_k")).drop("xs", "zs", "_k")


def cdft(bundle: DataFrame, keys=CELL, steps: int = 100, delta_shift: str = "additive", periods=(TRAIN, "test_hist", "test_future")) -> DataFrame:
    """CDF-t of (period, time, cell, obs, sim) rows: adds ``corrected`` for every period.

    The bundle is read several times and may be costly to make; it is written once.
    """
    bundle = materialise(bundle, "bundle")
    return apply_transfer(bundle, fit_cdft(bundle, keys, periods, steps, delta_shift), keys, steps=steps)


def with_followers(transfer: DataFrame, follows: dict[str, str]) -> DataFrame:
    """The transfer tables, those of a period handed on to the periods that follow it (``{new: fitted}``)."""
    out = transfer
    for new, fitted in follows.items():
        out = out.unionByName(transfer.where(F.col("period") == fitted).withColumn("period", F.lit(new)))
    return out


def fit_guarded_cdft(bundle: DataFrame, keys=CELL, steps: int = 100, minimum: int = MIN_VALUES) -> DataFrame:
    """Transfer tables for the training and the historical test period, to be kept and applied to later data.

    Training uses rows where obs and sim are both there; gaps of the test period take its median. Cells with
    fewer than ``minimum`` training pairs or historical test values get no table.
    """
    keys = list(keys)
    in_train = F.col("period") == TRAIN
    pair = F.col("obs").isNotNull() & F.col("sim").isNotNull()
    past = materialise(bundle.where(F.col("period").isin(TRAIN, "test_hist")).select(*keys, "period", "obs", "sim"), "fit-rows")
    good = past.groupBy(*keys).agg(
        F.count_if(in_train & pair).alias("_nt"), F.count_if(~in_train & F.col("sim").isNotNull()).alias("_nh")
    ).where((F.col("_nt") >= minimum) & (F.col("_nh") >= minimum)).select(*keys)
    kept = attach(past, good, keys, "left_semi", derived=True)
    train = kept.where(in_train & pair).withColumn("filled", F.col("sim"))
    test = median_fill(kept.where(~in_train), "sim", keys, minimum=1)
    fit_rows = materialise(train.unionByName(test).drop("sim").withColumnRenamed("filled", "sim"), "fit-filled")
    return materialise(fit_cdft(fit_rows, keys, (TRAIN, "test_hist"), steps), "transfer")


def guarded_cdft(bundle: DataFrame, keys=CELL, steps: int = 100, minimum: int = MIN_VALUES) -> DataFrame:
    """CDF-t fitted on the training and the historical test period; the future is mapped by the historical fit.

    Cells without a fit stay NULL; so do rows without a simulated value.
    """
    transfer = with_followers(fit_guarded_cdft(bundle, keys, steps, minimum), {"test_future": "test_hist"})
    return apply_transfer(bundle, transfer, list(keys), steps=steps)


def running_windows(time, width: int, step: int) -> Column:
    """Numbers of the day-of-year windows (centred every ``step`` days, ``width`` wide) that hold a day."""
    day = F.dayofyear(col(time))
    centres = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k * step + step / 2.0).alias("c")) for k in range(-(-366 // step))])
    def near(w):
        gap = F.abs(day.cast("double") - 0.5 - w["c"])
        return F.least(gap, 366.0 - gap) <= width / 2.0
    return F.transform(F.filter(centres, near), lambda w: w["k"])


def own_window(time, step: int) -> Column:
    return F.floor((F.dayofyear(col(time)) - 1) / step).cast("int")


def running_window_cdft(bundle: DataFrame, keys=CELL, width: int = 91, step: int = 31, steps: int = 50) -> DataFrame:
    """CDF-t fitted on day-of-year windows; every row is mapped by the window whose centre block holds it."""
    bundle = materialise(bundle, "bundle")
    fit_rows = bundle.withColumn("window", F.explode(running_windows("time", width, step)))
    transfer = fit_cdft(fit_rows, [*keys, "window"], steps=steps)
    own = bundle.withColumn("window", own_window("time", step))
    return apply_transfer(own, transfer, [*keys, "window"], steps=steps)


# --- two variables -------------------------------------------------------------------------------------

def rotation_angles(n: int, seed: int) -> list[float]:
    rng = random.Random(seed)
    return [rng.uniform(0.0, math.pi) for _ in range(n)]


def _delta_tables(rows: DataFrame, keys, steps: int) -> DataFrame:
    """Transfer tables of quantile delta mapping of both axes: (keys, period, xs_u, zs_u, xs_v, zs_v).

    ``rows``: (keys, period, time, kind in obs/sim, u, v). Simulated training values move to the observed quantile of
    their rank; those of other periods keep their distance to the training quantile.
    """
    keys = list(keys)
    group = F.when(F.col("kind") == "obs", "obs").otherwise(F.concat(F.lit("sim_"), F.col("period")))
    long = rows.select(*keys, group.alias("series"), "u", "v").unpivot([*keys, "series"], ["u", "v"], "axis", "value")
    nodes = materialise(quantile_table(long, [*keys, "axis", "series"], "value", steps, cells=True), "nodes")
    pick = lambda s: F.max(F.when(F.col("series") == s, F.col("nodes")))
    base = nodes.where(F.col("series").isin("obs", f"sim_{TRAIN}")).groupBy(*keys, "axis").agg(pick("obs").alias("_o"), pick(f"sim_{TRAIN}").alias("_h"))
    own = nodes.where(F.col("series") != "obs").select(*keys, "axis", F.replace(F.col("series"), F.lit("sim_"), F.lit("")).alias("period"), F.col("nodes").alias("_x"))
    # Corrected node = own node + (observed node - historical node) at the same probability.
    zs = F.transform(F.arrays_zip("_x", "_o", "_h"), lambda e: e["_x"] + (e["_o"] - e["_h"]))
    table = own.join(base, [*keys, "axis"]).select(*keys, "period", "axis", F.col("_x").alias("xs"), zs.alias("zs"))
    return table.groupBy(*keys, "period").agg(
        *[F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{c}_{a}") for a in "uv" for c in ("xs", "zs")])


def _map_axes(rows: DataFrame, tables: DataFrame, keys, steps: int, fitted: str = "period", where=None) -> DataFrame:
    """``u`` and ``v`` of the rows (of those that meet ``where``) mapped by the table of their keys and ``fitted`` period."""
    known = tables.withColumnRenamed("period", fitted)
    joined = attach(rows, known, [*keys, fitted], "left")
    joined = joined.withColumns({f"_k_{a}": count_le(f"xs_{a}", F.col(a), (steps + 1).bit_length()) for a in "uv"})
    new = {a: interpolate(a, F.col(f"xs_{a}"), F.col(f"zs_{a}"), f"_k_{a}") for a in "uv"}
    if where is not None:
        new = {a: F.when(where, e).otherwise(F.col(a)) for a, e in new.items()}
    return joined.withColumns(new).select(*rows.columns)


def _turned(rows: DataFrame, angle: float) -> DataFrame:
    c, s = math.cos(angle), math.sin(angle)
    return rows.withColumns({"u": F.col("u") * c + F.col("v") * s, "v": F.col("v") * c - F.col("u") * s})


def fit_mbcn(bundle: DataFrame, keys=CELL, angles=None, n_rotations: int = 6, seed: int = 0, steps: int = 50, minimum: int = MIN_VALUES,
             largest: int = SMALL) -> DataFrame:
    """The chain of a two-variable correction, written, to be kept and applied to any data: (step, angle, keys, period,
    xs_u, zs_u, xs_v, zs_v). Steps from 0 on are rotations with their transfer tables; step -1 maps without rotation.

    ``bundle``: (period, time, keys, obs_u, obs_v, sim_u, sim_v), of which the training and the historical test period
    are read. Training uses rows with all four values; gaps of the test period take the median of their variable.
    Cells with fewer than ``minimum`` training rows, or rows with both variables in the test period, get no chain.
    ``angles`` fixes the rotations; by default they are drawn from ``seed``. Where all cells are small they are handed over
    whole (``rotations``). Else each step is written, as the next is fitted on what it gives.
    """
    keys = list(keys)
    angles = rotation_angles(n_rotations, seed) if angles is None else list(angles)
    in_train = F.col("period") == TRAIN
    both = F.col("sim_u").isNotNull() & F.col("sim_v").isNotNull()
    four = both & F.col("obs_u").isNotNull() & F.col("obs_v").isNotNull()
    values = ["obs_u", "obs_v", "sim_u", "sim_v"]
    past = bundle.where(F.col("period").isin(TRAIN, "test_hist")).select(*keys, "period", "time", *values)
    if rotations.fits(past, values) and small_groups(past, keys, largest):
        return rotations.fit(past, keys, TRAIN, "test_hist", angles, steps, minimum)
    past = materialise(past, "fit-rows")
    good = past.groupBy(*keys).agg(F.count_if(in_train & four).alias("_nt"), F.count_if(~in_train & both).alias("_nh"))
    kept = attach(past, good.where((F.col("_nt") >= minimum) & (F.col("_nh") >= minimum)).select(*keys), keys, "left_semi", derived=True)
    train, ident = kept.where(in_train & four), [*keys, "period", "time"]
    test = _filled(kept.where(~in_train), [*keys, "period"]).select(*ident, F.lit("sim").alias("kind"), "u", "v")
    pair = lambda k: train.select(*ident, F.lit(k).alias("kind"), F.col(f"{k}_u").alias("u"), F.col(f"{k}_v").alias("v"))
    state = materialise(pair("obs").unionByName(pair("sim")).unionByName(test), "mbcn-start")
    chain = materialise(_delta_tables(state, keys, steps), "mbcn-single").select(F.lit(-1).alias("step"), F.lit(0.0).alias("angle"), "*")
    for i, angle in enumerate(angles):
        turned = _turned(state, angle)
        tables = materialise(_delta_tables(turned, keys, steps), f"mbcn-{i}")
        chain = chain.unionByName(tables.select(F.lit(i).alias("step"), F.lit(angle).alias("angle"), "*"))
        state = materialise(_turned(_map_axes(turned, tables, keys, steps, where=F.col("kind") == "sim"), -angle), f"mbcn-state-{i}")
    return materialise(chain, "mbcn-chain")


def _filled(rows: DataFrame, keys) -> DataFrame:
    """``u`` and ``v``: the simulated variables, gaps filled with the median of the group; rows of a group without any value of
    a variable are left out."""
    out = median_fill(median_fill(rows, "sim_u", keys, "u", 1), "sim_v", keys, "v", 1)
    return out.where("u is not null and v is not null")


def predict_mbcn(chain: DataFrame, rows: DataFrame, keys=CELL, follows: dict[str, str] | None = None, steps: int = 50, largest: int = SMALL) -> DataFrame:
    """``rows`` (period, time, keys, sim_u, sim_v) with corrected_u and corrected_v, by a fitted chain.

    Rows need not have been part of the fit: a period in ``follows`` (by default the future, after the historical test
    period) is mapped by the tables of the period it follows. The values are those of the one-variable mapping, put
    in the order of the rotated result within cell and period, so that each variable keeps its own corrected
    distribution while the pair takes over the observed dependence. Gaps take the median of their variable while ranks are
    formed, and rows with a gap, or of a cell without a chain, are NULL in the end. Where all cells are small they are handed
    over whole (``rotations``), and the result is written.
    """
    keys, follows = list(keys), {"test_future": "test_hist"} if follows is None else follows
    ident = [*keys, "period", "time"]
    fitted = F.col("period")
    for new, old in follows.items():
        fitted = F.when(F.col("period") == new, old).otherwise(fitted)
    plan = sorted((r.step, r.angle) for r in chain.select("step", "angle").distinct().collect())  # one row per step
    if rotations.fits(rows, ["sim_u", "sim_v"]) and dict(chain.dtypes)["xs_u"] == "array<double>" and small_groups(rows, keys, largest):
        return rotations.predict(chain, rows, keys, follows, plan)
    tables = lambda k: chain.where(F.col("step") == k).drop("step", "angle")
    known = attach(rows.select(*ident, "sim_u", "sim_v"), tables(-1).select(*keys).distinct(), keys, "left_semi", derived=True)
    start = materialise(_filled(known, [*keys, "period"]).select(*ident, fitted.alias("_fit"), "u", "v"), "mbcn-rows")
    single = _map_axes(start, tables(-1), keys, steps, "_fit")
    state = start
    for k, angle in plan:
        if k >= 0:
            state = _turned(_map_axes(_turned(state, angle), tables(k), keys, steps, "_fit"), -angle)
    both = single.select(*ident, F.col("u").alias("su"), F.col("v").alias("sv")).join(
        state.select(*ident, F.round("u", 9).alias("ru"), F.round("v", 9).alias("rv")), ident)
    both = materialise(both.where("ru is not null and rv is not null"), "mbcn-mapped")
    out = _reordered(both, keys)
    whole = F.col("sim_u").isNotNull() & F.col("sim_v").isNotNull()
    return rows.join(out, ident, "left").withColumns({f"corrected_{a}": F.when(whole, F.col(f"corrected_{a}")) for a in "uv"})


def _reordered(both: DataFrame, keys, largest: int = SMALL) -> DataFrame:
    """(keys, period, time, corrected_u, corrected_v): within (keys, period) the single value ``s`` of the rank that the rotated value
    ``r`` has, ties by time. Where all groups are small, both orders are sorted as arrays of a group, and meet by position."""
    group = [*keys, "period"]
    ident = [*group, "time"]
    if small_groups(both, group, largest):
        def of(axis):
            order = F.array_sort(F.transform("_rows", lambda e: F.struct(e[f"r{axis}"].alias("r"), e["time"].alias("time"))))
            values = F.array_sort(F.transform("_rows", lambda e: F.struct(F.round(e[f"s{axis}"], 9).alias("r"), e["time"].alias("time"), e[f"s{axis}"].alias("s"))))
            return F.array_sort(F.zip_with(order, values, lambda o, v: F.struct(o["time"].alias("time"), v["s"].alias("s"))))

        rows = both.dropna(subset=group).groupBy(*group).agg(F.collect_list(F.struct("time", "ru", "rv", "su", "sv")).alias("_rows"))
        pairs = F.zip_with(of("u"), of("v"), lambda u, v: F.struct(u["time"].alias("time"), u["s"].alias("corrected_u"), v["s"].alias("corrected_v")))
        return rows.select(*group, F.explode(pairs).alias("_p")).select(*group, "_p.*")
    out = both.select(*ident)
    for axis in "uv":
        order = rank_rows(both.select(*ident, f"r{axis}"), group, f"r{axis}").select(*ident, "_rank")
        values = rank_rows(both.select(*ident, F.round(f"s{axis}", 9).alias("_s"), f"s{axis}"), group, "_s")
        values = values.select(*group, "_rank", F.col(f"s{axis}").alias(f"corrected_{axis}"))
        out = out.join(order.join(values, [*group, "_rank"]).drop("_rank"), ident)
    return out


def mbcn(bundle: DataFrame, keys=CELL, n_rotations: int = 6, seed: int = 0, steps: int = 50, angles=None, minimum: int = MIN_VALUES,
         largest: int = SMALL) -> DataFrame:
    """Two-variable correction by rotations and quantile delta mapping, then rank reordering: ``fit_mbcn`` on the training and
    historical periods, ``predict_mbcn`` on all, the future by the historical fit."""
    bundle = materialise(bundle, "bundle")
    chain = fit_mbcn(bundle, keys, angles, n_rotations, seed, steps, minimum, largest)
    return predict_mbcn(chain, bundle, keys, steps=steps, largest=largest)


def rank_rows(df: DataFrame, keys, value: str, largest: int = LARGEST) -> DataFrame:
    """Add ``_rank`` (1-based, ties by time) within each group.

    Ranks follow from the running counts of the different values. Rows that tie are ranked among themselves by the running
    counts of their times, which are cut as values are, so a value that a third of the rows share stays in no one task.
    Times must tell the rows of a group apart.
    """
    keys = list(keys)
    counts = ranked_values(df, keys, value, largest=largest).select(*keys, value, F.col("n").alias("_ties"), F.col("n_before").alias("_below"))
    placed = materialise(df.join(counts, [*keys, value]), "ranks")
    alone = placed.where("_ties = 1").withColumn("_rank", F.col("_below") + 1)
    tied = placed.where("_ties > 1").withColumn("_at", F.unix_micros(F.col("time").cast("timestamp")))
    times = ranked_values(tied, [*keys, value], "_at", largest=largest).select(*keys, value, "_at", F.col("n_before").alias("_earlier"))
    tied = tied.join(times, [*keys, value, "_at"]).withColumn("_rank", F.col("_below") + F.col("_earlier") + 1)
    names = [*df.columns, "_rank"]
    return alone.select(*names).unionByName(tied.select(*names))


# --- gamma ---------------------------------------------------------------------------------------------

def gamma_fit(df: DataFrame, keys, value: str = "value", threshold: float = 1.0, iterations: int = 4) -> DataFrame:
    """Maximum-likelihood shape ``alpha`` and rate ``beta`` of the values above ``threshold``, per group.

    Location is held at zero. Only the mean and the mean logarithm are aggregated; Newton's method then runs
    on columns. Groups without wet values, or with a single distinct one, give NULL.
    """
    wet = F.when(F.col(value) > threshold, F.col(value))
    sums = df.groupBy(*keys).agg(F.avg(wet).alias("_m"), F.avg(F.ln(wet)).alias("_l"), F.count(wet).alias("n_wet"))
    gap = F.ln("_m") - F.col("_l")
    fit = sums.withColumn("_s", F.when(gap > 1e-12, gap))
    s = F.col("_s")
    start = (3.0 - s + F.sqrt((s - 3.0) * (s - 3.0) + 24.0 * s)) / (12.0 * s)
    steps = F.array(*[F.lit(i) for i in range(iterations)])
    # A fold over the iterations keeps the expression small; chained columns would be multiplied out.
    newton = F.aggregate(steps, start, lambda a, _: a - (F.ln(a) - digamma(a) - s) / (1.0 / a - trigamma(a)))
    fit = fit.withColumn("alpha", newton)
    return fit.select(*keys, "n_wet", "alpha", (F.col("alpha") / F.col("_m")).alias("beta"))


def repair_aberrant(field: DataFrame, value: str, keys=("time",), threshold: float | None = None, factor: float = 8.0) -> DataFrame:
    """Replace values above the threshold by the mean of their 3 x 3 neighbourhood, taken before any repair.

    The default threshold is ``factor`` times the std of all positive values. Only the aberrant cells look
    for neighbours.
    """
    keys = list(keys)
    if threshold is None:
        spread = field.agg(F.stddev_pop(F.when(F.col(value) > 0, F.col(value))).alias("s"))
        limit = spread.select("s").scalar() * F.lit(factor)
    else:
        limit = F.lit(float(threshold))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    bad = field.where(F.col(value) > limit).select(*keys, F.col("iy").alias("_y"), F.col("ix").alias("_x"))
    looked = bad.withColumn("iy", F.explode(F.transform(around, lambda d: F.col("_y") + d))).withColumn("ix", F.explode(F.transform(around, lambda d: F.col("_x") + d)))
    local = looked.join(field.select(*keys, *CELL, F.col(value).alias("_v")), [*keys, *CELL])
    means = local.groupBy(*keys, F.col("_y").alias("iy"), F.col("_x").alias("ix")).agg(F.avg("_v").alias("_mean"))
    return field.join(means, [*keys, *CELL], "left").withColumn(value, F.coalesce(F.col("_mean"), F.col(value))).drop("_mean")


def gamma_parameters(df: DataFrame, value: str = "value", threshold: float = 1.0) -> DataFrame:
    """Yearly gamma fits per cell, aberrant ones repaired, averaged over years: (iy, ix, alpha, beta)."""
    yearly = gamma_fit(df.withColumn("time", F.year("time")), ["time", *CELL], value, threshold)
    repaired = repair_aberrant(repair_aberrant(yearly, "alpha"), "beta")
    return repaired.groupBy(*CELL).agg(F.avg("alpha").alias("alpha"), F.avg("beta").alias("beta"))


def gamma_weighted_mae(pairs: DataFrame, parameters: DataFrame, keys=(), pred: str = "pred", truth: str = "y", ignore: float | None = None) -> DataFrame:
    """Masked mean of abs(y - p) + F(y)^2 * max(0, y - p), F the gamma CDF of the cell; NULL parameters are 1."""
    joined = attach(pairs, parameters.select(*CELL, "alpha", "beta"), CELL, "left", derived=True)
    y, p = F.col(truth), F.col(pred)
    keep = y.isNotNull() & p.isNotNull()
    if ignore is not None:
        keep = keep & (y != ignore)
    cdf = gamma_cdf(F.when(keep, y).cast("double"), F.coalesce("alpha", F.lit(1.0)), F.coalesce("beta", F.lit(1.0)))
    scored = joined.withColumn("_cdf", cdf)
    loss = F.abs(y - p) + F.col("_cdf") * F.col("_cdf") * F.greatest(F.lit(0.0), y - p)
    return scored.groupBy(*keys).agg(F.avg(F.when(keep, loss)).alias("gamma_mae"))


def training_mismatch(obs: DataFrame, sim: DataFrame, on=("time", "iy", "ix")) -> DataFrame:
    """Number of training rows present on one side only (0 when shapes agree)."""
    o = obs.select(*on).withColumn("_o", F.lit(1))
    s = sim.select(*on).withColumn("_s", F.lit(1))
    return o.join(s, list(on), "full_outer").agg(
        F.count_if(F.col("_o").isNull() | F.col("_s").isNull()).alias("unmatched"), F.count("_o").alias("obs_rows"), F.count("_s").alias("sim_rows")
    )


def check_training(obs: DataFrame, sim: DataFrame, on=("time", "iy", "ix")) -> None:
    row = training_mismatch(obs, sim, on).first()
    if row.unmatched:
        raise ValueError(f"training series differ: {row.unmatched} unmatched rows (obs {row.obs_rows}, sim {row.sim_rows})")
