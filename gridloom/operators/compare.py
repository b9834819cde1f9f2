"""Tables that compare runs, models, methods and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.labels import tag_label
from gridloom.operators.align import valid_pairs
from gridloom.operators.distrib import COMMON_BINS, COMMON_RANGE, bin_index, exact_quantiles
from gridloom.operators.skill import monthly_skill_summary, skill_summary
from gridloom.operators.value import value_summary
from gridloom.session import attach, materialise

QUANTILES = {"q05": 0.05, "q50": 0.5, "q95": 0.95}


def _moments(long: DataFrame, keys) -> DataFrame:
    base = long.groupBy(*keys).agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    q = exact_quantiles(long, keys, "value", list(QUANTILES.values()))
    return base.join(q, keys).select(*keys, "count", "mean", "std", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(QUANTILES)])


def correction_validation_hist(bundle: DataFrame) -> DataFrame:
    """Moments and quantiles of obs / raw / bc per historical period, each against obs.

    ``bundle`` holds (period, obs, raw, bc); only rows with all three count.
    """
    ok = valid_pairs(bundle, "obs", "raw", "bc")
    long = ok.select("period", "obs", "raw", "bc").unpivot(["period"], ["obs", "raw", "bc"], "series", "value")
    stats = _moments(long, ["period", "series"])
    error = ok.groupBy("period").agg(*[
        e for s in ("raw", "bc") for e in (
            F.avg(F.col(s) - F.col("obs")).alias(f"{s}_bias"),
            F.sqrt(F.avg((F.col(s) - F.col("obs")) * (F.col(s) - F.col("obs")))).alias(f"{s}_rmse"))
    ])
    ref = stats.where("series = 'obs'").select("period", *[F.col(c).alias(f"_{c}") for c in ("std", *QUANTILES)])
    own = F.col("series")
    pick = lambda what: F.when(own == "raw", F.col(f"raw_{what}")).when(own == "bc", F.col(f"bc_{what}")).otherwise(0.0)
    return stats.join(error, "period").join(ref, "period").select(
        "period", "series", "count", "mean", "std", *QUANTILES,
        pick("bias").alias("mean_bias_vs_obs"), pick("rmse").alias("rmse_vs_obs"), (F.col("std") - F.col("_std")).alias("std_delta_vs_obs"),
        *[(F.col(q) - F.col(f"_{q}")).alias(f"{q}_bias_vs_obs") for q in QUANTILES],
    )


def correction_validation_future(bundle: DataFrame, hist_period: str, future_period: str) -> DataFrame:
    """Shift of raw and bc in the future period against the historical test period.

    The historical side needs both series in a row; the future side takes each series on its own.
    """
    hist = valid_pairs(bundle.where(F.col("period") == hist_period), "raw", "bc")
    both = hist.unionByName(bundle.where(F.col("period") == future_period))
    long = both.select("period", "raw", "bc").unpivot(["period"], ["raw", "bc"], "series", "value").where("value is not null")
    stats = _moments(long, ["period", "series"])
    names = ["mean", "std", *QUANTILES]
    ref = stats.where(F.col("period") == hist_period).select("series", *[F.col(c).alias(f"_{c}") for c in names])
    return stats.where(F.col("period") == future_period).join(ref, "series").select(
        "period", "series", "count", *names, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_shift_vs_hist_test") for c in names]
    )


def primary_baseline(rows: DataFrame, keys=("model", "window")) -> DataFrame:
    """Best baseline row per key: an empty tag or the label ``bc_baseline`` first, else the first seen."""
    preferred = (F.trim(F.coalesce("bc_tag", F.lit(""))) == "") | (F.col("bc_model") == "bc_baseline")
    rank = F.struct(F.when(preferred, 0).otherwise(1).alias("p"), F.col("seen"))
    payload = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(payload, rank).alias("b")).select(*keys, "b.*")


def with_shared_baseline(models: DataFrame, baselines: DataFrame) -> DataFrame:
    """Attach to each (model, window) its own baseline row, else one borrowed from any model of the window."""
    b = baselines.select("model", "window", "bc_model", "bc_tag", "seen", "bias", "rmse", "corr", "std")
    own = primary_baseline(b).select("model", "window", *[F.col(c).alias(f"own_{c}") for c in ("bias", "rmse", "corr", "std")])
    shared = primary_baseline(b, ("window",)).select("window", *[F.col(c).alias(f"shared_{c}") for c in ("bias", "rmse", "corr", "std")])
    out = models.join(own, ["model", "window"], "left").join(shared, "window", "left")
    has_own = F.col("own_rmse").isNotNull()
    return out.select(
        *models.columns,
        *[F.when(has_own, F.col(f"own_{c}")).otherwise(F.col(f"shared_{c}")).alias(f"bc_{c}") for c in ("bias", "rmse", "corr", "std")],
    )


def model_rollup(chunks: DataFrame) -> DataFrame:
    """Model comparison table from skill chunks.

    ``chunks``: (model, window, comparison, bc_model, bc_tag, seen, bias, rmse, corr, std, truth_std), where
    comparison is ml / raw / bc. Each (model, window) gives one row with ml, raw and bc columns; every distinct
    baseline label of a window gives one more row in which the baseline stands as the model.
    """
    what = ["bias", "rmse", "corr", "std"]
    wide = (
        chunks.where(F.col("comparison").isin("ml", "raw")).groupBy("model", "window").pivot("comparison", ["ml", "raw"])
        .agg(*[F.min_by(c, "seen").alias(c) for c in [*what, "truth_std"]])
        .select("model", "window", *[f"ml_{c}" for c in what], *[f"raw_{c}" for c in ("bias", "rmse", "corr")], F.col("ml_truth_std").alias("truth_std"))
    )
    bc = chunks.where("comparison = 'bc'")
    table = with_shared_baseline(wide, bc)
    by_label = bc.groupBy("window", "bc_model").agg(F.min_by(F.struct(*what), "seen").alias("b")).select(
        "window", F.col("bc_model").alias("_label"), *[F.col(f"b.{c}").alias(f"_{c}") for c in what]
    )
    first = table.groupBy("window").agg(F.min_by(F.struct(*table.columns), "model").alias("r")).select("r.*")
    as_models = first.join(by_label, "window").select(
        F.col("_label").alias("model"), "window", *[F.col(f"_{c}").alias(f"ml_{c}") for c in what],
        *[c for c in table.columns if c not in ("model", "window", *[f"ml_{w}" for w in what])],
    )
    return table.unionByName(as_models).withColumns({
        "rmse_reduction": F.col("raw_rmse") - F.col("ml_rmse"), "bc_rmse_reduction": F.col("raw_rmse") - F.col("bc_rmse"),
    })


def method_ranking(table: DataFrame, model: str = "model", rmse: str = "ml_rmse", bias: str = "ml_bias") -> DataFrame:
    return table.groupBy(model).agg(F.avg(rmse).alias("mean_rmse"), F.max(F.abs(bias)).alias("max_abs_bias"))


def fill_metadata(table: DataFrame, columns, order: str, keys=()) -> DataFrame:
    """Forward then backward fill along ``order``; empty strings count as missing.

    For summary tables: one row per window, so a partition holds no more rows than there are windows.
    """
    fwd = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    out = table.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})
    return out.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(fwd), F.first(c, ignorenulls=True).over(back), F.lit("")) for c in columns
    })


def seasonal_cycle(df: DataFrame, value: str = "value", time: str = "time") -> DataFrame:
    return df.groupBy(F.month(time).alias("month")).agg(F.avg(value).alias("mean"))


def month_year_matrix(df: DataFrame, years, value: str = "value", time: str = "time") -> DataFrame:
    """Mean by month (rows) and year (columns ``y<year>``)."""
    tagged = df.select(F.month(time).alias("month"), F.concat(F.lit("y"), F.year(time).cast("string")).alias("_y"), value)
    return tagged.groupBy("month").pivot("_y", [f"y{y}" for y in years]).agg(F.avg(value))


def metric_matrix(table: DataFrame, metrics, test: str = "test", season: str = "season", seasons=("all", "summer", "winter")) -> DataFrame:
    """One row per metric and test, one column per season."""
    long = table.select(test, season, *metrics).unpivot([test, season], list(metrics), "metric", "value")
    return long.groupBy("metric", test).pivot(season, list(seasons)).agg(F.first("value"))


def box_statistics(detail: DataFrame, keys, value: str = "value") -> DataFrame:
    """Quartiles and extremes behind a box plot."""
    q = exact_quantiles(detail, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select(*keys, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(["low", "q25", "median", "q75", "high"])])


def training_curves(history: DataFrame) -> DataFrame:
    """(epoch, curve, value) rows of the non-null train and validation losses."""
    return history.unpivot(["run", "epoch"], ["train_loss", "val_loss"], "curve", "value").where("value is not null")


def best_epoch(history: DataFrame) -> DataFrame:
    ok = history.where("val_loss is not null")
    best = F.struct("val_loss", "epoch")
    return ok.groupBy("run").agg(F.min_by("epoch", best).alias("best_epoch"), F.min("val_loss").alias("best_val_loss"))


def best_run(history: DataFrame) -> DataFrame:
    """The run and epoch of the smallest validation loss."""
    return history.orderBy(F.col("val_loss").asc_nulls_last(), "run", "epoch").limit(1)


def reference_mean_field(field: DataFrame, part: str, cell=("iy", "ix")) -> DataFrame:
    """Average over parts (files) of each part's first time step."""
    first = field.groupBy(part).agg(F.min("time").alias("time"))
    return attach(field, first, [part, "time"], derived=True).groupBy(*cell).agg(F.avg("value").alias("value"))


def direct_predictions(samples: DataFrame, channel_order: list[str]) -> DataFrame:
    """Pairs in which the last input channel itself stands as the prediction."""
    last = channel_order[-1]
    x = samples.where((F.col("role") == "x") & (F.col("channel") == last)).select("time", "iy", "ix", F.col("value").cast("double").alias("pred"))
    y = samples.where("role = 'y'").select("time", "iy", "ix", F.col("value").cast("double").alias("obs"))
    return x.join(y, ["time", "iy", "ix"])


def uses_direct_predictions(test_name):
    """Whether a test name stands for raw or baseline input scored as it is."""
    c = F.col(test_name) if isinstance(test_name, str) else test_name
    return c.endswith("_raw") | c.startswith("baseline") | (c == "era5_raw")


def density_block(pairs: DataFrame, method: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Densities of obs and pred of all methods on common bins, as (method, series, bin, density).

    One aggregation counts the joint bins of obs and pred, at most (bins + 1) squared rows per method, which can be merged
    over chunks; both margins follow from it. Values outside [lo, hi] fall into no bin; empty bins have density 0.
    """
    counts = pairs.groupBy(method, *[bin_index(c, lo, hi, bins).alias(f"bin_{c}") for c in ("obs", "pred")]).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "joint-bins")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"bin_{c}").alias("bin")) for c in ("obs", "pred")])).alias("s")
    sums = counts.select(method, each, "n").where("s.bin is not null").groupBy(method, "s.series").pivot("s.bin", list(range(bins))).agg(F.sum("n"))
    filled = [F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in range(bins)]
    width = (hi - lo) / bins
    total = sum(filled[1:], filled[0])
    return sums.select(method, "series", F.posexplode(F.transform(F.array(*filled), lambda n: n / (total * width))).alias("bin", "density"))


def comparison_suite(pairs: DataFrame, method: str = "method", density_range: tuple[float, float] = COMMON_RANGE, bins: int = COMMON_BINS) -> DataFrame:
    """Daily, monthly and distribution diagnostics and densities of all methods as (method, block, season, metric, value).
    In the block ``density``, ``season`` names the series and ``metric`` the bin of ``density_range``. The pairs are written
    once, as all blocks read them."""
    keys = [method]
    pairs = materialise(pairs.select(method, "time", "iy", "ix", "obs", "pred"), "pairs")
    names = ["rmse_temporal_mean", "rmse_spatial_mean", "bias_spatial_mean", "bias_spatial_std", "corr_spatial_mean", "corr_temporal_mean", "variability_mean"]

    def long(df, block, ids, cols):
        out = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), list(cols), "metric", "value")
        season = F.col("season") if "season" in ids else F.lit("all")
        return out.select(method, F.lit(block).alias("block"), season.alias("season"), "metric", "value")

    value = value_summary(pairs, keys)
    return (
        long(skill_summary(pairs, keys), "daily", [method, "season"], names)
        .unionByName(long(monthly_skill_summary(pairs, keys), "monthly", [method, "season"], names))
        .unionByName(long(value, "value", [method], [c for c in value.columns if c != method]))
        .unionByName(density_block(pairs, method, *density_range, bins).select(
            method, F.lit("density").alias("block"), F.col("series").alias("season"), F.concat(F.lit("bin_"), F.col("bin")).alias("metric"), F.col("density").alias("value")))
    )


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return df.groupBy(value).agg(F.min(position).alias("first_seen")).orderBy("first_seen")


def preferred_order(models: DataFrame, ranks: DataFrame, model: str = "model", position: str = "first_seen") -> DataFrame:
    """Listed models in their listed order, then the others as first seen."""
    out = attach(models, ranks.select(model, F.col("rank").alias("_rank")), model, "left")
    # Fixed value: any number above every rank.
    out = out.withColumn("order_rank", F.coalesce("_rank", F.lit(1_000_000)))
    return out.drop("_rank").orderBy("order_rank", position)


def split_methods(table: DataFrame, model: str = "model", tag: str = "bc_tag", position: str = "seen") -> DataFrame:
    """Distinct methods marked as baseline or model, with the first non-null tag of each."""
    tagged = F.when(F.col(tag).isNotNull(), F.struct(F.col(position), F.col(tag)))
    kind = F.when(F.col(model).startswith("bc_baseline"), "baseline").otherwise("model")
    return table.groupBy(model).agg(F.min(tagged).alias("_t"), F.min(position).alias("first_seen")).select(
        model, kind.alias("kind"), tag_label(F.col("_t")[tag]).alias(tag), "first_seen"
    )
