"""Joins that line up two series, and the checks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import wind_from_direction, wind_speed
from gridloom.session import attach

POINT = ("time", "iy", "ix")


class EmptyResult(ValueError):
    """Nothing left where at least one row is required."""


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail early when a frame is empty; reads no further than the first row."""
    if df.isEmpty():
        raise EmptyResult(message)
    return df


def align(obs: DataFrame, pred: DataFrame, on=POINT, obs_value: str = "obs", pred_value: str = "pred") -> DataFrame:
    """Inner join on common times and cells."""
    return obs.select(*on, obs_value).join(pred.select(*on, pred_value), list(on))


def valid_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where every listed series has a value."""
    return df.dropna(subset=list(columns))


def component_mismatch(u: DataFrame, v: DataFrame, on=POINT) -> DataFrame:
    """Coordinates present in only one of two components, with the side that has them."""
    left = u.select(*on).distinct().withColumn("_u", F.lit(True))
    right = v.select(*on).distinct().withColumn("_v", F.lit(True))
    return (
        left.join(right, list(on), "full_outer").where("_u is null or _v is null")
        .select(*on, F.when(F.col("_u").isNull(), "second").otherwise("first").alias("only_in"))
    )


def join_components(u: DataFrame, v: DataFrame, on=POINT) -> DataFrame:
    """Inner join of two components after checking that their coordinates are equal."""
    odd = component_mismatch(u, v, on).limit(1).collect()
    if odd:
        where = ", ".join(f"{c}={odd[0][c]}" for c in on)
        raise ValueError(f"components are not aligned: {where} only in the {odd[0]['only_in']} one")
    return u.join(v, list(on))


def wind_products(df: DataFrame, u: str = "uas", v: str = "vas") -> DataFrame:
    """Speed and from-direction. The direction is circular: keep it out of linear scores."""
    return df.withColumns({"sfcWind": wind_speed(u, v), "windFromDir": wind_from_direction(u, v)})


def inventory_diff(expected: DataFrame, actual: DataFrame, key: str, allow_extra: bool = False, head: int = 5) -> DataFrame:
    """One row: counts, missing and extra names (first few) and a status."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    a = actual.select(key).distinct().withColumn("_a", F.lit(1))
    both = e.join(a, key, "full_outer")
    lost, extra = F.col("_a").isNull(), F.col("_e").isNull()

    def first_names(condition: Column, name: str) -> DataFrame:
        top = both.where(condition).orderBy(key).limit(head)
        return top.agg(F.concat_ws(",", F.array_sort(F.collect_list(key))).alias(name))

    counts = both.agg(
        F.count("_e").alias("expected_count"), F.count("_a").alias("actual_count"),
        F.count_if(lost).alias("missing_count"), F.count_if(extra).alias("extra_count"),
    )
    bad = F.col("missing_count") > 0
    if not allow_extra:
        bad = bad | (F.col("extra_count") > 0)
    return counts.withColumns({
        "missing_head": first_names(lost, "h").scalar(), "extra_head": first_names(extra, "h").scalar(),
        "status": F.when(bad, "fail").otherwise("ok"),
    })


def run_delta(baseline: DataFrame, candidate: DataFrame, keys, metrics) -> DataFrame:
    """Metric by metric comparison of two runs; a row present on one side only says so."""
    keys = list(keys)

    def long(df, name):
        return df.select(*keys, *metrics).unpivot(keys, list(metrics), "metric", name).withColumn(f"_{name}", F.lit(True))

    joined = long(baseline, "baseline").join(long(candidate, "candidate"), [*keys, "metric"], "full_outer")
    status = (
        F.when(F.col("_baseline").isNull(), "missing_baseline").when(F.col("_candidate").isNull(), "missing_candidate").otherwise("ok")
    )
    return joined.select(*keys, "metric", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("delta"), status.alias("status"))


def archive_parity(candidate: DataFrame, archive: DataFrame, keys=("artifact", "key"), point=POINT) -> DataFrame:
    """Status and difference statistics of two archives per artifact key.

    Numbers are compared in ``value``, other content in ``text`` (exact match). Coordinates present on one
    side only make a shape mismatch.
    """
    keys, point = list(keys), list(point)
    c = candidate.select(*keys, *point, F.col("value").alias("c"), F.col("text").alias("ct"), F.lit(1).alias("_c"))
    a = archive.select(*keys, *point, F.col("value").alias("a"), F.col("text").alias("at"), F.lit(1).alias("_a"))
    both = c.join(a, [*keys, *point], "full_outer")
    d = F.col("c") - F.col("a")
    stats = both.groupBy(*keys).agg(
        F.count("_c").alias("nc"), F.count("_a").alias("na"), F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(d)).alias("mad"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs"),
        F.avg("c").alias("cm"), F.avg("a").alias("am"), F.stddev_pop("c").alias("cs"), F.stddev_pop("a").alias("as_"),
        F.bool_and(F.col("ct").eqNullSafe(F.col("at"))).alias("same"),
        (F.count("ct") + F.count("at") > 0).alias("is_text"),
    )
    status = (
        F.when((F.col("nc") == 0) | (F.col("na") == 0), "missing_key")
        .when((F.col("nc") != F.col("n")) | (F.col("na") != F.col("n")), "shape_mismatch").otherwise("ok")
    )
    out = stats.withColumn("status", status)
    number = (F.col("status") == "ok") & ~F.col("is_text")
    return out.select(
        *keys, "status",
        *[F.when(number, F.col(src)).alias(name) for src, name in (
            ("mad", "mean_abs_diff"), ("rmse", "rmse"), ("max_abs", "max_abs_diff"), ("cm", "candidate_mean"),
            ("am", "archive_mean"), ("cs", "candidate_std"), ("as_", "archive_std"))],
        F.when((F.col("status") == "ok") & F.col("is_text"), F.col("same")).alias("exact_match"),
    )


def cross_period_repeat(samples: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    """Mean absolute difference of paired days of two periods.

    ``pairs`` holds (left_time, right_time). A field repeated across periods shows a difference below
    ``floor`` and fails; a missing side is reported.
    """
    left = samples.select(F.col("time").alias("left_time"), "iy", "ix", F.col("value").alias("l"))
    right = samples.select(F.col("time").alias("right_time"), "iy", "ix", F.col("value").alias("r"))
    met = attach(left, pairs, "left_time", derived=True).join(right, ["right_time", "iy", "ix"])
    diff = met.groupBy("left_time", "right_time").agg(F.avg(F.abs(F.col("l") - F.col("r"))).alias("mean_abs_diff"))
    days = samples.select(F.col("time").alias("_t")).distinct()
    known = (
        pairs.join(days.withColumnRenamed("_t", "left_time").withColumn("_l", F.lit(True)), "left_time", "left")
        .join(days.withColumnRenamed("_t", "right_time").withColumn("_r", F.lit(True)), "right_time", "left")
    )
    status = (
        F.when(F.col("_l").isNull() | F.col("_r").isNull(), "missing")
        .when(F.col("mean_abs_diff").isNull(), "skipped")
        .when(F.col("mean_abs_diff") < floor, "fail").otherwise("ok")
    )
    return known.join(diff, ["left_time", "right_time"], "left").select("left_time", "right_time", "mean_abs_diff", status.alias("status"))
