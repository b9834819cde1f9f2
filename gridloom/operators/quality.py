"""Data-quality checks as tables of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_lengths(field: DataFrame, expected: int, keys=("source", "variable")) -> DataFrame:
    """Distinct time steps per series against the expected number."""
    return field.groupBy(*keys).agg(F.countDistinct("time").alias("n_times")).withColumns({
        "expected": F.lit(expected).cast("bigint"), "status": F.when(F.col("n_times") == expected, "ok").otherwise("fail"),
    })


def require_time_length(field: DataFrame, expected: int, keys=("source", "variable", "file")) -> None:
    bad = time_lengths(field, expected, keys).where("status = 'fail'").orderBy(*keys).limit(5).collect()
    if bad:
        text = "; ".join(", ".join(f"{k}={r[k]}" for k in keys) + f": {r.n_times} of {expected} time steps" for r in bad)
        raise ValueError(f"unexpected time length: {text}")


def structure(samples: DataFrame, target_until: str | None = None) -> DataFrame:
    """Per date: roles present, extents, finite fraction of x and y, status.

    Both roles are expected up to ``target_until`` (always, if not given), only x after it.
    """
    day = F.to_date("time").alias("date")
    value = F.col("value")
    x, y = F.col("role") == "x", F.col("role") == "y"
    table = samples.groupBy(day).agg(
        F.concat_ws(",", F.array_sort(F.collect_set("role"))).alias("roles"),
        F.countDistinct(F.when(x, F.col("channel"))).alias("channels"),
        F.countDistinct("iy").alias("ny"), F.countDistinct("ix").alias("nx"),
        F.avg(F.when(x, value.isNotNull().cast("double"))).alias("x_finite"), F.avg(F.when(y, value.isNotNull().cast("double"))).alias("y_finite"),
    )
    both = F.lit(True) if target_until is None else F.col("date") <= F.lit(target_until).cast("date")
    expected = F.when(both, "x,y").otherwise("x")
    return table.withColumns({"expected": expected, "status": F.when(F.col("roles") == expected, "ok").otherwise("fail")})


def physical_range(field: DataFrame, low: float = 200.0, high: float = 320.0, keys=()) -> DataFrame:
    """Extremes and mean, PASS when the mean lies strictly between the limits."""
    return field.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")).withColumn(
        "status", F.when((F.col("mean") > low) & (F.col("mean") < high), "PASS").otherwise("FAIL")
    )


def overall_status(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.bool_and(F.col("status").isin("ok", "skipped")), "ok").otherwise("fail").alias("status"))


def missing_outputs(expected: DataFrame, written: DataFrame, key: str = "time") -> DataFrame:
    """Expected outputs not written yet; an empty result means the step can be skipped."""
    return expected.select(key).distinct().join(written.select(key).distinct(), key, "left_anti")


def length_match(values: DataFrame, dates: DataFrame, position: str = "position") -> DataFrame:
    """Whether a metric series and its date list have the same length."""
    v = values.select(position).withColumn("_v", F.lit(1))
    d = dates.select(position).withColumn("_d", F.lit(1))
    return v.join(d, position, "full_outer").agg(
        F.count("_v").alias("n_values"), F.count("_d").alias("n_dates"), F.count_if(F.col("_v").isNull() | F.col("_d").isNull()).alias("unmatched")
    ).withColumn("status", F.when(F.col("unmatched") == 0, "ok").otherwise("fail"))
