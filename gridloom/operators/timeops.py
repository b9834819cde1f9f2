"""Time selection, windows, seasons and temporal aggregation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import col, day_number
from gridloom.functions.labels import step_hours
from gridloom.operators.ordering import calendar_bucket, positions, previous_row, running_total
from gridloom.session import attach

# Edges of the future windows; the last one is clipped to the end of the run.
FUTURE_WINDOWS = [
    ("future_2015_2029", "2015-01-01", "2029-12-31"),
    ("future_2030_2044", "2030-01-01", "2044-12-31"),
    ("future_2045_2059", "2045-01-01", "2059-12-31"),
    ("future_2060_2074", "2060-01-01", "2074-12-31"),
    ("future_2075_2089", "2075-01-01", "2089-12-31"),
    ("future_2090_2100", "2090-01-01", None),
]


def period_windows(start: str, end: str, historical_end: str, future=FUTURE_WINDOWS) -> list[tuple[str, str, str]]:
    """Historical window plus those future windows that begin by ``end`` and reach past the historical end."""
    chosen = [("hist", start, historical_end)]
    for name, first, last in future:
        last = last or end
        if first <= end and last > historical_end:
            chosen.append((name, first, min(last, end)))
    return chosen


def in_dates(time, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive date window, open at a side given as None."""
    day = F.to_date(col(time))
    keep = F.lit(True)
    if start:
        keep = keep & (day >= F.lit(start).cast("date"))
    if end:
        keep = keep & (day <= F.lit(end).cast("date"))
    return keep


def filter_dates(df: DataFrame, start: str | None = None, end: str | None = None, time: str = "time") -> DataFrame:
    """Date window written on the raw column, so that it reaches the scan as a pushed filter.

    String bounds take the type of the column (with or without time zone) and fold to literals.
    """
    if start:
        df = df.where(F.col(time) >= F.lit(start))
    if end:
        next_day = (dt.date.fromisoformat(end) + dt.timedelta(days=1)).isoformat()
        df = df.where(F.col(time) < F.lit(next_day))
    return df


def tag_windows(df: DataFrame, windows, time: str = "time", name: str = "window") -> DataFrame:
    """One row per matching window; windows are (name, start, end) with inclusive dates, and may overlap."""
    table = F.array(*[
        F.struct(F.lit(w).alias("w"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for w, a, b in windows
    ])
    day = F.to_date(F.col(time))
    hits = F.filter(table, lambda x: (x["a"] <= day) & (day <= x["b"]))
    return df.withColumn(name, F.explode(F.transform(hits, lambda x: x["w"])))


def tag_windows_table(df: DataFrame, windows: DataFrame, time: str = "time") -> DataFrame:
    """As :func:`tag_windows` for a table (window, start, end) of any size: equi join on the month, then filter.

    The windows are broadcast if their months are few enough; else AQE splits the months that hold most rows.
    """
    months = windows.withColumn(
        "_month", F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("INTERVAL '1' MONTH")))
    )
    day = F.to_date(F.col(time))
    return (
        attach(df.withColumn("_month", F.trunc(day, "month")), months, "_month")
        .where(day.between(F.col("start"), F.col("end"))).drop("_month", "start", "end")
    )


def season(time) -> Column:
    """summer (Jun-Aug), winter (Dec-Feb) or NULL."""
    m = F.month(col(time))
    return F.when(m.isin(6, 7, 8), "summer").when(m.isin(12, 1, 2), "winter")


def half_year(time) -> Column:
    """Half-year used by the correction diagnostics: Mar-Aug or the rest."""
    return F.when(F.month(col(time)).between(3, 8), "MAMJJA").otherwise("SONDJF")


def with_seasons(df: DataFrame, time: str = "time", name: str = "season") -> DataFrame:
    """Each row once under ``all`` and once under its season, if it has one."""
    own = season(time)
    return df.withColumn(name, F.explode(F.when(own.isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), own))))


def select_times(field: DataFrame, requests: DataFrame, keys=("iy", "ix"), value: str = "value") -> DataFrame:
    """For each requested ``at``: the value at exactly that time, else the first one of the same day.

    The requested times are broadcast after a size check, so the field is not shuffled on the day.
    """
    days = requests.select("at").distinct().withColumn("_day", F.to_date("at"))
    joined = attach(field.withColumn("_day", F.to_date("time")), days, "_day")
    rank = F.struct((F.col("time") != F.col("at")).alias("other"), F.col("time"))
    return joined.groupBy("at", *keys).agg(
        F.min_by(value, rank).alias(value), F.min_by("time", rank).alias("time")
    )


def missing_times(field: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested ``at`` whose day holds no row at all."""
    days = field.select(F.to_date("time").alias("_day")).distinct()
    return requests.withColumn("_day", F.to_date("at")).join(days, "_day", "left_anti").select("at")


def batch_window(df: DataFrame, first: str, last: str, current: str = "daily", target: str = "daily", time: str = "time") -> DataFrame:
    """Rows of a batch of target steps: daily to the end of the last day, else last + target - source step."""
    end = dt.datetime.fromisoformat(last)
    if step_hours(current) == step_hours(target) == 24:
        end += dt.timedelta(days=1, seconds=-1)
    else:
        end += dt.timedelta(hours=step_hours(target) - step_hours(current))
    return df.where(F.col(time).between(F.lit(first), F.lit(end.isoformat(sep=" "))))


def every_n_days(df: DataFrame, start: str, n: int = 7, time: str = "time") -> DataFrame:
    offset = F.datediff(F.to_date(time), F.lit(start).cast("date"))
    return df.where((offset >= 0) & (F.pmod(offset, F.lit(n)) == 0))


def calendar_sample(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """Every 365th day from the start plus 15 January, 15 July and 31 December, within the window."""
    day = F.to_date(F.col(time))
    offset = F.datediff(day, F.lit(start).cast("date"))
    # Stride in days and the calendar days always included.
    chosen = (F.pmod(offset, F.lit(365)) == 0) | F.date_format(day, "MMdd").isin("0115", "0715", "1231")
    return filter_dates(df, start, end, time).where(chosen)


def resample(df: DataFrame, keys, current: str, target: str, how: str = "mean", time: str = "time", value: str = "value") -> DataFrame:
    """Mean or sum over steps of the target frequency; refuses to go finer than the source."""
    if how not in ("mean", "sum"):
        raise ValueError(f"unsupported aggregation '{how}'")
    hours = step_hours(target)
    if hours < step_hours(current):
        raise ValueError(f"data at '{current}' cannot be expanded to the finer '{target}'")
    if hours == step_hours(current):
        return df.select(*keys, time, value)
    step = F.window(time, f"{hours} hours").getField("start").alias(time)
    total = F.avg(value) if how == "mean" else F.sum(value)
    return df.groupBy(*keys, step).agg(total.alias(value))


def daily_mean(df: DataFrame, keys=("iy", "ix"), time: str = "time", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("day", time).alias(time)).agg(F.avg(value).alias(value))


def monthly_mean(df: DataFrame, keys=("iy", "ix"), values=("value",), time: str = "time", skipna: bool = True) -> DataFrame:
    """Mean per calendar month; with ``skipna=False`` a month holding a NULL is NULL."""
    aggs = []
    for v in values:
        mean = F.avg(v)
        aggs.append((mean if skipna else F.when(F.count(v) == F.count(F.lit(1)), mean)).alias(v))
    return df.groupBy(*keys, F.date_trunc("month", time).alias(time)).agg(*aggs)


def split_samples(times: DataFrame, val_start: str, test_start: str, train_start: str | None = None, gap_days: int = 1,
                  time: str = "time") -> DataFrame:
    """train / val / test by position of the sorted distinct times.

    The last ``gap_days`` samples before each boundary belong to no split.
    """
    order = positions(times.select(time).distinct(), [], time, calendar_bucket(time), "position")
    day = F.to_date(F.col(time))

    def first(bound: str):
        return F.min(F.when(day >= F.lit(bound).cast("date"), F.col("position")))

    bounds = order.agg(
        first(train_start).alias("train") if train_start else F.lit(1).cast("bigint").alias("train"),
        first(val_start).alias("val"), first(test_start).alias("test"),
    )
    train, val, test = (bounds.select(c).scalar() for c in ("train", "val", "test"))
    p = F.col("position")
    label = (
        F.when((p >= train) & (p < val - gap_days), "train")
        .when((p >= val) & (p < test - gap_days), "val")
        .when(p >= test, "test")
    )
    return order.withColumn("split", label)


def consecutive_groups(dates: DataFrame, source: str, time: str = "time") -> DataFrame:
    """Number runs of consecutive dates served by the same source part and lying in the same year."""
    table = dates.select(time, source).withColumn("_year", F.year(time))
    prev = previous_row(table, [], time, [source, "_year"])
    changed = F.when(
        F.col(f"{time}_prev").isNull() | ~F.col(source).eqNullSafe(F.col(f"{source}_prev")) | (F.col("_year") != F.col("_year_prev")), 1
    ).otherwise(0)
    flagged = prev.withColumn("_change", changed)
    return running_total(flagged, [], time, "_change", "group_id").select(time, source, "group_id")


def batches(times: DataFrame, size: int, time: str = "time") -> DataFrame:
    """Deal the ordered times into batches of ``size``, numbered from 0."""
    order = positions(times.select(time).distinct(), [], time, calendar_bucket(time), "position")
    return order.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("bigint"))


def nearest_in_time(field: DataFrame, requests: DataFrame, keys=("iy", "ix"), value: str = "value") -> DataFrame:
    """For each request (at, keys) the value nearest in time, however far, ties to the earlier one.

    Requests and field rows meet in calendar months of their series. A request looks back and ahead within its month;
    where the month has nothing on a side, the last or first row of the nearest month that has one is carried to it.
    """
    keys = list(keys)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hit = F.struct(F.col("time"), F.col(value).alias("value"))
    rows = field.where(F.col("time").isNotNull()).select(*keys, micros("time").alias("_us"), calendar_bucket("time", "month").cast("timestamp").alias("_bucket"), F.lit(0).alias("_asks"), hit.alias("_hit"), F.lit(None).cast(dict(requests.dtypes)["at"]).alias("at"))
    asked = requests.select(*keys, "at").distinct().select(*keys, micros("at").alias("_us"), calendar_bucket("at", "month").cast("timestamp").alias("_bucket"), F.lit(1).alias("_asks"), F.lit(None).cast(rows.schema["_hit"].dataType).alias("_hit"), "at")
    both = rows.unionByName(asked)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_us", "_asks")
    near = both.withColumns({
        "_back": F.last("_hit", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_ahead": F.first("_hit", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
    }).where("_asks = 1")
    # One row per series and month.
    months = both.groupBy(*keys, "_bucket").agg(F.min_by("_hit", F.when(F.col("_asks") == 0, F.col("_us"))).alias("_first"), F.max_by("_hit", F.when(F.col("_asks") == 0, F.col("_us"))).alias("_last"))
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_bucket")
    months = months.select(
        *keys, "_bucket", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    found = near.join(months, [*keys, "_bucket"]).withColumns({"_back": F.coalesce("_back", "_earlier"), "_ahead": F.coalesce("_ahead", "_later")})
    gap = lambda c: F.abs(micros(f"{c}.time") - F.col("_us"))
    best = F.when(F.col("_ahead").isNull() | (gap("_back") <= gap("_ahead")), F.col("_back")).otherwise(F.col("_ahead"))
    return found.withColumn("_best", best).where("_best is not null").select("at", *keys, F.col("_best.time").alias("time"), F.col("_best.value").alias(value))
