"""Reading fields: partitioned catalog, scenario routing, spans, windows and coverage checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.timeops import filter_dates
from gridloom.schema import FIELD_DDL
from gridloom.session import attach, settings

# Fixed value: first day served by scenario runs.
SCENARIO_START = "2015-01-01"
HISTORICAL = "historical"
OPEN_FILES = 64  # of one task while a field is written; beyond it Spark sorts by partition


def write_field(field: DataFrame, root: str, mode: str = "append", in_order: bool = False) -> None:
    """Store a field so that source, variable, scenario and year prune at the scan.

    Rows are sorted by time within tasks (unless they come ``in_order``), which makes the Parquet time statistics selective. A
    task keeps its files open side by side, so rows need no further sort by the names of their partition.
    """
    stamped = field.withColumn("year", F.year("time"))
    stamped = stamped if in_order else stamped.sortWithinPartitions("time")
    with settings(field.sparkSession, spark__sql__maxConcurrentOutputFileWriters=OPEN_FILES):
        stamped.write.mode(mode).partitionBy("source", "variable", "scenario", "year").parquet(root)


def open_catalog(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{FIELD_DDL}, year int").parquet(root)


def scan(catalog: DataFrame, source: str, variable: str, start: str | None = None, end: str | None = None, scenarios=None) -> DataFrame:
    """Rows of one series; the year predicate repeats the date window on the partition column."""
    rows = catalog.where((F.col("source") == source) & (F.col("variable") == variable))
    if scenarios is not None:
        rows = rows.where(F.col("scenario").isin(*scenarios))
    if start:
        rows = rows.where(F.col("year") >= int(start[:4]))
    if end:
        rows = rows.where(F.col("year") <= int(end[:4]))
    return filter_dates(rows, start, end)


def require_source(catalog: DataFrame, source: str, variable: str, start: str | None = None, end: str | None = None, scenarios=None) -> DataFrame:
    """:func:`scan`, with an error for an unknown source or a selection that matches nothing."""
    rows = scan(catalog, source, variable, start, end, scenarios)
    if rows.isEmpty():
        if catalog.where(F.col("source") == source).isEmpty():
            raise KeyError(f"unknown source '{source}'")
        raise FileNotFoundError(f"no data for source='{source}', variable='{variable}', from {start} to {end}, scenarios={scenarios}")
    return rows


def scenario_of(time, ssp: str, split: str = SCENARIO_START) -> Column:
    return F.when(F.col(time) < F.lit(split).cast("timestamp"), HISTORICAL).otherwise(ssp)


def scan_routed(catalog: DataFrame, source: str, variable: str, ssp: str, start: str, end: str, split: str = SCENARIO_START) -> DataFrame:
    """Historical rows before the split, scenario rows from it on.

    A part without any data of its own kind falls back to the other kind.
    """
    kinds = {HISTORICAL: ssp, ssp: HISTORICAL}
    day_before = (dt.date.fromisoformat(split) - dt.timedelta(days=1)).isoformat()
    parts = []
    if start < split:
        parts.append((HISTORICAL, start, min(end, day_before)))
    if end >= split:
        parts.append((ssp, max(start, split), end))
    out = None
    for kind, first, last in parts:
        rows = scan(catalog, source, variable, first, last, [kind])
        if rows.isEmpty():
            rows = scan(catalog, source, variable, first, last, [kinds[kind]])
        out = rows if out is None else out.unionByName(rows)
    return out


def concat_in_time(parts: list[DataFrame], standardise=None, day: str | None = None) -> DataFrame:
    """Stack standardised parts along time, keep the requested day, sort; nothing left is an error."""
    out = None
    for part in parts:
        part = part.transform(standardise) if standardise else part
        part = filter_dates(part, day, day) if day else part
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None or out.isEmpty():
        raise FileNotFoundError(f"no time step matches {day}")
    return out.orderBy("time")


def in_span(manifest: DataFrame, requests: DataFrame, year: str = "year") -> DataFrame:
    """Part whose [start_year, end_year] holds the requested year: equi join on the spelled-out years."""
    spelled = manifest.withColumn(year, F.explode(F.sequence("start_year", "end_year")))
    return attach(requests, spelled, year)


def match_counts(manifest: DataFrame, requests: DataFrame, key) -> DataFrame:
    """How many manifest rows each request meets, with the verdict missing / unique / ambiguous."""
    keys = [key] if isinstance(key, str) else list(key)
    found = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return requests.select(*keys).distinct().join(found, keys, "left").select(
        *keys, n.alias("matches"), F.when(n == 0, "missing").when(n == 1, "unique").otherwise("ambiguous").alias("verdict")
    )


def require_unique(manifest: DataFrame, requests: DataFrame, key, what: str = "match") -> None:
    for row in match_counts(manifest, requests, key).where("verdict <> 'unique'").limit(5).collect():
        text = f"expected exactly one {what} for {row.asDict()}, found {row.matches}"
        raise FileNotFoundError(text) if row.matches == 0 else FileExistsError(text)


def stitch_periods(parts: DataFrame, periods, window: tuple[str, str]) -> DataFrame:
    """Rows of a window taken from period parts, each clipped to its own period, sorted by time.

    ``periods`` are (name, start, end); ``parts`` has a ``period`` column.
    """
    start, end = window
    keep = F.lit(False)
    day = F.to_date("time")
    for name, first, last in periods:
        lo, hi = max(start, first), min(end, last)
        if lo <= hi:
            keep = keep | ((F.col("period") == name) & day.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    return parts.where(keep).orderBy("time")


def prediction_window(chunks: DataFrame, start: str, end: str, deduplicate: bool = True) -> DataFrame:
    """Rows of the chunks overlapping a window, clipped to it; a time met twice keeps the earliest chunk.

    ``chunks`` holds (chunk_start, chunk_end, time, iy, ix, value).
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    rows = filter_dates(chunks.where(~((F.col("chunk_end") < a) | (F.col("chunk_start") > b))), start, end)
    if not deduplicate:
        return rows
    first = rows.groupBy("time").agg(F.min("chunk_start").alias("chunk_start"))
    return rows.join(first, ["time", "chunk_start"], "left_semi")


def first_covering(candidates: DataFrame, start: str, end: str, exact: bool = True) -> DataFrame:
    """The best-ranked dataset holding both the first and the last day (``exact``), or spanning them.

    ``candidates`` holds (dataset, rank, time).
    """
    day = F.to_date("time")
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    table = candidates.groupBy("dataset").agg(
        F.min("rank").alias("rank"), F.min(day).alias("first"), F.max(day).alias("last"),
        F.max((day == a).cast("int")).alias("has_first"), F.max((day == b).cast("int")).alias("has_last"),
    )
    covers = (F.col("has_first") == 1) & (F.col("has_last") == 1) if exact else (F.col("first") <= a) & (F.col("last") >= b)
    return table.where(covers).orderBy("rank").limit(1).select("dataset", "rank", "first", "last")


def require_covering(candidates: DataFrame, start: str, end: str, exact: bool = True) -> str:
    row = first_covering(candidates, start, end, exact).first()
    if row is None:
        searched = [r.dataset for r in candidates.groupBy("dataset").agg(F.min("rank").alias("r")).orderBy("r").limit(20).collect()]
        raise FileNotFoundError(f"no dataset covers {start} to {end}; searched: {', '.join(searched)}")
    return row.dataset


def select_dates(field: DataFrame, dates: DataFrame) -> DataFrame:
    """Exactly the wanted days of a field."""
    return field.withColumn("date", F.to_date("time")).join(dates.select("date").distinct(), "date", "left_semi").drop("date")


def absent_dates(field: DataFrame, dates: DataFrame) -> DataFrame:
    have = field.select(F.to_date("time").alias("date")).distinct()
    return dates.select("date").distinct().join(have, "date", "left_anti")


def require_dates(field: DataFrame, dates: DataFrame) -> DataFrame:
    row = absent_dates(field, dates).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first")).first()
    if row.n:
        raise KeyError(f"{row.n} requested dates are missing, the first is {row.first}")
    return select_dates(field, dates)


def series_metadata(meta: DataFrame, fallback_units: dict[str, str] | None = None) -> DataFrame:
    """label = long_name, else standard_name, else variable; unit = own, else the fallback of the variable."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    unit = blank("units")
    if fallback_units:
        table = F.create_map(*[F.lit(x) for kv in fallback_units.items() for x in kv])
        unit = F.coalesce(unit, F.try_element_at(table, F.col("variable")))
    return meta.withColumns({"label": F.coalesce(blank("long_name"), blank("standard_name"), F.col("variable")), "unit": F.coalesce(unit, F.lit(""))})


def with_metadata(field: DataFrame, meta: DataFrame, columns=("label", "unit")) -> DataFrame:
    return attach(field, meta.select("variable", *columns), "variable", "left")


def first_sample(samples: DataFrame, time: str = "time") -> DataFrame:
    """Earliest sample time: a minimum, not a sort."""
    return samples.agg(F.min(time).alias(time))
