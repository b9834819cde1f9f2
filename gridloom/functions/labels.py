"""Names, units, frequencies and time tokens as column expressions and small driver checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import col

# Accepted spellings of a sampling frequency.
FREQUENCY_ALIASES = {
    "d": "daily", "1d": "daily", "day": "daily", "daily": "daily",
    "h": "hourly", "1h": "hourly", "hr": "hourly", "hour": "hourly", "hourly": "hourly",
    "3hr": "3h", "3hrs": "3h", "3hour": "3h", "3hourly": "3h",
}
# Hours per step and the token used in file names.
FREQUENCY_HOURS = {"hourly": 1, "3h": 3, "6h": 6, "12h": 12, "daily": 24}
FREQUENCY_TOKENS = {"daily": "day", "hourly": "1h", "3h": "3h", "6h": "6h", "12h": "12h"}
# Units by variable.
UNITS = {"tas": "K", "pr": "mm/day", "sfcWind": "m/s", "psl": "Pa"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def frequency_label(c) -> Column:
    """Normal spelling of a frequency; NULL means daily, unknown spellings pass through in lower case."""
    text = F.lower(F.trim(F.coalesce(col(c), F.lit("daily"))))
    return F.coalesce(F.try_element_at(literal_map(FREQUENCY_ALIASES), text), text)


def frequency_hours(c) -> Column:
    return F.try_element_at(literal_map(FREQUENCY_HOURS), frequency_label(c))


def frequency_token(c) -> Column:
    return F.try_element_at(literal_map(FREQUENCY_TOKENS), frequency_label(c))


def resolve_frequency(*candidates) -> Column:
    """First given frequency among the candidates (own setting, output setting, source default), else daily."""
    return frequency_label(F.coalesce(*[col(c) for c in candidates]))


def step_hours(frequency: str | None) -> int:
    text = "daily" if frequency is None else str(frequency).strip().lower()
    label = FREQUENCY_ALIASES.get(text, text)
    if label not in FREQUENCY_HOURS:
        raise ValueError(f"unsupported frequency '{frequency}'; known: {', '.join(FREQUENCY_HOURS)}")
    return FREQUENCY_HOURS[label]


def unit_of(variable) -> Column:
    """Unit of a known variable; fails the job for any other name."""
    unit = F.try_element_at(literal_map(UNITS), col(variable))
    return F.coalesce(unit, F.raise_error(F.concat(F.lit("no unit known for variable "), col(variable))).cast("string"))


def time_token(time, frequency: str | None = "daily") -> Column:
    return F.date_format(col(time), "yyyyMMdd" if step_hours(frequency) == 24 else "yyyyMMddHH")


def times_between(spans: DataFrame, start: str, end: str, frequency: str | None, name: str = "time") -> DataFrame:
    """Explode each span into its steps: start, ..., end + 1 day - step."""
    step = F.expr(f"INTERVAL '{step_hours(frequency)}' HOUR")
    stop = F.col(end).cast("timestamp") + F.expr("INTERVAL '1' DAY") - step
    return spans.withColumn(name, F.explode(F.sequence(F.col(start).cast("timestamp"), stop, step)))


def span_from_name(name) -> tuple[Column, Column]:
    """Start and end date parsed from ``..._YYYYMMDD_YYYYMMDD...`` or ``YYYYMMDD-YYYYMMDD``."""
    pattern = r"(\d{8})[_-](\d{8})"
    start, end = (F.regexp_extract(col(name), pattern, g) for g in (1, 2))
    return F.try_to_date(F.nullif(start, F.lit("")), "yyyyMMdd"), F.try_to_date(F.nullif(end, F.lit("")), "yyyyMMdd")


def date_from_sample_name(name) -> Column:
    digits = F.regexp_extract(col(name), r"sample_(\d{8,10})", 1)
    return F.to_timestamp(F.rpad(digits, 10, "0"), "yyyyMMddHH")


def window_label(window) -> Column:
    """``YYYYMMDD_YYYYMMDD`` to ``YYYY-YYYY``."""
    parts = F.split(col(window), "_")
    return F.concat_ws("-", F.substring(parts[0], 1, 4), F.substring(parts[1], 1, 4))


def display_label(model, labels: dict[str, str]) -> Column:
    """Label of a method: as listed, else a reading of a ``bc_baseline_`` suffix, else the name itself."""
    c = col(model)
    suffix = F.replace(F.regexp_replace(c, "^bc_baseline_", ""), F.lit("_"), F.lit(" "))
    listed = F.try_element_at(literal_map(labels), c)
    return F.coalesce(
        listed, F.when(c.startswith("bc_baseline_"), F.concat(F.lit("BC baseline ("), suffix, F.lit(")"))).otherwise(c)
    )


def variant_source(variant, aliases: dict[str, str], known, unknown: str = "error") -> Column:
    """Model source of a variant name: drop a ``_bc...`` suffix, then follow the alias.

    An unknown name is an error, so that no join loses its rows unseen; with ``unknown="null"`` it gives NULL.
    """
    base = F.split_part(col(variant), F.lit("_bc"), F.lit(1))
    source = F.coalesce(F.try_element_at(literal_map(aliases), base), base)
    other = F.lit(None).cast("string") if unknown == "null" else F.raise_error(F.concat(F.lit("unknown model source: "), source)).cast("string")
    return F.when(source.isNull() | source.isin(list(known)), source).otherwise(other)


def tag_label(tag) -> Column:
    return F.replace(F.trim(F.coalesce(col(tag), F.lit(""))), F.lit(" "), F.lit("_"))


def variable_group(names) -> Column:
    """``"uas, vas"`` to ``uas_vas``; empty parts are dropped."""
    parts = F.transform(F.split(F.coalesce(col(names), F.lit("")), ","), lambda p: F.trim(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), "_")


def inside_extent(lon, lat, extent) -> Column:
    west, east, south, north = extent
    return col(lon).between(west, east) & col(lat).between(south, north)
