"""Grids, coordinates, crops and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import col, wrap_longitude
from gridloom.functions.labels import inside_extent
from gridloom.session import attach

# Source spellings of coordinate names.
COORDINATE_ALIASES = {
    "lon": ["lon", "longitude", "nav_lon"],
    "lat": ["lat", "latitude", "nav_lat"],
    "x": ["x", "i", "ni", "xh", "nlon"],
    "y": ["y", "j", "nj", "yh", "nlat"],
}


def standard_coordinates(df: DataFrame) -> DataFrame:
    """Rename known coordinate spellings to lon/lat/x/y; lon/lat fall back to x/y when absent."""
    present = set(df.columns)
    renames = {}
    for standard, spellings in COORDINATE_ALIASES.items():
        found = next((s for s in spellings if s in present), None)
        if found and found != standard:
            renames[found] = standard
    out = df.withColumnsRenamed(renames)
    for geographic, axis in (("lon", "x"), ("lat", "y")):
        if geographic not in out.columns and axis in out.columns:
            out = out.withColumn(geographic, F.col(axis).cast("double"))
    return out


def wrap_grid(grid: DataFrame) -> DataFrame:
    """Longitudes to [-180, 180); ``ix`` is renumbered so that longitude grows with it (1-D axis)."""
    wrapped = grid.withColumn("lon", wrap_longitude("lon"))
    # One row per distinct longitude: the length of an axis, not of the grid.
    axis = wrapped.select("lon").distinct()
    axis = axis.withColumn("_ix", F.row_number().over(Window.orderBy("lon")) - 1)
    return attach(wrapped, axis, "lon").withColumn("ix", F.col("_ix").cast("int")).drop("_ix").select(*grid.columns)


def flip_latitude(df: DataFrame, n_rows: int) -> DataFrame:
    return df.withColumn("iy", (F.lit(n_rows - 1) - F.col("iy")).cast("int"))


def crop(df: DataFrame, domain, margin: float = 0.0) -> DataFrame:
    """Keep rows inside (west, east, south, north), all four edges included, widened by ``margin``."""
    west, east, south, north = domain
    return df.where(inside_extent("lon", "lat", (west - margin, east + margin, south - margin, north + margin)))


def crop_curvilinear(field: DataFrame, grid: DataFrame, domain, values=("value",)) -> DataFrame:
    """Crop on a 2-D coordinate grid.

    Keeps the columns that hold some longitude and the rows that hold some latitude of the domain; cells of
    that rectangle outside the domain keep their place with NULL values.
    """
    west, east, south, north = domain
    cols = grid.where(F.col("lon").between(west, east)).select("ix").distinct()
    rows = grid.where(F.col("lat").between(south, north)).select("iy").distinct()
    kept = (
        grid.join(cols, "ix", "left_semi").join(rows, "iy", "left_semi")
        .select("iy", "ix", "lon", "lat", inside_extent("lon", "lat", domain).alias("_inside"))
    )
    out = attach(field, kept, ["iy", "ix"])
    return out.withColumns({v: F.when(F.col("_inside"), F.col(v)) for v in values}).drop("_inside")


def axis_bounds(axis: DataFrame, coord: str, keys=()) -> DataFrame:
    """Cell edges of a 1-D axis: midpoints inside, half a step beyond the first and last point."""
    # An axis has one row per grid line; the window never sees field data.
    w = Window.partitionBy(*keys).orderBy(coord)
    c, before, after = F.col(coord), F.lag(coord).over(w), F.lead(coord).over(w)
    low = F.coalesce((before + c) / 2, c - (after - c) / 2)
    high = F.coalesce((c + after) / 2, c + (c - before) / 2)
    return axis.select("*", low.alias("lo"), high.alias("hi"))


def grid_with_bounds(grid: DataFrame) -> DataFrame:
    """Add lon_lo, lon_hi, lat_lo, lat_hi to a rectilinear grid."""
    lon = axis_bounds(grid.select("lon").distinct(), "lon").select("lon", F.col("lo").alias("lon_lo"), F.col("hi").alias("lon_hi"))
    lat = axis_bounds(grid.select("lat").distinct(), "lat").select("lat", F.col("lo").alias("lat_lo"), F.col("hi").alias("lat_hi"))
    return attach(attach(grid, lon, "lon"), lat, "lat")


def grid_signature(grid: DataFrame) -> DataFrame:
    """``NxM_lonmin_lonmax_latmin_latmax`` of each grid, coordinates to six decimals."""
    return grid.groupBy("grid_id").agg(
        F.format_string(
            "%dx%d_%.6f_%.6f_%.6f_%.6f",
            F.countDistinct("lon"), F.countDistinct("lat"),
            F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"),
        ).alias("signature")
    )


def projected_axes(df: DataFrame, borrowed: DataFrame | None = None, in_km: bool = False) -> DataFrame:
    """Fill missing projected coordinates: own x/y, else those of another part, else index * 1000 m."""
    scale = F.lit(1000.0 if in_km else 1.0)
    for name in ("x", "y"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    if borrowed is not None:
        axes = borrowed.select("iy", "ix", F.col("x").alias("_x"), F.col("y").alias("_y"))
        df = attach(df, axes, ["iy", "ix"], "left")
    else:
        df = df.withColumn("_x", F.lit(None).cast("double")).withColumn("_y", F.lit(None).cast("double"))
    return df.withColumns({
        "x": F.coalesce(F.col("x") * scale, F.col("_x") * scale, F.col("ix") * 1000.0),
        "y": F.coalesce(F.col("y") * scale, F.col("_y") * scale, F.col("iy") * 1000.0),
    }).drop("_x", "_y")


def padded_size(n, divisor: int = 32) -> int:
    return -(-n // divisor) * divisor


def pad_offset(n: int, divisor: int = 32) -> int:
    return (padded_size(n, divisor) - n) // 2


def lattice(df: DataFrame, ny: int, nx: int) -> DataFrame:
    """Give every row of ``df`` (times, channels, ...) the full ny x nx set of cells."""
    return df.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn(
        "ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))
    )


def pad(field: DataFrame, ny: int, nx: int, fill: float, keys=("time",), value: str = "value", divisor: int = 32) -> DataFrame:
    """Raise both extents to a multiple of ``divisor``, the data centred and the rim filled. A cell outside ny x nx is
    an error."""
    top, left = pad_offset(ny, divisor), pad_offset(nx, divisor)

    def moved(axis: str, size: int, offset: int):
        stray = F.raise_error(F.concat(F.lit(f"{axis} outside 0..{size - 1}: "), F.coalesce(F.col(axis).cast("string"), F.lit("null")))).cast("int")
        return F.when(F.col(axis).between(0, size - 1), (F.col(axis) + offset).cast("int")).otherwise(stray).alias(axis)

    shifted = field.select(
        *keys, moved("iy", ny, top), moved("ix", nx, left),
        F.col(value), F.lit(True).alias("_own"),
    )
    frame = lattice(field.select(*keys).distinct(), padded_size(ny, divisor), padded_size(nx, divisor))
    return frame.join(shifted, [*keys, "iy", "ix"], "left").select(
        *keys, "iy", "ix", F.when(F.col("_own"), F.col(value)).otherwise(F.lit(fill)).alias(value)
    )


def unpad(field: DataFrame, ny: int, nx: int, divisor: int = 32) -> DataFrame:
    top, left = pad_offset(ny, divisor), pad_offset(nx, divisor)
    inner = field.where(F.col("iy").between(top, top + ny - 1) & F.col("ix").between(left, left + nx - 1))
    return inner.withColumns({"iy": (F.col("iy") - top).cast("int"), "ix": (F.col("ix") - left).cast("int")})
