"""Readers from catalog to cleaned daily rows, one per kind of source.

All take the same steps where they have them, in this order: scan (routed by scenario for simulations), standardise the
geometry, correct for height, average to days, mask, crop, clean units. They differ in the geometry of their grids and in
which steps apply: regional models keep their projected grid whole, observations are masked and never corrected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import finite, wrap_longitude
from gridloom.operators import geometry, masks, regrid, timeops
from gridloom.session import attach
from gridloom.sources import catalog as cat

KEYS = ["source", "variable", "iy", "ix"]


@dataclass(frozen=True)
class Source:
    """A named source: its ``kind`` picks the reader, its ``family`` the geometry; ``data_type`` rules unit cleaning and
    ``mask_kind`` how a mask is read."""

    name: str
    kind: str
    family: str
    data_type: str
    mask_kind: str | None = None


def degrees(grid: DataFrame) -> DataFrame:
    """(iy, ix, lon, lat) of a grid in degrees, in any spelling, longitudes in [-180, 180)."""
    return geometry.standard_coordinates(grid).select("iy", "ix", wrap_longitude("lon").alias("lon"), F.col("lat").cast("double").alias("lat"))


def kilometres(grid: DataFrame) -> DataFrame:
    """(iy, ix, x, y) of a projected grid in kilometres, in metres; a grid without axes has none to give."""
    axes = geometry.standard_coordinates(grid)
    missing = {"x", "y"} - set(axes.columns)
    if missing:
        raise ValueError(f"a projected grid needs {sorted(missing)}")
    return axes.select("iy", "ix", (F.col("x") * 1000.0).alias("x"), (F.col("y") * 1000.0).alias("y"))


# Geometry by family: how a native grid table becomes coordinates.
FAMILIES: dict[str, Callable[[DataFrame], DataFrame]] = {"latlon": degrees, "gcm": degrees, "eobs": degrees, "rcm": kilometres}


def family_of(grid: DataFrame, name: str = "") -> str:
    """The family that a grid's columns tell: projected axes without degrees are ``rcm``, the rest ``latlon``."""
    known = set(geometry.standard_coordinates(grid).columns)
    given = set(grid.columns)
    if {"x", "y"} <= known and not given & set(geometry.COORDINATE_ALIASES["lon"]):
        return "rcm"
    if {"lon", "lat"} <= known:
        return "latlon"
    raise ValueError(f"the grid of {name or 'this source'} has neither degrees nor projected axes")


def _daily(rows: DataFrame) -> DataFrame:
    return timeops.daily_mean(rows.withColumn("value", finite("value")), KEYS)


def _cleaned(rows: DataFrame, source: Source) -> DataFrame:
    return masks.clean_units(rows.withColumn("data_type", F.lit(source.data_type))).drop("data_type")


def _corrected(rows: DataFrame, heights) -> DataFrame:
    """``heights``: None, or (source heights, target heights, weights of the source's, weights of the target's)."""
    return rows if heights is None else regrid.lapse_rate_correction(rows, *heights[:2], source_weights=heights[2], target_weights=heights[3])


def read_reanalysis(catalog, source: Source, grid, variable, start, end, domain, heights=None, **_) -> DataFrame:
    rows = _corrected(cat.require_source(catalog, source.name, variable, start, end), heights)
    return _cleaned(attach(_daily(rows), geometry.crop(FAMILIES[source.family](grid), domain), ["iy", "ix"]), source)


def read_model(catalog, source: Source, grid, variable, start, end, domain, heights=None, ssp="ssp585", split=cat.SCENARIO_START, **_) -> DataFrame:
    if source.family == "rcm":
        return read_regional(catalog, source, grid, variable, start, end, domain, ssp=ssp, split=split)
    rows = _corrected(_routed(catalog, source, variable, ssp, start, end, split), heights)
    return _cleaned(attach(_daily(rows), geometry.crop(FAMILIES[source.family](grid), domain), ["iy", "ix"]), source)


def read_regional(catalog, source: Source, grid, variable, start, end, domain=None, ssp="ssp585", split=cat.SCENARIO_START, **_) -> DataFrame:
    rows = _daily(_routed(catalog, source, variable, ssp, start, end, split))
    return _cleaned(attach(rows, FAMILIES["rcm"](grid), ["iy", "ix"]), source)


def read_observation(catalog, source: Source, grid, variable, start, end, domain, mask=None, **_) -> DataFrame:
    rows = _daily(cat.require_source(catalog, source.name, variable, start, end))
    if source.mask_kind:
        if mask is None:
            raise ValueError(f"source '{source.name}' is masked by kind '{source.mask_kind}', but no mask is given")
        rows = masks.land_sea_mask(rows, mask, source.mask_kind).drop("mask")
    own = FAMILIES[source.family](grid)
    return _cleaned(attach(rows, own if domain is None else geometry.crop(own, domain), ["iy", "ix"]), source)


def _routed(catalog, source: Source, variable, ssp, start, end, split) -> DataFrame:
    rows = cat.scan_routed(catalog, source.name, variable, ssp, start, end, split)
    if rows.isEmpty():
        raise FileNotFoundError(f"no data for source='{source.name}', variable='{variable}', ssp='{ssp}', from {start} to {end}")
    return rows


READERS: dict[str, Callable[..., DataFrame]] = {
    "reanalysis": read_reanalysis, "model": read_model, "regional": read_regional, "observation": read_observation,
}


def read(catalog: DataFrame, source: Source, grid: DataFrame, variable: str, start: str, end: str, domain=None, **options) -> DataFrame:
    """(source, variable, time, iy, ix, coordinates, value) of a source, by the reader of its kind.

    ``options``: ``heights`` (reanalysis and models), ``ssp`` and ``split`` (models and regional models), ``mask``
    (observations). Coordinates are lon and lat in degrees, or x and y in metres for a projected grid. An unknown kind,
    unknown source or empty selection is an error.
    """
    if source.kind not in READERS:
        raise KeyError(f"unknown kind of source '{source.kind}'; known: {', '.join(READERS)}")
    return READERS[source.kind](catalog, source, grid, variable, start, end, domain, **options)
