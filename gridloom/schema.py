"""Column names and table shapes shared by every module."""

from __future__ import annotations

CELL = ("iy", "ix")

FIELD = ("source", "variable", "scenario", "member", "time", "iy", "ix", "value")

SAMPLE_DDL = "time timestamp, role string, channel string, iy int, ix int, value float"

FIELD_DDL = (
    "source string, variable string, scenario string, member string, "
    "time timestamp, iy int, ix int, value double"
)
