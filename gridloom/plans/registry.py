"""Registry of the queries over the given tables, each with its result columns and, where possible, its SQL.

A result column is written ``name:kind``. Kinds: i int, l bigint, s string, f double rounded to six places,
g double rounded to three (where single precision is involved), d day, t second (both as text). The same list shapes the Spark result and wraps the SQL, so that the two
can be compared value by value. Before rounding a double is moved by 3e-9: averages of decimal data
often fall on a half of the last place, where the last bit of a sum would decide.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.standins import CTES

_SPARK = {
    "i": lambda c: c.cast("int"),
    "l": lambda c: c.cast("bigint"),
    "s": lambda c: c.cast("string"),
    "d": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
}


def _rounded(c, places: int = 6):
    r = F.round(c.cast("double") + 3e-9, places)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


_SPARK["f"] = _rounded
_SPARK["g"] = lambda c: _rounded(c, 3)
_SQL = {
    "i": "CAST({0} AS INTEGER)", "l": "CAST({0} AS BIGINT)", "s": "CAST({0} AS VARCHAR)",
    "d": "strftime({0}, '%Y-%m-%d')", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
    "g": "CASE WHEN round(CAST({0} AS DOUBLE) + 3e-9, 3) = 0 THEN 0.0::DOUBLE ELSE round(CAST({0} AS DOUBLE) + 3e-9, 3) END",
    "f": "CASE WHEN round(CAST({0} AS DOUBLE) + 3e-9, 6) = 0 THEN 0.0::DOUBLE ELSE round(CAST({0} AS DOUBLE) + 3e-9, 6) END",
}


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    columns: list[tuple[str, str]]
    covers: tuple[str, ...]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(columns: str, covers: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``covers`` lists the survey rows it exercises."""
    spec = [tuple(c.split(":")) for c in columns.split()]

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[_SPARK[kind](F.col(f"`{c}`")).alias(c) for c, kind in spec])

        REGISTRY[key] = Query(key, run, spec, tuple(covers.split()), _oracle(sql, spec) if sql else None)
        return fn

    return register


def _oracle(sql: str, spec) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for cte in CTES:
            if cte not in needed and re.search(rf"\b{cte}\b", text):
                visit(CTES[cte])
                needed.append(cte)

    visit(sql)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = ", ".join(f'{_SQL[kind].format(chr(34) + c + chr(34))} AS "{c}"' for c, kind in spec)
    return (f"WITH {head} " if head else "") + f"SELECT {body} FROM ({sql}) AS result_rows"
