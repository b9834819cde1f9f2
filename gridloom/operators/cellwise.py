"""A user's own model per group: fitted on each group's rows, applied to them with what was fitted.

What the library offers as column code needs none of this. It is for fits that exist as a Python function of one cell's
rows: Spark deals and sorts the groups, each is handed over as a pandas frame, and a group must therefore fit one task. That is
checked before anything is handed over, from counts that are combined map-side: an oversized group is an error that names
it, rather than a worker that dies. Rows travel to Python in batches of many groups and are cut there, for a batch of its own
costs a small group more than its fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest group that is handed to one task, in rows and in bytes (as ``_width`` reckons them).
MAX_ROWS = 2_000_000
MAX_BYTES = 256_000_000


class OversizedGroup(ValueError):
    """A group that one task should not gather."""


def _width(schema: T.StructType):
    """Bytes of a row in a frame, as a column: 8 per number, texts and arrays by their length."""
    size = F.lit(0)
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 50
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            size = size + F.coalesce(F.size(c), F.lit(0)) * 8 + 100
        else:
            size = size + 8
    return size


def check_groups(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> None:
    """Raise ``OversizedGroup`` if a group exceeds either limit, naming the largest ones."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(_width(df.schema)).alias("_bytes"))
    found = sizes.where((F.col("_rows") > max_rows) | (F.col("_bytes") > max_bytes)).orderBy(F.desc("_rows")).limit(3).collect()
    if found:
        told = "; ".join(", ".join(f"{k}={r[k]!r}" for k in keys) + f": {r['_rows']} rows, {r['_bytes']} bytes" for r in found)
        raise OversizedGroup(f"groups beyond {max_rows} rows or {max_bytes} bytes: {told}")


def _result(keys: Sequence[str], df: DataFrame, schema: str) -> T.StructType:
    own = T.StructType.fromDDL(schema)
    if clash := {f.name for f in own.fields} & set(keys):
        raise ValueError(f"the result may not have a key's name: {sorted(clash)}")
    return T.StructType([df.schema[k] for k in keys] + own.fields)


def _groups(frames: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, and where each group starts. Rows come sorted by the first ``keys`` columns; the last group of a
    frame waits for the next one, where it may go on."""
    def changes(values: pd.Series) -> np.ndarray:
        x, missing = values.to_numpy(), values.isna().to_numpy()
        return np.asarray(x[1:] != x[:-1], bool) & ~(missing[1:] & missing[:-1])

    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        heads = 1 + np.flatnonzero(np.logical_or.reduce([changes(frame.iloc[:, k]) for k in range(keys)]))
        goes_on = held and not any(changes(pd.concat([held[-1].iloc[-1:, k], frame.iloc[:1, k]]))[0] for k in range(keys))
        if goes_on and not len(heads):
            held.append(frame)
            continue
        first = heads[0] if goes_on else 0
        if held:
            yield pd.concat([*held, frame.iloc[:first]], ignore_index=True) if first else pd.concat(held, ignore_index=True), np.zeros(1, np.int64)
        heads = heads if goes_on else np.concatenate([[0], heads])
        if len(heads) > 1:
            yield frame.iloc[first : heads[-1]].reset_index(drop=True), heads[:-1] - first
        held = [frame.iloc[heads[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True), np.zeros(1, np.int64)


class _Cells:
    """Columns of a frame of whole groups. Whole numbers and truth values come filled, with a flag of their nulls, so that the nulls
    of one group do not change the type that another group sees."""

    def __init__(self, frame: pd.DataFrame, flags: dict[str, str]):
        self.frame, self.flags = frame, {c: frame[f].to_numpy(bool) for c, f in flags.items()}
        self.chosen: dict[tuple, pd.DataFrame] = {}  # columns are chosen once for all groups

    def take(self, which: dict[str, str], low: int, high: int) -> pd.DataFrame:
        """Rows of the columns named by ``which`` (column: name), with the types that a frame of these rows alone would have."""
        if (key := tuple(which)) not in self.chosen:
            self.chosen[key] = self.frame[list(which)].set_axis(list(which.values()), axis=1)
        out = self.chosen[key].iloc[low:high].reset_index(drop=True)
        for c, name in which.items():
            if c in self.flags and self.flags[c][low:high].any():
                out[name] = out[name].astype(object if out[name].dtype == bool else float).mask(self.flags[c][low:high], None)
        return out

    def at(self, column: str, rows: np.ndarray) -> pd.Series:
        out = self.frame[column].iloc[rows].reset_index(drop=True)
        if column in self.flags and self.flags[column][rows].any():
            out = out.astype(object).mask(self.flags[column][rows], None)
        return out


def _table(found: list[dict]) -> pd.DataFrame:
    """Mappings as a frame; whole numbers stay whole beside missing ones."""
    out = pd.DataFrame(found)
    for c in out:
        if out[c].dtype == float and any(isinstance(f.get(c), (int, np.integer)) for f in found):
            out[c] = pd.Series([f.get(c) for f in found], dtype=object)
    return out


def _per_group(df: DataFrame, keys: int, order: list, result: T.StructType, call: Callable[[_Cells, int, int], dict | pd.DataFrame | None]) -> DataFrame:
    """``call(cells, low, high)`` of every group of the first ``keys`` columns, sorted by ``order``: what it returns with the group's
    keys, which are the first fields of ``result``. Columns are handed over as ``c0``, ``c1``..."""
    fields = df.schema.fields
    names = [f"c{k}" for k in range(len(fields))]
    dealt = df.toDF(*names)
    dealt = dealt.repartition(*names[:keys]).sortWithinPartitions(*names[:keys], *order)
    filled, flags, more = [], {}, []
    for k, (f, c) in enumerate(zip(fields, names)):
        whole = isinstance(f.dataType, (T.IntegralType, T.BooleanType)) and f.nullable
        zero = F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(0).cast(f.dataType)
        filled.append(F.coalesce(F.col(c), zero).alias(c) if whole else F.col(c))
        if whole or k < keys and f.nullable:  # the flag also tells a null key from NaN
            more.append(F.col(c).isNull().alias(f"f{k}"))
            flags[c] = f"f{k}"
    key_flags = [flags[c] for c in names[:keys] if c in flags]
    front = names[:keys] + key_flags
    last = [f for f in flags.values() if f not in key_flags]
    own = [f.name for f in result.fields[keys:]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, heads in _groups(frames, len(front)):
            cells, plain, tables = _Cells(frame, flags), [], []
            for low, high in zip(heads, [*heads[1:], len(frame)]):
                found = call(cells, low, high)
                if isinstance(found, pd.DataFrame):
                    if len(found):
                        tables.append((found[own], np.full(len(found), low)))
                elif found is not None:
                    plain.append((low, found))
            if plain:
                tables.append((_table([f for _, f in plain])[own], np.array([low for low, _ in plain])))
            while tables:  # frames of the same types go out together
                kinds = list(tables[0][0].dtypes)
                some = next((k for k, (t, _) in enumerate(tables) if list(t.dtypes) != kinds), len(tables))
                out, rows = pd.concat([t for t, _ in tables[:some]], ignore_index=True), np.concatenate([r for _, r in tables[:some]])
                for k in range(keys):
                    out.insert(k, result.fields[k].name, cells.at(names[k], rows))
                yield out
                tables = tables[some:]

    return dealt.select(*filled, *more).select(*front, *names[keys:], *last).mapInPandas(run, result)


def fit_per_group(
    df: DataFrame, keys: Sequence[str], fit: Callable[[pd.DataFrame], dict | pd.DataFrame | None], schema: str, columns: Sequence[str],
    order: Sequence[str] = (), max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """(keys, fields of ``schema``): ``fit`` of the ``columns`` of every group, sorted by ``order``.

    ``fit`` returns a mapping (one row), a frame (any number) or None (none, for a group that it declines). Null keys
    form groups of their own. Only ``keys``, ``columns`` and ``order`` are shuffled. Raises ``OversizedGroup`` first.
    """
    keys, wanted = list(keys), list(dict.fromkeys([*columns, *order]))
    slim = df.select(*keys, *[c for c in wanted if c not in keys])
    check_groups(slim, keys, max_rows, max_bytes)
    result = _result(keys, df, schema)
    which = {f"c{slim.columns.index(c)}": c for c in columns}

    def call(cells: _Cells, low: int, high: int):
        return fit(cells.take(which, low, high))

    return _per_group(slim, len(keys), [F.col(f"c{slim.columns.index(c)}").asc_nulls_last() for c in order], result, call)


def predict_per_group(
    fitted: DataFrame, df: DataFrame, keys: Sequence[str], predict: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    columns: Sequence[str], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """(keys, fields of ``schema``): ``predict(parameters, rows)`` for every group that has rows, with what was
    fitted for it (an empty frame where nothing was). Raises ``OversizedGroup`` if the rows or the parameters of a group
    exceed a limit. Groups of ``fitted`` without rows give nothing."""
    keys = list(keys)
    slim = df.select(*keys, *[c for c in columns if c not in keys])
    check_groups(slim, keys, max_rows, max_bytes)
    check_groups(fitted, keys, max_rows, max_bytes)
    result = _result(keys, df, schema)
    # Parameters and rows of a group lie one behind the other, each with the other's columns null.
    wanted = list(dict.fromkeys(columns))
    col = lambda c: F.col(f"`{c}`")
    blank = lambda frame, names: [F.lit(None).cast(frame.schema[c].dataType) for c in names]
    both = fitted.select(*map(col, keys), F.lit(False), *map(col, fitted.columns), *blank(slim, wanted)).unionAll(
        slim.select(*map(col, keys), F.lit(True), *blank(fitted, fitted.columns), *map(col, wanted)))
    side, start = f"c{len(keys)}", len(keys) + 1
    of_fit = {f"c{start + k}": c for k, c in enumerate(fitted.columns)}
    of_rows = {f"c{start + len(fitted.columns) + k}": c for k, c in enumerate(wanted)}

    def call(cells: _Cells, low: int, high: int):
        first = low + int(np.searchsorted(cells.frame[side].to_numpy(bool)[low:high], True))
        return predict(cells.take(of_fit, low, first), cells.take(of_rows, first, high)) if first < high else None

    return _per_group(both, len(keys), [F.col(side)], result, call)


def line_fit(x: str, y: str, minimum: int = 2) -> Callable[[pd.DataFrame], dict | None]:
    """A least-squares line per group over the rows that have both values: slope, intercept, r2 and n. Fewer than
    ``minimum`` such rows, or a constant ``x``, give no fit."""
    def fit(rows: pd.DataFrame) -> dict | None:
        both = np.column_stack([rows[x].to_numpy(float), rows[y].to_numpy(float)])
        both = both[~np.isnan(both).any(1)]
        if len(both) < minimum or len(both) < 2:
            return None
        (mx, my), d = both.mean(0), both - both.mean(0)
        sxx, sxy, syy = (d[:, 0] ** 2).sum(), (d[:, 0] * d[:, 1]).sum(), (d[:, 1] ** 2).sum()
        if sxx <= 1e-18 * max(1.0, mx * mx) * len(both):
            return None
        slope = sxy / sxx
        return {"slope": slope, "intercept": my - slope * mx, "r2": sxy * sxy / (sxx * syy) if syy > 0 else 1.0, "n": len(both)}

    return fit


LINE = "slope double, intercept double, r2 double, n long"


def line_predict(x: str, keep: Sequence[str], name: str = "predicted") -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """``keep`` and the value of the group's line at ``x``; missing without a line."""
    def predict(parameters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        slope, intercept = (parameters["slope"].iloc[0], parameters["intercept"].iloc[0]) if len(parameters) else (float("nan"), float("nan"))
        return pd.DataFrame({**{c: rows[c] for c in keep}, name: slope * rows[x].to_numpy(float) + intercept})

    return predict
