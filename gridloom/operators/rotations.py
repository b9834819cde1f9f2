"""The two-variable correction of groups that are known to be small, each handed over whole.

Fitting and applying a chain of rotations as columns takes a dozen shuffles, and a search of the nodes per value and rotation
that is interpreted. Where a count has shown all groups to be small, the rows of a group are packed into one row, which
takes a single shuffle, and the same steps run on its arrays. Batches between Spark and its workers are bounded in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import arrow_batches, materialise

TABLE = ("xs_u", "zs_u", "xs_v", "zs_v")


def fits(df: DataFrame, values) -> bool:
    """Whether values and times have types that arrays keep as they are."""
    return all(df.schema[c].dataType == T.DoubleType() for c in values) and isinstance(
        df.schema["time"].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) and df.schema["period"].dataType == T.StringType()


def median(values: np.ndarray) -> float:
    values = np.sort(values)
    exact = 0.5 * (len(values) - 1)
    low = int(exact)
    return values[low] + (exact - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def nodes(values: np.ndarray, steps: int) -> np.ndarray:
    """Quantiles at 0, 1/steps, ..., 1, places by whole numbers."""
    values = np.sort(values)
    scaled = np.arange(steps + 1, dtype=np.int64) * (len(values) - 1)
    low = scaled // steps
    v = values[low]
    return v + (scaled - low * steps) / float(steps) * (values[np.minimum(low + 1, len(values) - 1)] - v)


def mapped(x: np.ndarray, xs: np.ndarray, zs: np.ndarray) -> np.ndarray:
    """As ``columns.interpolate``, for nodes without nulls."""
    k = np.clip(np.searchsorted(xs, x, "right"), 1, max(1, len(xs) - 1))
    upper = np.minimum(k, len(xs) - 1)
    wide = xs[upper] - xs[k - 1]
    share = np.divide(x - xs[k - 1], wide, out=np.zeros_like(x), where=wide != 0)
    inside = zs[k - 1] + share * (zs[upper] - zs[k - 1])
    return np.where(x < xs[0], zs[0] + (x - xs[0]), np.where(x >= xs[-1], zs[-1] + (x - xs[-1]), inside))


def turned(u: np.ndarray, v: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    c, s = math.cos(angle), math.sin(angle)
    return u * c + v * s, v * c - u * s


def chain_of(obs, train, test, angles, steps: int) -> list[tuple[int, float, int, tuple]]:
    """(step, angle, 0 for training or 1 for the test period, tables) of one group; each argument is its (u, v)."""
    out = []

    def tables(o, sims):
        base = [(nodes(a, steps), nodes(b, steps)) for a, b in zip(o, sims[0])]
        made = []
        for sim in sims:
            own = [nodes(x, steps) for x in sim] if len(sim[0]) else None
            made.append(own and tuple(t for x, (of_obs, of_train) in zip(own, base) for t in (x, x + (of_obs - of_train))))
        return made

    def note(step, angle, made):
        out.extend((step, angle, k, t) for k, t in enumerate(made) if t)

    sims = [train, test]
    note(-1, 0.0, tables(obs, sims))
    for i, angle in enumerate(angles):
        o, s = turned(*obs, angle), [turned(*x, angle) for x in sims]
        made = tables(o, s)
        note(i, angle, made)
        s = [(mapped(x[0], *t[:2]), mapped(x[1], *t[2:])) if t else x for x, t in zip(s, made)]
        obs, sims = turned(*o, -angle), [turned(*x, -angle) for x in s]
    return out


def corrected_of(u, v, at, tables: dict, plan) -> tuple[np.ndarray, np.ndarray]:
    """The one-variable values in the order of the rotated ones, ties by time."""
    single = mapped(u, *tables[-1][:2]), mapped(v, *tables[-1][2:])
    for step, angle in plan:
        if step >= 0:
            a, b = turned(u, v, angle)
            u, v = turned(mapped(a, *tables[step][:2]), mapped(b, *tables[step][2:]), -angle)
    nine = lambda x: np.copysign(np.floor(np.abs(x) * 1e9 + 0.5), x)
    out = []
    for s, r in zip(single, (u, v)):
        new = np.empty_like(s)
        new[np.lexsort((at, nine(r)))] = s[np.lexsort((at, nine(s)))]
        out.append(new)
    return out[0], out[1]


def _column(flat: pa.StructArray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (nulls as anything) and which are there."""
    x = flat.field(flat.type.get_field_index(name))
    return x.fill_null(False if pa.types.is_boolean(x.type) else 0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)


def _packed(lists: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    """The entries of all lists and the borders between them; a null list has none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def fit(past: DataFrame, keys: list[str], train: str, test: str, angles, steps: int, minimum: int) -> DataFrame:
    """The written chain of ``biascorr.fit_mbcn``, of the rows of both fitted periods."""
    values = ["obs_u", "obs_v", "sim_u", "sim_v"]
    names = ["step", "angle", *keys, "period", *TABLE]
    rows = past.dropna(subset=keys).groupBy(*keys).agg(F.collect_list(F.struct((F.col("period") == train).alias("train"), *values)).alias("_rows"))
    periods, angles, n = [train, test], [float(a) for a in angles], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, borders = _packed(batch.column(n))
            is_train = _column(flat, "train")[0]
            held = {c: _column(flat, c) for c in values}
            four = np.logical_and.reduce([there for _, there in held.values()])
            both = held["sim_u"][1] & held["sim_v"][1]
            found, owner = [], []
            for k, (low, high) in enumerate(zip(borders[:-1], borders[1:])):
                of = slice(low, high)
                t, h = is_train[of] & four[of], ~is_train[of]
                if t.sum() < minimum or (h & both[of]).sum() < minimum or not t.any():
                    continue
                tested = []
                for c in ("sim_u", "sim_v"):
                    x, there = held[c][0][of][h], held[c][1][of][h]
                    tested.append(np.where(there, x, median(x[there])) if there.any() else None)
                if any(x is None for x in tested):
                    tested = [np.zeros(0), np.zeros(0)]
                pick = lambda a: tuple(held[f"{a}_{x}"][0][of][t] for x in "uv")  # noqa: B023, E731
                made = chain_of(pick("obs"), pick("sim"), tuple(tested), angles, steps)
                found += made
                owner += [k] * len(made)
            at = np.arange(len(found) + 1, dtype=np.int32) * (steps + 1)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0), *[f[3][i] for f in found]]))) for i in range(len(TABLE))]
            yield pa.record_batch([
                pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()),
                *[batch.column(i).take(pa.array(owner, pa.int64())) for i in range(n)], pa.array([periods[f[2]] for f in found], pa.string()), *lists,
            ], names=names)

    kinds = ", ".join(f"`{c}` {past.schema[c].dataType.simpleString()}" for c in keys)
    shape = f"step int, angle double, {kinds}, period string, " + ", ".join(f"{c} array<double>" for c in TABLE)
    with arrow_batches(past.sparkSession):
        return materialise(rows.mapInArrow(run, shape), "mbcn-chain")


def predict(chain: DataFrame, rows: DataFrame, keys: list[str], follows: dict[str, str], plan) -> DataFrame:
    """``rows`` with corrected_u and corrected_v, written; every row once."""
    rest = [c for c in rows.columns if c not in (*keys, "period", "time")]
    names, n = [*keys, "period", "time", *rest], len(keys)
    col = lambda c: F.col(f"`{c}`")
    at = F.unix_micros(F.col("time").cast("timestamp")).alias("_at")
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*[col(c) for c in names[n:]], at)).alias("_rows"))
    tables = chain.groupBy(*keys).agg(F.collect_list(F.struct("step", "period", *TABLE)).alias("_chain"))
    known = packed.join(tables, keys, "left").select(*keys, "_rows", "_chain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, borders = _packed(batch.column(n))
            links, ends = _packed(batch.column(n + 1))
            step = _column(links, "step")[0]
            fitted = links.field(links.type.get_field_index("period")).to_pylist()
            spans = {}
            for c in TABLE:
                lists = links.field(links.type.get_field_index(c))
                spans[c] = (lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]))
            code = flat.field(flat.type.get_field_index("period")).dictionary_encode()
            period, texts = code.indices.fill_null(-1).to_numpy(zero_copy_only=False), code.dictionary.to_pylist()
            (u, has_u), (v, has_v), (time, has_time) = (_column(flat, c) for c in ("sim_u", "sim_v", "_at"))
            new, good = np.zeros((2, len(flat))), np.zeros(len(flat), bool)
            for k, (low, high) in enumerate(zip(borders[:-1], borders[1:])):
                of_period: dict[str, dict] = {}
                for j in range(ends[k], ends[k + 1]):
                    of_period.setdefault(fitted[j], {})[int(step[j])] = tuple(x[b[j] : b[j + 1]] for x, b in spans.values())
                if not of_period:
                    continue
                for p in np.unique(period[low:high]):
                    mine = of_period.get(follows.get(texts[p], texts[p])) if p >= 0 else None
                    if mine is None or any(s not in mine for s, _ in plan):
                        continue
                    rows_of = low + np.flatnonzero(period[low:high] == p)
                    if not (has_u[rows_of].any() and has_v[rows_of].any()):
                        continue
                    fill = lambda x, there: np.where(there[rows_of], x[rows_of], median(x[rows_of][there[rows_of]]))  # noqa: B023, E731
                    a, b, timed = fill(u, has_u), fill(v, has_v), has_time[rows_of]
                    rows_of = rows_of[timed]
                    new[:, rows_of] = corrected_of(a[timed], b[timed], time[rows_of], mine, plan)
                    good[rows_of] = has_u[rows_of] & has_v[rows_of]
            owner = pa.array(np.repeat(np.arange(len(borders) - 1), np.diff(borders)))
            yield pa.record_batch(
                [*[batch.column(i).take(owner) for i in range(n)], *[flat.field(flat.type.get_field_index(c)) for c in names[n:]], *[pa.array(x, mask=~good) for x in new]],
                names=[*names, "corrected_u", "corrected_v"])

    shape = T.StructType([*[rows.schema[c] for c in names], T.StructField("corrected_u", T.DoubleType()), T.StructField("corrected_v", T.DoubleType())])
    with arrow_batches(rows.sparkSession):
        return materialise(known.mapInArrow(run, shape), "mbcn-corrected")
