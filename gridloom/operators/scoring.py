"""Batch scoring of fields with a user-supplied model.

A model is any picklable callable ``model(x, seed) -> y`` on NumPy arrays: x is (batch, channel, H, W) on
the padded grid, y is (batch, 1, H, W) or (batch, H, W). It travels to the executors once, with the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.geometry import pad_offset, padded_size
from gridloom.operators.normalise import fill_missing, inverse_minmax, log_precipitation, minmax
from gridloom.operators.samples import pack


def prepare_inputs(samples: DataFrame, stats: DataFrame, target_channel: str, mask: DataFrame, fill: float) -> DataFrame:
    """The input side of the shared transform chain: log10, min-max, mask by the target footprint, fill."""
    x = samples.where("role = 'x'").transform(log_precipitation).transform(minmax, stats, target_channel, False)
    seen = mask.select("iy", "ix", F.lit(True).alias("_seen"))
    masked = x.join(seen, ["iy", "ix"], "left").withColumn("value", F.when(F.col("_seen"), F.col("value")).otherwise(F.lit(fill)))
    return fill_missing(masked.drop("_seen"), fill)


def score(packed: DataFrame, model: Callable, n_channels: int, ny: int, nx: int, fill: float = 0.0, batch: int = 32) -> DataFrame:
    """Predict packed samples (time, draw, seed, idx, val); gives (time, draw, iy, ix, value) on the unpadded grid.

    ``batch`` bounds the dense block a task holds at a time, whatever the Arrow batch size.
    """
    top, left, big_y, big_x = pad_offset(ny), pad_offset(nx), padded_size(ny), padded_size(nx)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), batch):
                part = frame.iloc[first:first + batch]
                inner = np.full((len(part), n_channels * ny * nx), fill, dtype=np.float32)
                for row, (idx, val) in enumerate(zip(part["idx"], part["val"])):
                    inner[row, np.asarray(idx, dtype=np.int64)] = val
                x = np.full((len(part), n_channels, big_y, big_x), fill, dtype=np.float32)
                x[:, :, top:top + ny, left:left + nx] = inner.reshape(len(part), n_channels, ny, nx)
                y = np.asarray(model(x, part["seed"].to_numpy())).reshape(len(part), big_y, big_x)
                y = y[:, top:top + ny, left:left + nx].reshape(len(part), ny * nx).astype(np.float64)
                yield pd.DataFrame({"time": part["time"].to_numpy(), "draw": part["draw"].to_numpy(), "y": list(y)})

    dense = packed.select("time", "draw", "seed", "idx", "val").mapInPandas(predict, "time timestamp, draw int, y array<double>")
    flat = dense.select("time", "draw", F.posexplode("y").alias("_at", "value"))
    return flat.select("time", "draw", F.floor(F.col("_at") / nx).cast("int").alias("iy"), (F.col("_at") % nx).cast("int").alias("ix"), "value")


def score_fields(samples: DataFrame, model: Callable, channels: list[str], stats: DataFrame, target_channel: str, mask: DataFrame, ny: int, nx: int,
                 fill: float = 0.0, output_norm: bool = True, output_range: str = "zero_one", draws: int = 1, seed: int = 0, batch: int = 32,
                 seed_of: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Normalise, mask, fill, pad, predict, unpad, clip, de-normalise and re-mask; (time, iy, ix, value).

    ``mask`` lists the (iy, ix) cells of the target footprint. With several ``draws`` a stochastic model
    is run once per draw, seeded by time and draw (a hash, or ``seed_of(time, draw)``), and the mean is returned.
    """
    inputs = prepare_inputs(samples, stats, target_channel, mask, fill)
    packed = pack(inputs, channels, ny, nx)
    per_draw = packed.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    own_seed = seed_of(F.col("time"), F.col("draw")).cast("bigint") if seed_of else F.xxhash64(F.lit(seed), F.col("time"), F.col("draw"))
    seeded = per_draw.withColumn("seed", own_seed)
    out = score(seeded, model, len(channels), ny, nx, fill, batch)
    if draws > 1:
        out = out.groupBy("time", "iy", "ix").agg(F.avg("value").alias("value"))
    if output_norm:
        out = inverse_minmax(out, stats, target_channel, output_range)
    return out.join(mask.select("iy", "ix"), ["iy", "ix"]).select("time", "iy", "ix", "value")


def score_date(samples: DataFrame, date: str, **kwargs) -> DataFrame:
    """Scores of one day beside its inputs: (time, iy, ix, last input, target, prediction, error)."""
    day = samples.where(F.to_date("time") == F.lit(date).cast("date"))
    last = kwargs["channels"][-1]
    pred = score_fields(day, **kwargs).withColumnRenamed("value", "prediction")
    wide = day.groupBy("time", "iy", "ix").agg(
        F.avg(F.when((F.col("role") == "x") & (F.col("channel") == last), F.col("value"))).alias("input"),
        F.avg(F.when(F.col("role") == "y", F.col("value"))).alias("target"),
    )
    return pred.join(wide, ["time", "iy", "ix"], "left").select(
        "time", "iy", "ix", "input", "target", "prediction", (F.col("prediction") - F.col("target")).alias("error")
    )
