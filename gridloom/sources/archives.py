"""Sample archives (NumPy ``.npz``) as tables, and back."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.labels import date_from_sample_name, time_token
from gridloom.operators.samples import inside_block

_BLOCK_DDL = "path string, role string, channel_pos int, ny int, nx int, data array<float>"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All ``sample_*.npz`` files of a folder as long rows; files are split over tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "sample_*.npz").load(folder)
    return decode_archives(files.select("path", "content"))


def decode_archives(files: DataFrame) -> DataFrame:
    """(path, content) to (time, role, channel_pos, iy, ix, value); y may be absent, NaN becomes NULL.

    Python unpacks one channel block per row; exploding it to cells happens in the JVM.
    """
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = []
                with np.load(io.BytesIO(content)) as archive:
                    for role in ("x", "y"):
                        if role in archive.files:
                            block = np.asarray(archive[role], dtype=np.float32)
                            for pos in range(block.shape[0]):
                                rows.append((path, role, pos, block.shape[1], block.shape[2], block[pos].ravel()))
                yield pd.DataFrame(rows, columns=["path", "role", "channel_pos", "ny", "nx", "data"])

    blocks = files.select("path", "content").mapInPandas(unpack, _BLOCK_DDL)
    cells = blocks.select("path", "role", "channel_pos", "nx", F.posexplode("data").alias("_at", "_v"))
    return cells.select(
        date_from_sample_name("path").alias("time"), "role", "channel_pos",
        F.floor(F.col("_at") / F.col("nx")).cast("int").alias("iy"), (F.col("_at") % F.col("nx")).cast("int").alias("ix"),
        F.when(~F.isnan("_v"), F.col("_v")).alias("value"),
    )


def encode_archives(samples: DataFrame, channels: list[str], ny: int, nx: int, frequency: str = "daily") -> DataFrame:
    """Long samples to (path, content), one archive per time; absent cells are NaN.

    A group holds one sample: duplicates are averaged first, so its size is bounded by the grid. A cell outside the
    block or an unknown channel is an error.
    """
    order = F.create_map(*[F.lit(x) for i, c in enumerate(channels) for x in (c, i)])
    pos = F.when(F.col("role") == "y", F.lit(len(channels))).otherwise(F.try_element_at(order, F.col("channel")))
    at = inside_block(pos * (ny * nx) + F.col("iy") * nx + F.col("ix"), pos.isNotNull(), ny, nx).alias("_at")
    unique = samples.groupBy("time", at).agg(F.avg("value").cast("float").alias("_v")).where("_v is not null")
    packed = unique.groupBy(time_token("time", frequency).alias("token")).agg(F.collect_list(F.struct("_at", "_v")).alias("_e")).select(
        "token", F.transform("_e", lambda e: e["_at"]).alias("idx"), F.transform("_e", lambda e: e["_v"]).alias("val"))
    n = len(channels)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for token, idx, val in zip(frame["token"], frame["idx"], frame["val"]):
                block = np.full((n + 1) * ny * nx, np.nan, dtype=np.float32)
                block[np.asarray(idx, dtype=np.int64)] = val
                block = block.reshape(n + 1, ny, nx)
                arrays = {"x": block[:n]}
                if not np.isnan(block[n]).all():
                    arrays["y"] = block[n:]
                buffer = io.BytesIO()
                np.savez(buffer, **arrays)
                out.append((f"sample_{token}.npz", buffer.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return packed.mapInPandas(write, "path string, content binary")
