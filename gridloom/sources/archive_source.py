"""Sample archives (``sample_YYYYMMDD[HH].npz``) as a Spark data source, read and written.

``spark.read.format("sample_archives").load(folder)`` lists the folder once and deals its files to tasks. Files are
pruned by the date in their name before any is opened: by the options ``start`` and ``end`` (days, inclusive), and by
filters on ``time`` where Spark pushes them down. With ``headers`` only the array headers are read, which tells roles,
shapes and types without loading a value. Writing puts each archive under a hidden name first and renames it when whole,
so a reader, or a repeated task, never meets half a file.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from gridloom.sources.archives import encode_archives

NAME = "sample_archives"
CELLS = "time timestamp, role string, channel_pos int, iy int, ix int, value float"
HEADERS = "path string, time timestamp, role string, dtype string, channels int, ny int, nx int"
_FILE = re.compile(r"sample_(\d{8})(\d{2})?\.npz$")
PART_BYTES, PART_FILES = 64 << 20, 512  # of one task


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a path or a URI."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", folder) and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", folder)


def _instant(name: str, zone: str) -> dt.datetime | None:
    """The time in a file's name, in the session's zone."""
    m = _FILE.search(name)
    if not m:
        return None
    return dt.datetime.strptime(m[1] + (m[2] or "00"), "%Y%m%d%H").replace(tzinfo=ZoneInfo(zone))


class _Files(ds.InputPartition):
    def __init__(self, files: list[tuple[str, dt.datetime]]):
        super().__init__(files)


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options):
        self.folder, self.headers = options["path"], options.get("headers", "false").lower() == "true"
        self.zone = options.get("timezone", "UTC")
        day = lambda c: dt.datetime.fromisoformat(c).replace(tzinfo=ZoneInfo(self.zone))
        self.low = day(options["start"]) if options.get("start") else None
        self.high = day(options["end"]) + dt.timedelta(days=1) if options.get("end") else None  # exclusive
        self.up_to = None  # inclusive, from filters

    def partitions(self):
        system, path = _located(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=False)):
            at = _instant(info.base_name, self.zone) if info.is_file and not info.base_name.startswith(".") else None
            if at and not (self.low and at < self.low) and not (self.high and at >= self.high) and not (self.up_to and at > self.up_to):
                found.append((info.path, at, info.size or 0))
        parts, held, size = [], [], 0
        for name, at, n in sorted(found):
            if held and (size + n > PART_BYTES or len(held) >= PART_FILES):
                parts.append(_Files(held))
                held, size = [], 0
            held.append((name, at))
            size += n
        return [*parts, _Files(held)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        system, _ = _located(self.folder)
        for name, at in partition.value:
            with system.open_input_file(name) as handle:
                yield from (self._shapes(name, at, handle) if self.headers else self._cells(at, handle))

    def _shapes(self, name: str, at: dt.datetime, handle) -> Iterator[pa.RecordBatch]:
        rows = []
        with zipfile.ZipFile(handle) as archive:
            for member in archive.namelist():
                with archive.open(member) as body:
                    major = np.lib.format.read_magic(body)[0]
                    shape, _, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(body)
                rows.append((member.removesuffix(".npy"), str(kind), *(shape if len(shape) == 3 else (None, None, None))))
        role, kind, *extent = zip(*rows) if rows else ((),) * 5
        n, ints = len(rows), [pa.array(e, pa.int32()) for e in extent]
        yield pa.record_batch([pa.array([name] * n, pa.string()), pa.array([at] * n, pa.timestamp("us", "UTC")), pa.array(role, pa.string()), pa.array(kind, pa.string()), *ints],
                              names=[c.split()[0] for c in HEADERS.split(", ")])

    def _cells(self, at: dt.datetime, handle) -> Iterator[pa.RecordBatch]:
        with np.load(io.BytesIO(handle.read())) as archive:
            for role in ("x", "y"):
                if role not in archive.files:
                    continue
                block = np.asarray(archive[role], np.float32)
                channels, ny, nx = block.shape
                iy, ix = (a.ravel().astype(np.int32) for a in np.indices((ny, nx)))
                for pos in range(channels):
                    value, n = block[pos].ravel(), ny * nx
                    yield pa.record_batch(
                        [pa.array([at] * n, pa.timestamp("us", "UTC")), pa.array([role] * n), pa.array(np.full(n, pos, np.int32)), pa.array(iy), pa.array(ix), pa.array(value, mask=np.isnan(value))],
                        names=[c.split()[0] for c in CELLS.split(", ")])


class PrunedArchiveReader(ArchiveReader):
    """For sessions that push filters down to Python sources; elsewhere Spark refuses a reader that takes them."""

    def pushFilters(self, filters):
        """Bounds on ``time`` prune files; Spark applies all filters again, so nothing hangs on this."""
        for f in filters:
            if getattr(f, "attribute", None) == ("time",) and isinstance(getattr(f, "value", None), dt.datetime):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=ZoneInfo(self.zone))
                if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                    self.low = max(filter(None, (self.low, at)))
                if isinstance(f, ds.LessThan):
                    self.high = min(filter(None, (self.high, at)))
                if isinstance(f, (ds.LessThanOrEqual, ds.EqualTo)):
                    self.up_to = min(filter(None, (self.up_to, at)))
            yield f


class ArchiveWriter(ds.DataSourceWriter):
    """Rows of (path, content) as files of the folder."""

    def __init__(self, options):
        self.folder = options["path"]

    def write(self, rows) -> ds.WriterCommitMessage:
        system, path = _located(self.folder)
        system.create_dir(path, recursive=True)
        for row in rows:
            hidden = f"{path}/.{row['path']}.{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as out:
                out.write(row["content"])
            system.move(hidden, f"{path}/{row['path']}")
        return ds.WriterCommitMessage()


class ArchiveSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false").lower() == "true" else CELLS

    def reader(self, schema):
        pushed = self.options.get("pushdown", "false").lower() == "true"
        return (PrunedArchiveReader if pushed else ArchiveReader)(dict(self.options))

    def writer(self, schema, overwrite):
        return ArchiveWriter(dict(self.options))


def _source(spark: SparkSession, **options):
    spark.dataSource.register(ArchiveSource)
    given = {k: v for k, v in options.items() if v is not None}
    given["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("timezone", spark.conf.get("spark.sql.session.timeZone")).options(**given)


def write_archives(samples: DataFrame, folder: str, channels: list[str], ny: int, nx: int, frequency: str = "daily") -> None:
    """Long samples as one archive per time in a folder that all executors reach; an archive of the same time is replaced."""
    samples.sparkSession.dataSource.register(ArchiveSource)
    encode_archives(samples, channels, ny, nx, frequency).write.format(NAME).mode("append").save(folder)


def scan_archives(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(time, role, channel_pos, iy, ix, value) of the archives from day ``start`` to day ``end``; others are not opened."""
    return _source(spark, start=start, end=end).load(folder)


def archive_headers(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(path, time, role, dtype, channels, ny, nx) of every array; no values are read."""
    return _source(spark, start=start, end=end, headers="true").load(folder)


def archive_structure(headers: DataFrame, target_until: str | None = None) -> DataFrame:
    """Per date: roles present, channels of x, extents, types, and whether roles, extents and types are as expected.

    Both roles are expected up to ``target_until`` (always, if not given), only x after it; x and y must share extents.
    """
    table = headers.groupBy(F.to_date("time").alias("date")).agg(
        F.concat_ws(",", F.array_sort(F.collect_set("role"))).alias("roles"), F.max(F.when(F.col("role") == "x", F.col("channels"))).alias("channels"),
        F.max("ny").alias("ny"), F.max("nx").alias("nx"), F.concat_ws(",", F.array_sort(F.collect_set("dtype"))).alias("dtypes"),
        ((F.min("ny") == F.max("ny")) & (F.min("nx") == F.max("nx"))).alias("_even"),
    )
    both = F.lit(True) if target_until is None else F.col("date") <= F.lit(target_until).cast("date")
    expected = F.when(both, "x,y").otherwise("x")
    good = (F.col("roles") == expected) & F.coalesce("_even", F.lit(False)) & (F.col("dtypes") == "float32")
    return table.withColumns({"expected": expected, "status": F.when(good, "ok").otherwise("fail")}).drop("_even")
