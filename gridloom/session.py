"""Session helpers: the shared work folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes up to which a dimension table (weights, grid, statistics) is broadcast: some 20 MB on each
# executor; beyond it the join stays a shuffle join that AQE can split.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 24_000_000
# The same where the other side holds every cell at every time: to shuffle that costs far more than a larger broadcast.
DENSE_ROWS, DENSE_BYTES = 1_000_000, 64_000_000


def local_session(app: str = "gridloom", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only when the setting is absent and the session is local (tests, a laptop) is a temporary folder used
    instead, removed at exit; on a cluster each executor would write to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet, below the shared folder."""
    return f"{shared_folder(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


_open = threading.local()


class Scratch:
    """Tables written within a block, removed at its end but for those kept."""

    def __init__(self):
        self.written: list[tuple[str, DataFrame]] = []

    def keep(self, *tables: DataFrame) -> None:
        """The tables outlive this block; they belong to the block around it, if there is one."""
        ours = [(p, t) for p, t in self.written if any(t is k for k in tables)]
        self.written = [(p, t) for p, t in self.written if not any(t is k for k in tables)]
        around = _open.blocks[:-1] if _open.blocks and _open.blocks[-1] is self else []
        if around:
            around[-1].written += ours

    def remove(self) -> None:
        for path, table in self.written:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
        self.written = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Remove what ``materialise`` writes within the block, unless it is kept, when the block ends or fails.

    What a result still reads must be kept: a table is read when the result is, not when it is planned.
    """
    if not hasattr(_open, "blocks"):
        _open.blocks = []
    block = Scratch()
    _open.blocks.append(block)
    try:
        yield block
    finally:
        block.remove()
        _open.blocks.remove(block)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage by writing the rows to the shared folder and reading them back.

    A lost executor then costs a re-read, not a recomputation of everything upstream.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if getattr(_open, "blocks", None):
        _open.blocks[-1].written.append((path, out))
    return out


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[None]:
    """SQL settings (``__`` for a dot) for what runs within the block, restored at its end."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20):
    """Smaller batches between Spark and its Python workers, for rows with long texts: both sides hold a batch or two."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows, spark__sql__execution__arrow__maxBytesPerBatch=size)


def _bytes(name: str, kind: T.DataType):
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0)) * 8 + 24
    return F.lit(8)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the table stays below both limits; reads no further than ``max_rows`` rows."""
    width = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(16))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def attach(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS,
           derived: bool = False, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a fact to a dimension: broadcast if its size was checked in rows and bytes, otherwise a shuffle join.

    The shuffle join is left to AQE, which splits partitions swollen by a hot key. A ``derived`` dimension
    costs a pass over the facts; it is written out first, so that the size check does not repeat the pass.
    """
    if derived:
        small = materialise(small, "dimension")
    side = F.broadcast(small) if fits_broadcast(small, max_rows, max_bytes) else small
    return big.join(side, on, how)
