"""Session set-up, the shared folder, and the size check in front of every broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows and this many bytes of key and value data.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "trialgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; `conf` keys use `__` for a dot."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.variable.substitute", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local session, where driver and executors are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trialgrid-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to reliable storage and continue from there, so a loop's plan does not grow."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure rows and bytes of `df` in one aggregate and compare them with the bounds."""
    widths = [
        F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) for name in df.columns
    ]
    row_bytes = sum(widths, F.lit(16))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, **bounds: int) -> DataFrame:
    """`df` with a broadcast hint when its measured size allows it; otherwise Spark shuffles as usual.

    Beyond the bound the join is a shuffle join, where AQE splits skewed partitions of the fact side.
    """
    return F.broadcast(df) if fits_broadcast(df, **bounds) else df
