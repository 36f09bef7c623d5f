"""Session defaults and the parameters of a study."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Study:
    """Parameters shared by features, neighbours and target records."""

    interval_s: int = 7200
    lookback: int = 6
    history: int = 100
    stride: int = 1
    neighbours: int = 40
    horizons: tuple[int, ...] = (1, 2, 3, 6)
    k_values: tuple[int, ...] = (5, 10, 20)
    block_rows: int = 4096

    @property
    def max_horizon(self) -> int:
        return max(self.horizons)


# The market defaults: 10-minute bars, 20-bar lookback, 10 000 states of history.
MARKET = Study(interval_s=600, lookback=20, history=10_000, stride=60, neighbours=100, k_values=(25, 50, 100))


def get_session(app: str = "barline", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; everything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_FOLDERS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``.

    Without the setting a cluster session fails; a local one, whose threads share the machine, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _FOLDERS[app]
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a data product to the shared folder and read it back.

    The result has a short plan and file statistics, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def products(spark: SparkSession) -> list[str]:
    """The data products that this session has written and not deleted."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def close(spark: SparkSession) -> int:
    """Delete the data products this session has written; returns their number."""
    return discard(spark, products(spark))


def discard(spark: SparkSession, paths: list[str]) -> int:
    """Delete some data products, which nothing will read again; returns their number."""
    held = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths = [p for p in paths if p in held]
    for path in paths:
        held.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def source_version(spark: SparkSession, folder: str) -> tuple[tuple[str, int], ...]:
    """Names and modification times of a folder's tables: a changed table is another version."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return tuple((f.getPath().getName(), f.getModificationTime()) for f in found)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partition into the session's full number of shuffle partitions.

    For rows that are few bytes but much work: a plain shuffle would be coalesced to a few tasks by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Write a join side, and mark it for broadcast only if it has at most ``rows`` rows; else it is merged.

    Counting what is written runs the side's own plan once.
    """
    df = written(df, "side")
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
