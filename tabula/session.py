"""Session helpers: a tuned local session for tests/bench and shared scratch tables.

On a cluster the session comes from the platform; only the scratch helpers are used there. They read
``spark.checkpoint.dir`` (a folder that driver and executors share) and refuse to invent one.
"""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session with AQE on, the UI off and Arrow enabled (tests and bench only)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabula")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a single-machine ``local`` master without one gets a private folder
    (removed at exit); any other master must name it in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tabula-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for a written intermediate table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabula-scratch/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: dict = {"lock": threading.Lock(), "depth": 0, "was": None}


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Queries begun inside delete their shuffle files when they end."""
    with _cleaning["lock"]:
        if not _cleaning["depth"]:
            _cleaning["was"] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _cleaning["depth"] += 1
    try:
        yield
    finally:
        with _cleaning["lock"]:
            _cleaning["depth"] -= 1
            if not _cleaning["depth"]:
                spark.conf.unset(_CLEANUP) if _cleaning["was"] is None else spark.conf.set(_CLEANUP, _cleaning["was"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. The shuffle files of the write go
    when it ends."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the scratch tables under ``df`` (``materialize``); nothing may read them again."""
    spark = df.sparkSession
    below = {posixpath.basename(posixpath.dirname(f)) for f in df.inputFiles()}
    gone = [(s, p) for s, p in _written if s is spark and posixpath.basename(p) in below]
    for entry in gone:
        _written.remove(entry)
        _delete(*entry)


def release_scratch(spark: SparkSession) -> int:
    """Delete every scratch table this session has written (their readers must be done); returns how many."""
    mine = [p for s, p in _written if s is spark]
    _written[:] = [(s, p) for s, p in _written if s is not spark]
    for p in mine:
        _delete(spark, p)
    return len(mine)
