"""Cutting lineage through the folder that driver and executors share.

``cut`` writes a table below ``spark.checkpoint.dir`` and reads it back, so that later stages neither
recompute it nor depend on blocks of one executor. Nothing here uses ``localCheckpoint``. Tables that are
cut inside ``scratch()`` are deleted at its end, but for those handed to ``keep``, which results read;
these go with the session, or by ``clear``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: One folder per process below the shared one, so that a session can clear what it left.
_OWN = f"gridloom-{uuid.uuid4().hex}"


@cache
def _fallback() -> str:
    path = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


#: The applications and folders that are swept when they end.
_SWEPT: set[tuple[str, str]] = set()


def _sweep(spark: SparkSession, top: str) -> None:
    """Has Spark's JVM delete this process's folder below ``top`` when it ends."""
    if (spark.sparkContext.applicationId, top) not in _SWEPT:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{_OWN}")
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _SWEPT.add((spark.sparkContext.applicationId, top))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and the master is this machine (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _fallback()
    _sweep(spark, found.rstrip("/"))
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{_OWN}/{label}-{uuid.uuid4().hex}"


#: The tables cut in every open scratch(), the innermost last, by path.
_SCRATCH: ContextVar[tuple[dict[str, DataFrame], ...]] = ContextVar("scratch", default=())


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: the same rows, an empty lineage."""
    path, conf = new_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")  # the write's shuffle files go when it ends; else they stay until the driver happens to collect its garbage
    try:
        df.write.option("compression", "zstd").parquet(path)  # snappy's buffers lie outside the heap until some later collection
    finally:
        conf.set(_CLEANUP, before)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._gridloom_path = path
    for made in _SCRATCH.get()[-1:]:
        made[path] = again
    return again


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame that ``cut`` returned and that nothing reads any more."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        for made in _SCRATCH.get():
            made.pop(path, None)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process has cut; frames that read them can't be used any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{_OWN}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch():
    """Deletes what is cut inside when it ends; frames that are read later must be cut and kept."""
    made: dict[str, DataFrame] = {}
    token = _SCRATCH.set((*_SCRATCH.get(), made))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for table in list(made.values()):
            discard(table)


def keep(df: DataFrame) -> DataFrame:
    """A frame that ``cut`` returned, handed from the innermost scratch() to the one around it, if any."""
    path = df._gridloom_path
    for made in _SCRATCH.get()[-1:]:
        made.pop(path, None)
    for outer in _SCRATCH.get()[-2:-1]:
        outer[path] = df
    return df


#: Rows that cross to Python at a time, where the session leaves Spark's default of 10,000: rows here hold whole texts.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, and keeps what they hold at a time small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    pa.set_memory_pool(pa.system_memory_pool())  # as for the workers below
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # it hands freed memory back
    env.setdefault("MALLOC_ARENA_MAX", "2")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
