"""Shared-folder tables that cut lineage, and worker set-up.

Intermediate tables go below ``spark.checkpoint.dir``, which every executor and
the driver can reach, so that a lost executor costs only a re-read.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`materialize`, once nothing reads it."""
    sc = df.sparkSession.sparkContext
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = sc._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: Tables of at most so many rows, and of so many characters as JSON, are broadcast.
SMALL_ROWS, SMALL_BYTES = 500_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """A broadcast of a table whose rows and bytes are checked; a larger one is left to a shuffle."""
    if df.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return df
    size = df.select(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0]
    return F.broadcast(df) if (size or 0) <= SMALL_BYTES else df


def unused(columns: list[str], name: str) -> str:
    """A name that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bytes of the batches that Python workers get, and what limits them; Spark's own limits let 10,000 texts through at once.
BATCH_BYTES, BATCH_LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed, and get small batches unless the session says how large."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


#: What clears the caches that a module keeps in its Python workers, by the module's part in a task.
_CACHES: dict[str, list[Callable[[], None]]] = {}


def caches(part: str, clear: Callable[[], None]) -> None:
    """Say how the caches of ``part`` are cleared."""
    _CACHES.setdefault(part, []).append(clear)


def enter(part: str) -> None:
    """Clear the caches of all other parts: a Python worker goes from one operator's tasks to another's."""
    for name, clears in _CACHES.items():
        if name != part:
            for clear in clears:
                clear()
    release()


def release() -> None:
    """Give a Python worker's free memory back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
