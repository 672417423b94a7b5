"""Shared intermediate storage and size-checked joins for the training-data operators.

Executors may be lost at any time and share no local folder with the driver, so whatever
outlives one job is written below the folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many bytes (rows x row width, counted first), else it is shuffled.
BROADCAST_BYTES = 32 << 20

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A session of one machine without one gets a temporary folder (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = tempfile.mkdtemp(prefix="gaugeworks-")
            atexit.register(shutil.rmtree, _OWN[key], True)
        base = f"file://{_OWN[key]}"
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there. The table is deleted when
    the application ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/gaugeworks/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def small_or_shuffled(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the counted rows fit ``limit`` bytes; otherwise leave a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of ``frames`` has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    k = 0
    while f"_{name}_{k}" in taken:
        k += 1
    return f"_{name}_{k}"


def release() -> None:
    """Give memory back to the system at the end of a task: Python workers live on and serve later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
