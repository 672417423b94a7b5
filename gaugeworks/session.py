"""Sessions with the settings the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` use underscores for dots."""
    builder = SparkSession.builder.appName("gaugeworks")
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    conf |= {k.replace("_", "."): v for k, v in settings.items()}
    return builder.config(map=conf).getOrCreate()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a session of one machine that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="gaugeworks-")
        atexit.register(shutil.rmtree, _OWN[key], True)
    return f"file://{_OWN[key]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again, so that what a loop builds on does not grow with its rounds and outlives
    lost executors. The table is deleted when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/gaugeworks/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/rows")
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
