"""Settings files with inheritance, and where a run came from: code digest, versions, memory.

Settings are small driver-side mappings; files are read and written by Spark's text source, so any path that Spark
can open will do."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import resource
import sys
from collections.abc import Iterable, Mapping
from importlib import metadata
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.sources.registry import merged, override

#: The key that names the file, or list of files, a settings file is based on.
BASE = "_base_"


def parsed(text: str, name: str) -> dict:
    """JSON, or YAML where its reader is installed."""
    if name.endswith((".yaml", ".yml")):
        import yaml

        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{name} holds no mapping")
    return value


def read_settings(spark: SparkSession, path: str, overrides: Iterable[str] = ()) -> dict:
    """The settings at ``path`` upon those that it is based on (relative to it), then ``a.b=value`` overrides, which
    must name known keys. A file that is based on itself, directly or not, is an error."""

    def read(at: str, above: tuple[str, ...]) -> dict:
        if at in above:
            raise ValueError("settings are based on themselves: " + " -> ".join((*above, at)))
        rows = spark.read.text(at, wholetext=True).collect()  # one small file
        own = parsed(rows[0].value, at)
        bases = own.pop(BASE, [])
        out: dict = {}
        for base in [bases] if isinstance(bases, str) else bases:
            folder = at.rsplit("/", 1)[0]
            out = merged(out, read(base if "://" in base or base.startswith("/") else os.path.normpath(f"{folder}/{base}") if "://" not in folder else f"{folder}/{base}", (*above, at)))
        return merged(out, own)

    settings = read(path, ())
    for text in overrides:
        settings = merged(settings, override(text), strict=True)
    return settings


def write_settings(spark: SparkSession, settings: Mapping, path: str) -> None:
    """The resolved settings as one JSON text below ``path``."""
    text = json.dumps(settings, sort_keys=True, indent=1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def implementation_id(root: str | Path | None = None, leave_out: Iterable[str] = ("tests", "streaming", "plans")) -> str:
    """A digest of the package's code, line ends alike on every system; folders that no result depends on are left out."""
    base = Path(root or Path(__file__).resolve().parent.parent)
    skipped, h = set(leave_out), hashlib.sha256()
    for file in sorted(base.rglob("*.py"), key=lambda f: f.relative_to(base).as_posix()):
        parts = file.relative_to(base).parts
        if not skipped & set(parts[:-1]):
            h.update("/".join(parts).encode() + b"\0" + file.read_bytes().replace(b"\r\n", b"\n") + b"\0")
    return h.hexdigest()[:16]


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions and sizes that a result may depend on."""
    sc = spark.sparkContext
    versions = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = "none"
    return versions | {"python": platform.python_version(), "system": platform.system(), "master": sc.master, "parallelism": str(sc.defaultParallelism), "application": sc.applicationId, "code": implementation_id()}


def peak_memory(spark: SparkSession) -> DataFrame:
    """(host, worker, mb): the greatest resident size so far of the driver's Python and of a worker on each core that answers."""

    def run(batches):
        for batch in batches:
            size = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1 << (20 if sys.platform == "darwin" else 10))
            yield pd.DataFrame({"host": [platform.node()], "worker": [str(os.getpid())], "mb": [size]}).iloc[: len(batch)]

    n = spark.sparkContext.defaultParallelism
    workers = spark.range(0, n, 1, n).mapInPandas(run, "host string, worker string, mb double").groupBy("host", "worker").agg(F.max("mb").alias("mb"))
    own = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1 << (20 if sys.platform == "darwin" else 10))
    return workers.unionAll(spark.createDataFrame([(platform.node(), "driver", own)], "host string, worker string, mb double"))
