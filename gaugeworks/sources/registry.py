"""A registry of runs as partitioned Parquet: results, predictions and failures by run id."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object, n: int = 64) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:n]


@dataclass(frozen=True)
class RunSpec:
    """Everything that decides a run's result; its id is a digest of it."""

    dataset: dict
    model: dict
    transform: dict = field(default_factory=dict)
    evaluation: dict = field(default_factory=dict)
    seed: int = 0
    role: str = "development"

    @property
    def run_id(self) -> str:
        return digest(asdict(self), 16)

    @property
    def group_id(self) -> str:
        return digest({k: v for k, v in asdict(self).items() if k != "seed"}, 16)


def merged(base: Mapping, override: Mapping, strict: bool = False, at: str = "") -> dict:
    """Nested mappings merged, lists replaced; ``strict`` refuses keys that the base lacks."""
    out = dict(base)
    for k, v in override.items():
        if strict and k not in base:
            raise KeyError(f"unknown setting {at}{k}")
        out[k] = merged(base[k], v, strict, f"{at}{k}.") if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v
    return out


def override(text: str) -> dict:
    """``a.b=value`` as a nested mapping; the value is read as JSON if it is some."""
    path, sep, raw = text.partition("=")
    if not sep:
        raise ValueError(f"not a setting: {text}")
    try:
        value = json.loads(raw)
    except ValueError:
        value = raw
    for key in reversed(path.split(".")):
        value = {key: value}
    return value


def flattened(config: Mapping, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flattened(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {f"{prefix}{k}": v}
    return out


class Registry:
    """Tables below one folder, each partitioned by run id; writing a run again replaces it alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, df: DataFrame, table: str, run_id: str) -> None:
        own = df.withColumn("run_id", F.lit(run_id))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{self.root}/{table}")

    def write(self, spec: RunSpec, result: DataFrame, predictions: DataFrame | None = None) -> str:
        """Predictions first: a run counts as completed once its result is there."""
        if predictions is not None:
            self._write(predictions, "predictions", spec.run_id)
        own = result.withColumn("spec", F.lit(canonical(asdict(spec)))).withColumn("group_id", F.lit(spec.group_id)).withColumn("status", F.lit("completed"))
        self._write(own, "results", spec.run_id)
        return spec.run_id

    def write_failure(self, spec: RunSpec, reason: str) -> None:
        row = self.spark.createDataFrame([(canonical(asdict(spec)), reason)], "spec string, reason string")
        self._write(row, "failures", spec.run_id)

    def _read(self, table: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{table}")
        except AnalysisException:  # nothing written yet
            return None

    def results(self, **where: object) -> DataFrame | None:
        """All results with equal values in the named columns; the filters reach the files."""
        df = self._read("results")
        for k, v in where.items():
            df = df if df is None else df.where(F.col(k) == F.lit(v))
        return df

    def completed(self, run_id: str) -> bool:
        df = self.results(run_id=run_id)
        return df is not None and not df.isEmpty()

    def predictions(self, run_id: str) -> DataFrame | None:
        df = self._read("predictions")
        return None if df is None else df.where(F.col("run_id") == run_id)

    def execute(self, spec: RunSpec, run) -> DataFrame:
        """``run(spec) -> (result, predictions)`` unless the run is there; a failure is recorded and raised."""
        if not self.completed(spec.run_id):
            try:
                self.write(spec, *run(spec))
            except Exception as e:
                self.write_failure(spec, f"{type(e).__name__}: {e}"[:2000])
                raise
        return self.results(run_id=spec.run_id)


def write_results(df: DataFrame, path: str, keys: list[str]) -> None:
    """A report as one ordered CSV file; it has one row for each run."""
    df.orderBy(*keys).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_results(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys are not at ``path`` yet; how many there were. A repeated call appends nothing."""
    from pyspark.errors import AnalysisException

    own = df.dropDuplicates(keys)
    try:
        own = own.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException:  # nothing there yet
        pass
    own = own.persist()
    n = own.count()
    if n:
        own.write.mode("append").parquet(path)
    own.unpersist()
    return n


def save_artifact(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], meta: Mapping, threshold: float, guards: DataFrame | None = None) -> None:
    """A fitted model as Parquet tables beside one JSON text of settings, frozen threshold and format; the text is
    written last, so that a folder without it holds no artifact."""
    root = path.rstrip("/")
    for name, df in {**tables, **({"guards": guards} if guards is not None else {})}.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    text = canonical({"format": ARTIFACT, "tables": sorted(tables), "guards": guards is not None, "threshold": threshold, **meta})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/meta")


def load_artifact(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """Settings and tables of an artifact; another format is refused."""
    root = path.rstrip("/")
    meta = json.loads(spark.read.text(f"{root}/meta", wholetext=True).first().value)
    if meta.get("format") != ARTIFACT:
        raise ValueError(f"{path} has format {meta.get('format')}, not {ARTIFACT}")
    names = [*meta["tables"], *(["guards"] if meta["guards"] else [])]
    return meta, {n: spark.read.parquet(f"{root}/{n}") for n in names}


#: Version of the artifact's layout.
ARTIFACT = 1


class Tracker:
    """Parameters and metrics of a run as rows of one table, written when the run ends, also by an error."""

    def __init__(self, spark: SparkSession, path: str, name: str, reportable: bool = True):
        self.spark, self.path, self.name, self.reportable, self.rows = spark, path, name, reportable, []

    def __enter__(self) -> Tracker:
        self.began = time.time()
        return self

    def log(self, kind: str, values: Mapping[str, object]) -> None:
        self.rows += [(kind, k, None if isinstance(v, str) else float(v), str(v)) for k, v in flattened(values).items()]

    def __exit__(self, error, *_) -> None:
        self.log("run", {"seconds": time.time() - self.began, "status": "failed" if error else "completed"})
        own = self.spark.createDataFrame(self.rows, "kind string, key string, value double, text string")
        own = own.select(F.lit(self.name).alias("run"), F.lit(self.reportable).alias("reportable"), "*")
        own.coalesce(1).write.mode("append").parquet(self.path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report as a Markdown table, undefined values as a dash. A table of more than ``limit`` rows is cut, and says so."""
    rows = df.limit(limit + 1).collect()
    shown = lambda v: "-" if v is None or v != v else f"{v:.4g}" if isinstance(v, float) else str(v)
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    text = head + "".join(f"| {' | '.join(shown(v) for v in r)} |\n" for r in rows[:limit])
    return text if len(rows) <= limit else f"{text}\nThe first {limit} of {df.count()} rows.\n"


def report(title: str, sections: Mapping[str, DataFrame]) -> str:
    """A profile's or study's tables below one another, each under its name; an empty one is said to be empty."""
    parts = [f"# {title}\n"]
    for name, df in sections.items():
        parts.append(f"## {name}\n\n" + ("No rows.\n" if df.isEmpty() else markdown(df)))
    return "\n".join(parts)


def write_report(spark: SparkSession, title: str, sections: Mapping[str, DataFrame], path: str) -> None:
    """The report as Markdown text and each table as JSON lines below ``path``."""
    root = path.rstrip("/")
    spark.createDataFrame([(report(title, sections),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/report")
    for k, df in enumerate(sections.values()):
        df.coalesce(1).write.mode("overwrite").json(f"{root}/table-{k}")
