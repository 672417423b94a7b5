"""One experiment from fitting to metrics, and all studies of a registry's groups."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import ranking, thresholds
from gaugeworks.operators.predictions import Scorer
from gaugeworks.sources.registry import Registry


def run_experiment(scorer: Scorer, splits: Mapping[str, DataFrame], rate: float, label: str = "label", train: str = "train", validation: str = "validation", test: str = "test") -> tuple[DataFrame, DataFrame]:
    """(result, predictions): the scorer is fitted on normal training rows, its threshold set on normal validation rows,
    and everything measured on test rows, in one result row with the seconds of each stage."""
    began = time.perf_counter()
    fitted = scorer.fit(splits[train].where(F.col(label) == 0), "train", label)
    fit_seconds = time.perf_counter() - began
    parts = [fitted.transform(splits[s]).withColumn("split", F.lit(s)) for s in (validation, test)]
    predictions = parts[0].unionByName(parts[1]).persist()
    began = time.perf_counter()
    n = predictions.count()
    predict_seconds = time.perf_counter() - began
    own = predictions.where(F.col("split") == test)
    cut = thresholds.ranked_threshold(predictions.where((F.col("split") == validation) & (F.col(label) == 0)), "score", rate, least_n=1)
    point = thresholds.operating_point(own, label, "score", cut)
    result = ranking.roc_auc(own, label, "score").crossJoin(ranking.average_precision(own, label, "score")).crossJoin(cut).crossJoin(point)  # one row each
    return result.withColumns({"fit_seconds": F.lit(fit_seconds), "predict_seconds": F.lit(predict_seconds), "n_predictions": F.lit(n)}), predictions


def run_studies(registry: Registry, studies: Mapping[str, Callable[[DataFrame], DataFrame]], **where: object) -> dict[str, DataFrame]:
    """Each study of the predictions of all completed runs that match; the predictions of all runs are one table with
    run_id and group_id, so a study groups by them instead of looping over runs."""
    results = registry.results(status="completed", **where)
    held = registry._read("predictions")
    if results is None or held is None:
        return {}
    rows = held.join(results.select("run_id", "group_id"), "run_id")
    return {name: study(rows) for name, study in studies.items()}


def calibration_of_runs(rows: DataFrame, rate: float, label: str = "label") -> DataFrame:
    """A study for :func:`run_studies`: each run's rank threshold with FPR and recall on its own test rows."""
    cut = thresholds.ranked_threshold(rows.where((F.col("split") == "validation") & (F.col(label) == 0)), "score", rate, ("run_id",), least_n=1)
    own = rows.where(F.col("split") == "test").join(cut.select("run_id", "threshold"), "run_id")
    return ranking.confusion(own, label, "score", F.col("threshold"), ("run_id",))
