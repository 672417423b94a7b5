"""The flagship report: ranking quality and the operating point of one table of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import ranking, thresholds
from gaugeworks.plans import tables as T


def report(spark: SparkSession, sf_dir: str, rate: float = 0.01) -> DataFrame:
    e = T.events(spark, sf_dir)
    test = e.where("split = 'test'")
    at = thresholds.ranked_threshold(e.where("split = 'validation' AND label = 0"), "score", rate)
    point = thresholds.operating_point(test, "label", "score", at)
    parts = [ranking.roc_auc(test, "label", "score"), ranking.average_precision(test, "label", "score"), at.select("threshold", "k", "effective", "met"), point]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out
