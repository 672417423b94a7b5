"""Calibration on out-of-fold scores: a model of each position's mean and deviation, fitted without one fold at a time.

The fits of all folds come from one aggregate: the moments of the whole less those of the fold. No fold is refitted.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import ranking, statistics, thresholds

#: Least deviation of a position.
FLOOR = 1e-6


def moments(cells: DataFrame, fold: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """(fold, pos, mean, sd, n) of all other folds."""
    v = F.col(value)
    own = cells.groupBy(fold, pos).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count("*").alias("n"))
    whole = own.groupBy(pos).agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"), F.sum("n").alias("tn"))
    rest = own.join(whole, pos).select(fold, pos, (F.col("ts") - F.col("s")).alias("s"), (F.col("tq") - F.col("q")).alias("q"), (F.col("tn") - F.col("n")).alias("n")).where("n > 0")
    return _fitted(rest, [fold, pos])


def _fitted(sums: DataFrame, by: list[str]) -> DataFrame:
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    return sums.select(*by, mean.alias("mean"), F.greatest(F.sqrt(var), F.lit(FLOOR)).alias("sd"), "n")


def out_of_fold_scores(cells: DataFrame, id: str, fold: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """(id, fold, score): each map's largest deviation from the model of the other folds."""
    own = cells.join(moments(cells, fold, pos, value), [fold, pos])
    return own.groupBy(id, fold).agg(F.max((F.col(value) - F.col("mean")) / F.col("sd")).alias("score"))


def scores(cells: DataFrame, train: DataFrame, id: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """(id, score) under the model of all of ``train``."""
    v = F.col(value)
    model = _fitted(train.groupBy(pos).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count("*").alias("n")), [pos]).drop("n")
    return cells.join(model, pos).groupBy(id).agg(F.max((v - F.col("mean")) / F.col("sd")).alias("score"))


def thresholds_of_pools(pools: Mapping[str, DataFrame], test: DataFrame, label: str, score: str, target: float) -> DataFrame:
    """A row for each pool of normal scores: n, k, bound, its threshold, false alarms, FPR and recall on ``test``, and the
    probability of so many false alarms or more if pool and test normals are exchangeable."""
    rows = None
    for name, pool in pools.items():
        own = pool.select(F.lit(name).alias("source"), F.col(score).alias("score"))
        rows = own if rows is None else rows.unionAll(own)
    at = thresholds.ranked_threshold(rows, "score", target, ("source",)).select("source", "n", F.greatest(F.col("k"), F.lit(1)).alias("k"), "threshold")
    normals = test.where(F.col(label) == 0).count()
    met = ranking.at_cuts(test, label, score, at, "threshold")

    @F.pandas_udf("double")
    def tail(fp: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([statistics.exceedance_p(int(a), normals, int(b), int(c)) for a, b, c in zip(fp, n, k, strict=True)])

    fp = F.round(F.col("fpr") * normals).cast("long")
    out = met.select("source", "n", "k", (F.col("k") / (F.col("n") + 1)).alias("bound"), "threshold", fp.alias("fp"), "fpr", "recall")
    return out.withColumn("tail_p", tail("fp", "n", "k"))
