"""Screens and re-analyses of stored predictions: pixel thresholds, recalibration, borders, sweeps and confirmation rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import share
from gaugeworks.operators import ranking, statistics, thresholds


def threshold_grid(cells: DataFrame, value: str, limit: float, n: int, truth: str = "truth") -> DataFrame:
    """A grid dense where an overlap curve up to ``limit`` is integrated: the quantiles of the negative cells for FPRs evenly
    spaced from 0 to 1.2 limit (1 at most), and a value above all cells, those of regions too; one pass of exact percentiles."""
    top = min(1.0, 1.2 * limit)
    levels = [1.0 - top * k / (n - 1) for k in range(n)]
    negative = F.when(~F.col(truth), F.col(value))
    own = cells.agg(F.percentile(negative, F.array(*map(F.lit, levels))).alias("q"), F.max(value).alias("m"))
    above = F.col("m") + F.greatest(F.abs("m"), F.lit(1.0)) * 2.0**-52
    return own.select(F.explode(F.array_distinct(F.concat("q", F.array(above)))).alias("threshold"))


def pixel_thresholds(normals: DataFrame, test: DataFrame, value: str, truth: str, n_sigma: float = 3.0, tail: float = 0.001) -> DataFrame:
    """Two rules for one cell threshold from normal cells, three sigma of the population and a tail quantile, and what
    each does on test cells: precision, recall and F1 over all of them."""
    cut = normals.agg((F.avg(value) + n_sigma * F.stddev_pop(value)).alias("sigma"), F.percentile(value, F.lit(1.0 - tail)).alias("quantile"))
    rules = cut.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("threshold")) for r in ("sigma", "quantile")))).alias("x")).select("x.*")
    hit, y = F.col(value) > F.col("threshold"), F.col(truth)
    own = test.select(value, truth).crossJoin(F.broadcast(rules)).groupBy("rule", "threshold")  # two rules
    own = own.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return own.select("rule", "threshold", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def recalibration(pools: Mapping[str, DataFrame], test: DataFrame, label: str, score: str, rate: float) -> DataFrame:
    """One row for each pool of normal scores: the rank threshold that it sets, FPR and recall on ``test``, and whether the
    false alarms keep within the expected ones and two of their square roots."""
    cuts = None
    for name, pool in pools.items():
        t = thresholds.ranked_threshold(pool, score, rate, least_n=1).select(F.lit(name).alias("pool"), "n", "k", "threshold")
        cuts = t if cuts is None else cuts.unionAll(t)
    normals = test.where(F.col(label) == 0).agg(F.count("*").alias("_n"))
    out = ranking.at_cuts(test, label, score, cuts, "threshold").crossJoin(F.broadcast(normals))  # one row
    expected = F.col("k") / (F.col("n") + 1) * F.col("_n")
    alarms = F.round(F.col("fpr") * F.col("_n")).cast("long")
    return out.select("pool", "n", "threshold", "fpr", "recall", alarms.alias("false_alarms"), expected.alias("expected"), (alarms <= expected + 2 * F.sqrt(expected)).alias("within_bound"))


def inner_max(values: Column, height: int, width: int, border: int) -> Column:
    """The maximum of a map without ``border`` cells on each side, where shifted images hold nothing."""
    inside = lambda i: (F.floor(i / width) >= border) & (F.floor(i / width) < height - border) & (i % width >= border) & (i % width < width - border)
    return F.array_max(F.filter(values, lambda x, i: inside(i)))


def condition_metrics(test: DataFrame, condition: Column, label: str, score: str, threshold: DataFrame) -> DataFrame:
    """AUROC, FPR and recall of the rows for which ``condition`` holds, at a threshold set elsewhere."""
    own = test.where(condition)
    auc = ranking.roc_auc(own, label, score)
    point = thresholds.operating_point(own, label, score, threshold).select("fpr", "recall")
    return auc.crossJoin(F.broadcast(point))  # one row each


def transform_policy(verdicts: DataFrame, long_side: int) -> DataFrame:
    """(long_side, verdict, accepted) of a configured size; a size that was not weighed has no verdict and is not accepted."""
    own = verdicts.where(F.col("long_side") == long_side).agg(F.first("verdict").alias("verdict"))
    return own.select(F.lit(long_side).alias("long_side"), "verdict", F.coalesce(F.col("verdict") == "accept", F.lit(False)).alias("accepted"))


def confirmed(comparison: DataFrame, by: Sequence[str], least_gain: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """The pre-registered rule for each family ``by`` of paired comparisons (difference, low, p_value): most categories gain,
    by an exact sign test, and the mean gain exceeds ``least_gain`` with no category significantly worse."""
    gain = F.col("difference") > 0
    out = comparison.groupBy(*by).agg(F.count_if(gain).cast("int").alias("wins"), F.count_if(F.col("difference") != 0).cast("int").alias("n"), F.avg("difference").alias("mean_gain"), F.count_if(F.col("high") < 0).alias("worse"))

    @F.pandas_udf("double")
    def tail(wins: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([statistics.sign_test(int(w), int(m)) for w, m in zip(wins, n, strict=True)])

    out = out.withColumn("sign_p", tail("wins", "n"))
    return out.withColumn("confirmed", (F.col("sign_p") <= alpha) & (F.col("mean_gain") > least_gain) & (F.col("worse") == 0))


def screen(comparison: DataFrame, alarms: DataFrame, keys: Sequence[str], most: float, alpha: float = 0.05) -> DataFrame:
    """Comparisons (p_holm, difference) with each variant's false-alarm rate: a variant passes when it is significantly better
    after Holm's step and keeps the rate within ``most``."""
    own = comparison.join(alarms, list(keys), "left")
    better = (F.col("p_holm") <= alpha) & (F.col("difference") > 0)
    return own.withColumn("passes", better & (F.coalesce("fpr", F.lit(1.0)) <= most))


def sweep_labels(runs: DataFrame, settings: str, base: Mapping[str, str]) -> DataFrame:
    """``runs`` with variant: the settings (a map) that differ from ``base``, as sorted key=value, or "base"."""
    held = F.create_map(*(F.lit(x) for pair in sorted(base.items()) for x in pair))
    other = F.map_filter(settings, lambda k, v: ~v.eqNullSafe(F.element_at(held, k)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(other)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return runs.withColumn("variant", F.when(text == "", "base").otherwise(text))


def logistic_head(train: DataFrame, features: Sequence[str], label: str):
    """A logistic regression on ``features`` in which both classes weigh alike; the fitted model scores any table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if not n.p or not n.n:
        raise ValueError("both classes are needed")
    weighed = train.withColumn("_w", F.when(F.col(label) == 1, 0.5 / n.p).otherwise(0.5 / n.n) * (n.p + n.n)).withColumn("_y", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="_w", standardization=True, regParam=1e-3, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted")]).fit(weighed)


def head_scores(model, df: DataFrame, into: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn(into, F.get(vector_to_array("_probability"), F.lit(1))).drop("_features", "_raw", "_probability", "_predicted")
