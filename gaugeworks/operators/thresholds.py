"""Operating points calibrated on normal scores, with finite-sample guarantees."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import finite

POLICIES = ("reject", "relax", "always_accept")
METHODS = ("validation_fpr", "validation_percentile", "validation_sigma", "pixel_quantile", "test_f1_max", "always_accept", "mad")


@dataclass(frozen=True)
class Threshold:
    """A value with its origin. One taken from test data must say that it is an oracle."""

    value: float
    method: str
    source_split: str
    oracle: bool = False
    params: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if math.isnan(self.value):
            raise ValueError("a threshold cannot be NaN")
        if math.isinf(self.value) and self.method != "always_accept":
            raise ValueError("only always_accept has an infinite threshold")
        if self.source_split.startswith("test") and not self.oracle:
            raise ValueError("a threshold taken from test data is an oracle")

    def apply(self, score: Column) -> Column:
        return score > F.lit(self.value)


def least_rate(n: Column | int) -> Column:
    """The smallest false-positive rate that n calibration scores can promise."""
    return F.lit(1.0) / ((n if isinstance(n, Column) else F.lit(n)) + 1)


def conformal_rank(rate: Column | float, n: Column) -> Column:
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.floor(r * (n + 1) + F.lit(1e-9)).cast("int")


def ranked_threshold(scores: DataFrame, score: str, rate: float, by: tuple[str, ...] = (), policy: str = "relax", least_n: int = 4) -> DataFrame:
    """The k-th largest calibration score, k = floor(rate (n + 1)): threshold, k, n, effective rate, met.

    Without a rank (k = 0) "relax" takes the largest score, "always_accept" infinity and "reject"
    stops the query, as fewer than ``least_n`` scores do. A group's k largest scores come from
    counts by score, never from its whole list.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    from gaugeworks.operators.ranking import running

    counted = scores.select(*by, finite(F.col(score)).alias("_s")).groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    own = running(counted, "_s", ["_c"], by, descending=True)
    total = counted.groupBy(*by).agg(F.sum("_c").alias("n"))
    k = conformal_rank(rate, F.col("n"))
    total = total.withColumn("k", F.when(F.col("n") < least_n, F.raise_error(F.lit(f"fewer than {least_n} calibration scores")).cast("int")).otherwise(k))
    joined = own.join(F.broadcast(total), list(by)) if by else own.crossJoin(F.broadcast(total))  # one row for each group
    best = joined.groupBy(*by, "n", "k").agg(F.max(F.when(F.col("cum__c") >= F.greatest(F.col("k"), F.lit(1)), F.col("_s"))).alias("_t"))
    none = {"relax": F.col("_t"), "always_accept": F.lit(float("inf")), "reject": F.raise_error(F.lit("too few scores for the rate")).cast("double")}[policy]
    return best.select(
        *by,
        F.when(F.col("k") >= 1, F.col("_t")).otherwise(none).alias("threshold"),
        F.col("k").cast("int").alias("k"),
        F.col("n").cast("long").alias("n"),
        (F.greatest(F.col("k"), F.lit(1 if policy == "relax" else 0)) / (F.col("n") + 1)).alias("effective"),
        (F.col("k") >= 1).alias("met"),
    )


def percentile_threshold(scores: DataFrame, score: str, percentile: float, **options) -> DataFrame:
    """The rank rule in terms of a percentile; never interpolated."""
    return ranked_threshold(scores, score, 1.0 - percentile / 100.0, **options)


def sigma_threshold(scores: DataFrame, score: str, n_sigma: float, sample: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and ``n_sigma`` deviations: of the sample (image scores) or the population (cells)."""
    sd = F.stddev_samp if sample else F.stddev_pop
    return scores.groupBy(*by).agg((F.avg(score) + F.lit(float(n_sigma)) * sd(score)).alias("threshold"))


def mad_threshold(scores: DataFrame, score: str, n_sigma: float) -> DataFrame:
    """Median and ``n_sigma`` scaled median absolute deviations."""
    middle = scores.agg(F.median(score).alias("_m"))
    off = scores.crossJoin(F.broadcast(middle)).agg(F.first("_m").alias("_m"), F.median(F.abs(F.col(score) - F.col("_m"))).alias("_d"))
    return off.select((F.col("_m") + F.lit(float(n_sigma) * 1.4826) * F.col("_d")).alias("threshold"))


def operating_point(test: DataFrame, label: str, score: str, threshold: DataFrame) -> DataFrame:
    """Confusion counts, FPR and recall of ``test`` at the one-row ``threshold`` table."""
    from gaugeworks.operators.ranking import confusion

    own = test.crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("_t"))))
    return confusion(own, label, score, F.col("_t"))


class ScoreNormalizer:
    """Min-max scaling, fitted once on a split that is no test split; values are not clipped."""

    def __init__(self):
        self.bounds: DataFrame | None = None

    def fit(self, df: DataFrame, score: str, split: str) -> ScoreNormalizer:
        if split.startswith("test"):
            raise ValueError("scaling is not fitted on test data")
        if self.bounds is not None:
            raise ValueError("already fitted")
        self.bounds = df.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
        return self

    def transform(self, df: DataFrame, score: str, into: str = "scaled") -> DataFrame:
        if self.bounds is None:
            raise ValueError("not fitted")
        own = df.crossJoin(F.broadcast(self.bounds))
        width = F.col("_high") - F.col("_low")
        return own.withColumn(into, F.coalesce(F.try_divide(F.col(score) - F.col("_low"), width), F.lit(0.0))).drop("_low", "_high")
