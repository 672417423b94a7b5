"""Pooled aggregates over array-valued maps: histograms, tails, overlap counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.columns import share


def pixels(maps: DataFrame, id: str, values: str, mask: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, pos, value, truth) of every cell; ``mask`` may use _pos, _value and the columns of ``maps``."""
    own = maps.select(id, *keep, F.posexplode(values).alias("_pos", "_value"))
    truth = F.lit(False) if mask is None else mask
    return own.select(id, *keep, F.col("_pos").alias("pos"), F.col("_value").cast("double").alias("value"), truth.alias("truth"))


def histogram(cells: DataFrame, low: float, high: float, bins: int, value: str = "value", truth: str = "truth", by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram with positive and negative counts, values clipped to the range."""
    width = (high - low) / bins
    place = F.floor((F.col(value) - low) / width) if width > 0 else F.lit(0)
    place = F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return cells.groupBy(*by, place.alias("bin")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))


def histogram_auroc(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC of a histogram: ties within a bin count half. At most ``bins`` rows a group are sorted."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    own = bins.select(*by, "pos", "neg", F.coalesce(F.sum("neg").over(w), F.lit(0)).alias("_below"))
    won = F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0))
    return own.groupBy(*by).agg(share(won, F.sum("pos") * F.sum("neg")).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def tail_threshold(bins: DataFrame, rate: float, low: float, high: float, n_bins: int) -> DataFrame:
    """Lower edge of the lowest bin whose upper tail holds at most ``rate`` of all counts."""
    n = F.col("pos") + F.col("neg")
    w = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row for each bin
    own = bins.select("bin", F.sum(n).over(w).alias("_tail"))
    total = bins.agg(F.sum(n).alias("_n"))
    ok = own.crossJoin(F.broadcast(total)).where(F.col("_tail") <= F.lit(rate) * F.col("_n"))
    width = (high - low) / n_bins
    return ok.agg(F.coalesce(F.min(F.lit(low) + F.col("bin") * width), F.lit(float(high))).alias("threshold"))


def overlap(cells: DataFrame, threshold: Column | float, value: str = "value", truth: str = "truth", by: Sequence[str] = ()) -> DataFrame:
    """Pooled cell counts at a threshold with F1, precision, recall and intersection over union."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, y = F.col(value) > t, F.col(truth)
    own = cells.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return own.select("*", zero(share(2 * tp, 2 * tp + fp + fn)).alias("f1"), zero(share(tp, tp + fp)).alias("precision"), zero(share(tp, tp + fn)).alias("recall"), zero(share(tp, tp + fp + fn)).alias("iou"))


def range_of(maps: DataFrame, values: str, by: Sequence[str] = ()) -> DataFrame:
    return maps.groupBy(*by).agg(F.min(F.array_min(values)).alias("low"), F.max(F.array_max(values)).alias("high"))


def location_statistics(cells: DataFrame, value: str = "value", floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation of every position over all maps."""
    return cells.groupBy("pos").agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("sd"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"), F.count("*").alias("n"))


def location_zmax(cells: DataFrame, statistics: DataFrame, id: str, value: str = "value") -> DataFrame:
    """Largest z-score of every map; ``statistics`` has one row for each position of a map."""
    own = cells.join(F.broadcast(statistics.select("pos", "mean", "sd")), "pos")
    return own.groupBy(id).agg(F.max((F.col(value) - F.col("mean")) / F.col("sd")).alias("zmax"))


def leave_one_out_zmax(cells: DataFrame, statistics: DataFrame, id: str, value: str = "value", floor: float = 1e-6) -> DataFrame:
    """As :func:`location_zmax` with each map's own value taken out of its statistics, in closed form."""
    own = cells.join(F.broadcast(statistics), "pos").where(F.col("n") > 1)
    m, v = F.col("n") - 1, F.col(value)
    mean = (F.col("total") - v) / m
    var = F.greatest((F.col("squares") - v * v) / m - mean * mean, F.lit(0.0))
    return own.groupBy(id).agg(F.max((v - mean) / F.greatest(F.sqrt(var), F.lit(floor))).alias("zmax"))
