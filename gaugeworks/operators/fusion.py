"""Fusion of several models' maps on a common scale.

A component's scale comes from its pooled validation cells: one histogram for all components and quantiles, merged by counts.
Fused maps may have the scores on highlights of the image damped, and be referred to their own background level.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.operators.rasters import on_maps, percentile_of

#: Bins of a component's histogram, and the shares of cells above the levels that the scales are made of.
BINS, TAILS = 4_096, (0.01, 0.05, 0.25, 0.5, 0.75)
SCALES, LEVELS = ("p95", "p99", "z"), ("none", "sub-median", "sub-q75", "div-median")


def tail_levels(cells: DataFrame, component: str, value: str, bins: int = BINS) -> DataFrame:
    """(component, q_0.01, ..., q_0.75): for each tail the lowest bin edge that no more than this share of the component's cells
    reach. A component's bins span its own range; ``bins`` rows each are sorted."""
    ends = cells.groupBy(component).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    own = cells.select(component, F.col(value).cast("double").alias("_v")).join(ends, component)
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    held = own.groupBy(component, "_lo", "_hi", place.alias("_b")).agg(F.count("*").alias("_n"))
    above = Window.partitionBy(component).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    tail = held.withColumn("_t", F.sum("_n").over(above) / F.sum("_n").over(Window.partitionBy(component)))
    edge = F.col("_lo") + F.col("_b") * width
    return tail.groupBy(component).agg(*(F.coalesce(F.min(F.when(F.col("_t") <= q, edge)), F.max("_hi")).alias(f"q_{q}") for q in TAILS))


def scales(levels: DataFrame, component: str, kind: str) -> DataFrame:
    """(component, offset, scale): the 95th or 99th percentile, or median and robust deviation ("z")."""
    if kind not in SCALES:
        raise ValueError(f"a scale is one of {SCALES}")
    q = lambda x: F.col(f"`q_{x}`")
    offset, scale = {"p95": (F.lit(0.0), q(0.05)), "p99": (F.lit(0.0), q(0.01)), "z": (q(0.5), F.greatest((q(0.25) - q(0.75)) / 1.349, F.lit(1e-9)))}[kind]
    return levels.select(component, offset.alias("offset"), scale.alias("scale"))


def scaled(values: Column, offset: Column, scale: Column) -> Column:
    return F.transform(values, lambda x: (x - offset) / scale)


def highlights(radius: int = 7, rise: float = 0.15, level: float = 0.8) -> Callable[..., Column]:
    """From (grey image, height, width): bright local peaks, ``rise`` above the opening by a disc and over ``level``, grown by one
    cell. A bright background alone is none."""

    def peaks(a: np.ndarray) -> np.ndarray:
        return K.dilate((a - K.grey_opening(a, K.ellipse(radius)) > rise) & (a > level), np.ones((3, 3), bool))

    return on_maps(peaks, "array<boolean>")


def damped(values: Column, spots: Column, share: float) -> Column:
    return F.zip_with(values, spots, lambda x, s: F.when(s, x * (1.0 - share)).otherwise(x))


def levelled(values: Column, level: str) -> Column:
    """A map referred to its own background."""
    if level not in LEVELS:
        raise ValueError(f"a level is one of {LEVELS}")
    if level == "none":
        return values
    at = F.array(F.greatest(percentile_of(values, 50.0), F.lit(1e-6)) if level == "div-median" else percentile_of(values, 75.0 if level == "sub-q75" else 50.0))
    use = (lambda x, b: x / b) if level == "div-median" else (lambda x, b: x - b)
    return F.flatten(F.transform(at, lambda b: F.transform(values, lambda x: use(x, b))))  # the level once a map


def fused(parts: DataFrame, id: str, component: str, values: str, factors: DataFrame, mode: str = "max", spots: DataFrame | None = None, share: float = 0.0, level: str = "none", components: int | None = None) -> DataFrame:
    """(id, map): the cellwise maximum or mean of an image's scaled maps. An image that lacks one of ``components`` maps stops the
    query; ``spots`` (id, spots) are highlights to damp by ``share``."""
    own = parts.join(F.broadcast(factors), component).select(id, scaled(F.col(values), F.col("offset"), F.col("scale")).alias("_v"))  # a row for each component
    held = own.groupBy(id).agg(F.collect_list("_v").alias("_m"))  # as many maps as components
    if components is not None:
        held = held.withColumn("_m", F.when(F.size("_m") == components, F.col("_m")).otherwise(F.raise_error(F.lit("a component did not score every image")).cast("array<array<double>>")))
    cells = F.transform(F.sequence(F.lit(0), F.size(F.get("_m", F.lit(0))) - 1), lambda p: F.transform("_m", lambda m: F.get(m, p)))
    one = (lambda c: F.array_max(c)) if mode == "max" else (lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c))
    out = held.select(id, F.transform(cells, one).alias("map"))
    if spots is not None and share > 0:
        out = out.join(spots, id).select(id, damped(F.col("map"), F.col("spots"), share).alias("map"))
    return out.select(id, levelled(F.col("map"), level).alias("map"))
