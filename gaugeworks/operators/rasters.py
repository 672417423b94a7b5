"""Operators on maps and masks held as flat row-major arrays. Kernels run per row through Arrow; nothing is shuffled
but what an aggregate needs."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.operators.ranking import areas_to_limits, running


def on_maps(f: Callable[[np.ndarray], np.ndarray], returns: str = "array<double>") -> Callable[..., Column]:
    """A column function from (map, height, width) that applies ``f`` to each 2-D array."""

    @F.pandas_udf(returns)
    def run(m: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(f(np.asarray(x, np.float64).reshape(a, b))).ravel().tolist() for x, a, b in zip(m, h, w, strict=True)])

    return run


def smooth(sigma: float, places: int | None = None) -> Callable[..., Column]:
    """Blurred maps, on request to ``places`` decimals with the sign of a zero kept, which Spark's own rounding drops."""
    return on_maps(lambda a: K.gaussian(a, sigma) if places is None else K.half_away(K.gaussian(a, sigma), places))


def smoothed_by() -> Callable[..., Column]:
    """:func:`smooth` with its width from a column, after map, height and width."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series, h: pd.Series, w: pd.Series, sigma: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else K.gaussian(np.asarray(x, np.float64).reshape(a, b), s).ravel().tolist() for x, a, b, s in zip(m, h, w, sigma, strict=True)])

    return run


def upsample(height: int, width: int) -> Callable[..., Column]:
    return on_maps(lambda a: K.bilinear(a, height, width))


def postprocess(height: int, width: int, native_height: int, native_width: int, sigma: float) -> Callable[..., Column]:
    """Raw map to input size, blur, native size."""
    return on_maps(lambda a: K.bilinear(K.gaussian(K.bilinear(a, height, width), sigma), native_height, native_width))


def perturbed(name: str, severity: int, seed: int = 0) -> Callable[..., Column]:
    """A seeded perturbation; the seed mixes a stable digest of the name."""
    return on_maps(lambda a: K.perturb(a, name, severity, np.random.default_rng([seed, zlib.crc32(name.encode()), severity])))


def perturbed_by(seed: int = 0) -> Callable[..., Column]:
    """:func:`perturbed` with name and severity from columns, after map, height and width."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series, h: pd.Series, w: pd.Series, name: pd.Series, severity: pd.Series) -> pd.Series:
        each = zip(m, h, w, name, severity, strict=True)
        return pd.Series([None if x is None else K.perturb(np.asarray(x, np.float64).reshape(a, b), k, s, np.random.default_rng([seed, zlib.crc32(k.encode()), s])).ravel().tolist() for x, a, b, k, s in each])

    return run


def mask_rule(low: float, high: float | None = None, closing: int = 0, angles: int = 4, fill: bool = True, erosion: int = 0, least: int = 1, mark: bool = False) -> Callable[..., Column]:
    """Threshold, oriented closing, hysteresis, filled holes, erosion, small regions dropped; with ``mark`` an
    empty result gets its highest cell."""

    def rule(a: np.ndarray) -> np.ndarray:
        m = a > low if high is None else K.hysteresis(a, low, high)
        m = K.oriented_closing(m, closing, angles)
        m = K.fill_holes(m) if fill else m
        m = K.erode(m, K.ellipse(erosion)) if erosion else m
        m = K.remove_small(m, least) if least > 1 else m
        if mark and not m.any():
            m = m.copy()
            m.flat[int(a.argmax())] = True
        return m

    return on_maps(rule, "array<boolean>")


REGION = "array<struct<region:int,area:int,top:int,left:int,bottom:int,right:int,cells:array<int>>>"


def _regions(m: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    out = []
    for x, a, b in zip(m, h, w, strict=True):
        lab = K.components(np.asarray(x, bool).reshape(a, b))
        rows = []
        for name in np.unique(lab[lab >= 0]):
            i, j = np.nonzero(lab == name)
            rows.append({"region": int(name), "area": len(i), "top": int(i.min()), "left": int(j.min()), "bottom": int(i.max()) + 1, "right": int(j.max()) + 1, "cells": (i * b + j).tolist()})
        out.append(rows)
    return pd.Series(out)


def regions(masks: DataFrame, id: str, mask: str, height: int, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """8-connected regions of every mask: (id, region, area, box, cells); a region's name is its least position."""
    own = masks.select(id, *keep, F.explode(F.pandas_udf(_regions, REGION)(F.col(mask), F.lit(height), F.lit(width))).alias("r"))
    return own.select(id, *keep, "r.*")


MEASURED = "array<struct<region:int,area:int,height:int,width:int,diameter:double,contrast:double>>"
#: Distance in cells (along rows and columns) to which the ring around a region reaches.
RING = 4


def measured(maps: DataFrame, id: str, mask: str, values: str, height: int, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The regions of every mask with area, extents, diameter of the disc of that area, and local contrast: the
    absolute difference of the means inside and on the ring around it, outside the mask; NULL without a ring."""
    near = np.add.outer(np.abs(np.arange(-RING, RING + 1)), np.abs(np.arange(-RING, RING + 1))) <= RING

    @F.pandas_udf(MEASURED)
    def run(mask: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for m, v in zip(mask, values, strict=True):
            m, v = np.asarray(m, bool).reshape(height, width), np.asarray(v, np.float64).reshape(height, width)
            lab, rows = K.components(m), []
            for name in np.unique(lab[lab >= 0]):
                inside = lab == name
                i, j = np.nonzero(inside)
                ring = K.dilate(inside, near) & ~m
                contrast = float(abs(v[inside].mean() - v[ring].mean())) if ring.any() else None
                rows.append({"region": int(name), "area": len(i), "height": int(np.ptp(i)) + 1, "width": int(np.ptp(j)) + 1, "diameter": 2.0 * float(np.sqrt(len(i) / np.pi)), "contrast": contrast})
            out.append(rows)
        return pd.Series(out)

    return maps.select(id, *keep, F.explode(run(F.col(mask), F.col(values))).alias("r")).select(id, *keep, "r.*")


def region_summary(regions: DataFrame, id: str, cells: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and low percentiles of the sizes of :func:`measured` regions of maps of ``cells`` cells."""
    area, fraction, extent = F.col("area").cast("double"), F.col("area") / F.lit(float(cells)), F.least("height", "width").cast("double")
    columns = {"area_px": (area, (1, 5, 50)), "area_fraction": (fraction, (1, 5, 50)), "diameter_px": (F.col("diameter"), (1, 5, 50)), "min_extent": (extent, (1, 50)), "local_contrast": (F.col("contrast"), (5, 50))}
    named = [F.percentile(c, F.lit(x / 100.0)).alias(f"{n}_median" if x == 50 else f"{n}_p{x}") for n, (c, xs) in columns.items() for x in xs]
    images = F.count_distinct(id)
    return regions.groupBy(*by).agg(F.count("*").alias("n_regions"), images.alias("n_images"), (F.count("*") / images).alias("regions_per_image"), F.max(area).alias("area_px_max"), F.max(fraction).alias("area_fraction_max"), *named)


def pro_points(cells: DataFrame, found: DataFrame, id: str, value: str = "value") -> DataFrame:
    """(threshold, fpr, pro) at every distinct value. Regions weigh alike: a cell counts 1 / (its
    region's area x regions), so the overlap curve is one weighted running sum."""
    n = found.agg(F.count("*").alias("_n"))
    parts = found.crossJoin(F.broadcast(n)).select(id, F.explode("cells").alias("pos"), (1.0 / (F.col("area") * F.col("_n"))).alias("w"))
    own = cells.join(parts, [id, "pos"], "left").groupBy(F.col(value).alias("threshold")).agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("pro"), F.count_if(F.col("w").isNull()).alias("neg"))
    total = own.agg(F.sum("neg").alias("_t"))
    out = running(own, "threshold", ["pro", "neg"], descending=True).crossJoin(F.broadcast(total))
    return out.select("threshold", F.try_divide(F.col("cum_neg").cast("double"), F.col("_t").cast("double")).alias("fpr"), F.col("cum_pro").alias("pro"))


def au_pro(cells: DataFrame, found: DataFrame, id: str, limits: tuple[float, ...] = (0.3,), value: str = "value") -> DataFrame:
    """Normalised area under the overlap curve up to each limit of FPR, from one sweep."""
    points = pro_points(cells, found, id, value).groupBy("fpr").agg(F.max("pro").alias("pro"))
    return areas_to_limits(points, "fpr", "pro", limits).select("fpr_limit", F.col("area").alias("au_pro"))


def fuse(a: Column, b: Column, mode: str = "mean") -> Column:
    """Cellwise mean or maximum of two maps."""
    return F.zip_with(a, b, (lambda x, y: F.greatest(x, y)) if mode == "max" else (lambda x, y: (x + y) / 2.0))


def percentile_of(values: Column, q: float) -> Column:
    """Linear-interpolated percentile of an array."""
    s = F.sort_array(values)
    at = (F.size(values) - 1) * F.lit(q / 100.0)
    low = F.floor(at).cast("int")
    return F.get(s, low) + (at - low) * (F.get(s, F.least(low + 1, F.size(values) - 1)) - F.get(s, low))


def tile_windows(length: Column, tile: int, overlap: int) -> Column:
    """Windows of ``tile`` cells over an axis, as structs (start, stop, own_from, own_to): evenly spread from 0 to ``length``, as few
    as let neighbours share twice the ``overlap``; of what two share, each owns the half on its side. An axis of no more than a
    tile and two overlaps is one window."""
    if tile <= 2 * overlap:
        raise ValueError("a tile must be longer than both its overlaps")
    gaps = F.ceil((length - tile) / (tile - 2 * overlap)).cast("int")
    start = lambda k: F.bround(k * (length - tile) / gaps).cast("int")
    middle = lambda k: F.floor((start(k) + tile + start(k + 1)) / 2).cast("int")

    def window(k: Column) -> Column:
        return F.struct(start(k).alias("start"), (start(k) + tile).alias("stop"), F.when(k == 0, 0).otherwise(middle(k - 1)).alias("own_from"), F.when(k == gaps, length.cast("int")).otherwise(middle(k)).alias("own_to"))

    whole, none = length.cast("int"), F.lit(0)
    one = F.array(F.struct(none.alias("start"), whole.alias("stop"), none.alias("own_from"), whole.alias("own_to")))
    return F.when(length <= tile + 2 * overlap, one).otherwise(F.transform(F.sequence(none, gaps), window))
