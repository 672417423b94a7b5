"""Intensity operators on maps: normalisations, light changes, split statistics, a background model and its masks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.functions.columns import mean_of
from gaugeworks.operators.injections import stream
from gaugeworks.operators.rasters import on_maps

#: Channel means and deviations of the usual photographic statistics, red, green, blue.
CHANNEL_MEAN, CHANNEL_SD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalized(values: Column, mode: str, mean: float = CHANNEL_MEAN[1], sd: float = CHANNEL_SD[1], field: Column | None = None) -> Column:
    """One channel (values from 0 to 1) under a normalisation: none, unit, fixed statistics ("fixed"), mean luminance
    scaled to the fixed mean first ("gain"), own statistics ("standardize"), or divided by its light ``field`` first ("flatfield")."""
    fixed = lambda v: F.transform(v, lambda x: (x - mean) / sd)
    if mode in ("none", "unit"):
        return values
    if mode == "fixed":
        return fixed(values)
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  worked out once a map, not once a cell
    if mode == "gain":
        return fixed(bound(F.lit(mean) / F.greatest(mean_of(values), F.lit(1e-3)), lambda k: F.transform(values, lambda x: x * k)))
    if mode == "standardize":
        square = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / F.size(values)
        moments = F.struct(mean_of(values).alias("mu"), square.alias("sq"))
        spread = lambda m: F.greatest(F.sqrt(F.greatest(m["sq"] - m["mu"] * m["mu"], F.lit(0.0))), F.lit(1e-3))
        return bound(moments, lambda m: bound(F.struct(m["mu"].alias("mu"), spread(m).alias("sd")), lambda k: F.transform(values, lambda x: (x - k["mu"]) / k["sd"])))
    if mode == "flatfield" and field is not None:
        return fixed(F.zip_with(values, field, lambda x, f: x / F.greatest(f, F.lit(0.05)) * mean))
    raise ValueError(f"unknown normalisation {mode}, or no light field")


def light_field(sigma_fraction: float = 0.1) -> Callable[..., Column]:
    """The smooth light of a map: blurred by a share of its long side."""
    return on_maps(lambda a: K.gaussian(a, sigma_fraction * max(a.shape)))


def relit(seed: int, slope: float = 0.4, spot: float = 0.3, gains: tuple[float, float] = (0.6, 1.2), reach: tuple[float, float] = (0.15, 0.4)) -> Callable[..., Column]:
    """A seeded change of light from (map, height, width, id), values kept between 0 and 1: brightness changes by up to ``slope``
    from end to end of a random direction and by up to ``spot`` around a random cell (half as much at a distance of ``reach`` of
    the longer side), and all of it is scaled by one of ``gains``."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series, h: pd.Series, w: pd.Series, i: pd.Series) -> pd.Series:
        out = []
        for x, rows, cols, key in zip(m, h, w, i, strict=True):
            rng = stream(seed, int(key), 2)
            image = np.asarray(x, float).reshape(rows, cols)
            at = np.stack(np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij"))
            way = rng.normal(size=2)
            along = np.tensordot(way, at, 1)
            along = (along - along.min()) / max(np.ptp(along), 1e-9) - 0.5
            centre = rng.integers([rows, cols])
            off = np.sqrt(((at - centre[:, None, None]) ** 2).sum(0)) / (rng.uniform(*reach) * max(rows, cols))
            light = (1 + rng.uniform(-slope, slope) * along) * (1 + rng.uniform(-spot, spot) / (1 + off**2))
            out.append(np.clip(image * light * rng.uniform(*gains), 0, 1).ravel().tolist())
        return pd.Series(out)

    return run


def exposed(values: Column, stops: float) -> Column:
    """A global change of exposure with the matching gamma."""
    gain, gamma = 2.0**stops, 1.0 / (1.0 + 0.15 * stops)
    return F.transform(values, lambda x: F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x * gain)), F.lit(gamma)))


def split_statistics(df: DataFrame, values: str, by: tuple[str, ...], most_cells: int = 20_000) -> DataFrame:
    """Images, mean, deviation and outer percentiles of the cells of each group, and the spread of the images' means.
    Of an image with more than ``most_cells`` cells every n-th one is read, evenly over the whole."""
    step = F.greatest(F.lit(1), F.floor(F.size(values) / most_cells)).cast("int")
    each = df.select(*by, mean_of(F.col(values)).alias("_mean"), F.filter(values, lambda x, i: i % step == 0).alias("_v"))
    images = each.groupBy(*by).agg(F.count("*").alias("n_images"), F.min("_mean").alias("least_mean"), F.max("_mean").alias("greatest_mean"))
    p = lambda q: F.percentile("x", F.lit(q))
    cells = each.select(*by, F.explode("_v").alias("x")).groupBy(*by).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), p(0.01).alias("p1"), p(0.99).alias("p99"))
    return images.join(cells, list(by))


def background(samples: DataFrame, channels: tuple[str, ...], trim: float = 0.05, quantile: float = 0.995, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """A trimmed Gaussian of background colours: mean, inverse covariance, and the quantile of squared Mahalanobis
    distances that separates background from object. Moments come from aggregates, twice: the share ``trim`` of
    the farthest samples is left out of the second. ``ridge`` is added to the diagonal of the sample covariance."""

    def moments(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        k = range(len(channels))
        pairs = {f"c{i}_{j}": F.covar_samp(channels[i], channels[j]) for i in k for j in k if i <= j}
        r = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(channels)), *(c.alias(n) for n, c in pairs.items())).first()
        cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in k] for i in k], float)
        return np.array([r[f"m{i}"] for i in k]), np.linalg.inv(cov + ridge * np.eye(len(channels)))

    mean, inverse = moments(samples)
    far = samples.select(*channels, distance(channels, mean, inverse).alias("_d")).persist()
    cut = far.agg(F.percentile("_d", F.lit(1 - trim))).first()[0]
    mean, inverse = moments(far.where(F.col("_d") <= cut))
    return mean, inverse, float(samples.select(distance(channels, mean, inverse).alias("d")).agg(F.percentile("d", F.lit(quantile))).first()[0])


def distance(channels: tuple[str, ...], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """Squared Mahalanobis distance, as one expression over the channels."""
    off = [F.col(c) - float(m) for c, m in zip(channels, mean, strict=True)]
    out = F.lit(0.0)
    for i, a in enumerate(off):
        for j, b in enumerate(off):
            out = out + a * b * float(inverse[i, j])
    return out


def object_mask(relative_area: float = 0.1, margin: int = 1) -> Callable[..., Column]:
    """From (foreground, height, width): opened, components under a share of the largest dropped, holes filled, widened by
    ``margin``; never empty, as an empty result becomes the whole map."""

    def clean(a: np.ndarray) -> np.ndarray:
        m = a.astype(bool)
        m = K.dilate(K.erode(m, K.ellipse(1)), K.ellipse(1))
        lab = K.components(m)
        sizes = np.unique(lab[lab >= 0], return_counts=True)[1]
        if len(sizes):
            m = K.remove_small(m, max(1, int(np.ceil(relative_area * sizes.max()))))
        m = K.dilate(K.fill_holes(m), K.ellipse(margin)) if margin else K.fill_holes(m)
        return m if m.any() else np.ones_like(m)

    return on_maps(clean, "array<boolean>")


def on_grid(height: int, width: int) -> Callable[..., Column]:
    """A mask on a coarser grid: cells of which half or more is covered; never empty."""

    def shrink(a: np.ndarray) -> np.ndarray:
        m = K.area_mean(a.astype(float), height, width) >= 0.5
        return m if m.any() else np.ones_like(m)

    return on_maps(shrink, "array<boolean>")
