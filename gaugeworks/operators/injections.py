"""Synthetic maps and defects from counter-based random streams.

Every row has a stream of its own, keyed by the seed and the row's id, so a data set is the same for any partitioning and
any part of it can be made again alone. A defect is blended into the map that it is given, and its mask is exactly the
cells that it changed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K

PATTERNS = ("strip", "blob", "grain")
DEFECTS = ("pit", "scratch", "contamination", "bubble", "crack", "chip")


def stream(seed: int, id: int, part: int = 0) -> np.random.Generator:
    """The stream of a row; ``part`` tells its uses apart."""
    return np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, id & (1 << 64) - 1], counter=[0, 0, 0, part]))


def pattern(name: str, height: int, width: int, rng: np.random.Generator) -> np.ndarray:
    """A normal map with values from 0 to 1: a strip lit along its length, a round object, or plain grain."""
    y, x = np.mgrid[:height, :width]
    noise = K.value_noise(height, width, rng)
    if name == "strip":
        band = np.abs(y - (height - 1) / 2) < 0.35 * height
        out = np.where(band, 0.55 + 0.15 * np.sin(2 * math.pi * (x / width + rng.random())), 0.1) + 0.1 * noise
    elif name == "blob":
        r = rng.uniform(0.3, 0.42) * min(height, width)
        far = np.hypot(y - (height - 1) / 2 - rng.normal(0, 0.03 * height), x - (width - 1) / 2 - rng.normal(0, 0.03 * width))
        out = 0.1 + 0.6 / (1 + np.exp((far - r) / 0.7)) + 0.1 * noise
    elif name == "grain":
        out = 0.3 + 0.4 * noise
    else:
        raise ValueError(f"a pattern is one of {PATTERNS}")
    return np.clip(out + rng.normal(0, 0.01, out.shape), 0, 1)


def _segment(y: np.ndarray, x: np.ndarray, a: tuple[float, float], b: tuple[float, float]) -> np.ndarray:
    """Distance of every cell to the line from ``a`` to ``b``."""
    dy, dx = b[0] - a[0], b[1] - a[1]
    t = np.clip(((y - a[0]) * dy + (x - a[1]) * dx) / max(dy * dy + dx * dx, 1e-9), 0, 1)
    return np.hypot(y - a[0] - t * dy, x - a[1] - t * dx)


def defect(image: np.ndarray, kind: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``image`` with a defect of a kind, and the mask of the cells that it changed, of which there is one at least."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w].astype(float)
    at, short = (rng.uniform(0.2, 0.8) * h, rng.uniform(0.2, 0.8) * w), min(h, w)
    far = np.hypot(y - at[0], x - at[1])
    if kind == "pit":  # a dark hollow, deepest in the middle
        share = np.clip(1.2 - far / (rng.uniform(0.08, 0.18) * short), 0, 1)
        new = image - 0.45 * share
    elif kind == "scratch":  # a thin bright line
        turn, length = rng.uniform(0, math.pi), rng.uniform(0.3, 0.7) * max(h, w)
        end = (at[0] + length * math.sin(turn), at[1] + length * math.cos(turn))
        new = image + np.where(_segment(y, x, at, end) < 0.75, 0.35, 0.0)
    elif kind == "contamination":  # a ragged patch of foreign texture
        edge = far / (rng.uniform(0.12, 0.25) * short) + 0.8 * (K.value_noise(h, w, rng) - 0.5)
        new = np.where(edge < 1, 0.5 * image + 0.5 * K.value_noise(h, w, rng), image)
    elif kind == "bubble":  # a bright rim around a faint inside
        r = rng.uniform(0.1, 0.2) * short
        new = image + np.where(np.abs(far - r) < 0.7, 0.3, 0.0) - np.where(far < r - 0.7, 0.08, 0.0)
    elif kind == "crack":  # a dark broken line that turns as it goes
        near, a, turn = np.full(image.shape, np.inf), at, rng.uniform(0, 2 * math.pi)
        for _ in range(5):
            turn += rng.normal(0, 0.6)
            b = (a[0] + 0.12 * max(h, w) * math.sin(turn), a[1] + 0.12 * max(h, w) * math.cos(turn))
            near, a = np.minimum(near, _segment(y, x, a, b)), b
        new = image - np.where(near < 0.6, 0.4, 0.0)
    elif kind == "chip":  # a piece broken off one edge
        side, size = rng.integers(4), rng.uniform(0.15, 0.3) * short
        depth = (y, h - 1 - y, x, w - 1 - x)[side] + 0.6 * np.abs((x - at[1]) if side < 2 else (y - at[0]))
        new = np.where(depth < size, 0.02, image)
    else:
        raise ValueError(f"a defect is one of {DEFECTS}")
    new = np.clip(new, min(0.0, float(image.min())), max(1.0, float(image.max())))
    if (new == image).all():  # nothing left to darken or brighten there
        i, j = int(at[0]), int(at[1])
        new[i, j] = image[i, j] + (0.4 if image[i, j] < 0.5 else -0.4)
    return new, new != image


def patterned(height: int, width: int, seed: int = 0) -> Callable[..., Column]:
    """From (id, pattern name): a normal map of that row."""

    @F.pandas_udf("array<double>")
    def run(i: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([pattern(n, height, width, stream(seed, int(k))).ravel().tolist() for k, n in zip(i, name, strict=True)])

    return run


def injected(height: int, width: int, seed: int = 0) -> Callable[..., Column]:
    """From (id, map, defect kind): struct of the map with the defect and its mask; without a kind the map as it is."""

    @F.pandas_udf("struct<map:array<double>,mask:array<boolean>>")
    def run(i: pd.Series, m: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for k, x, name in zip(i, m, kind, strict=True):
            a = np.asarray(x, np.float64).reshape(height, width)
            new, mask = defect(a, name, stream(seed, int(k), 1)) if name else (a, np.zeros(a.shape, bool))
            out.append((new.ravel().tolist(), mask.ravel().tolist()))
        return pd.DataFrame(out, columns=["map", "mask"])

    return run
