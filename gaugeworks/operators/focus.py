"""Scores within an object's region for many margins at once.

The squared distance of every cell to the object is worked out once a map; a margin is a level set of it, so the regions of
all margins are nested and each cell needs only the number of the first margin that reaches it (its ring). Scores, sizes and
coverage for every margin are then expressions over that one small array: no mask a margin, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.functions.columns import top_fraction_mean
from gaugeworks.operators.photometric import background, distance
from gaugeworks.operators.rasters import on_maps

#: Margins as shares of a map's diagonal.
MARGINS = (0.01, 0.03, 0.06)


def radii(margins: Sequence[float], height: int, width: int) -> list[int]:
    """Margins in cells, one at least."""
    if list(margins) != sorted(margins) or not margins:
        raise ValueError("margins ascend")
    return [max(1, round(m * float(np.hypot(height, width)))) for m in margins]


def rings(margins: Sequence[float]) -> Callable[..., Column]:
    """From (object mask, height, width): for each cell the first margin that holds it, their number where none does. A map
    without an object is restricted nowhere: all its cells are in the first ring."""

    def of(a: np.ndarray) -> np.ndarray:
        m = a.astype(bool)
        if not m.any():
            return np.zeros(m.shape, np.int32)
        d = K.squared_distance(m)
        return sum((d > r * r).astype(np.int32) for r in radii(margins, *m.shape))

    return on_maps(of, "array<int>")


def within(values: Column, ring: Column, margin: int) -> Column:
    """The values of the cells in the region of the margin of that number."""
    paired = F.filter(F.arrays_zip(values.alias("v"), ring.alias("r")), lambda x: x["r"] <= margin)
    return F.transform(paired, lambda x: x["v"])


def rules(values: Column, ring: Column, margins: Sequence[float], share: float = 0.05) -> dict[str, Column]:
    """Scores of a map by name: maximum and mean of the top ``share`` over the whole map and within each margin."""
    out = {"max": F.array_max(values), "top": top_fraction_mean(values, share)}
    for k, m in enumerate(margins):
        inside = within(values, ring, k)
        out |= {f"roi {m:g} max": F.array_max(inside), f"roi {m:g} top": top_fraction_mean(inside, share)}
    return out


def margin_scores(df: DataFrame, id: str, values: str, ring: str, margins: Sequence[float], share: float = 0.05, keep: Sequence[str] = ()) -> DataFrame:
    """(id, margin, cells, high, top) for every margin."""
    each = []
    for k, m in enumerate(margins):
        inside = within(F.col(values), F.col(ring), k)
        each.append(F.struct(F.lit(float(m)).alias("margin"), F.size(inside).alias("cells"), F.array_max(inside).alias("high"), top_fraction_mean(inside, share).alias("top")))
    return df.select(id, *keep, F.explode(F.array(*each)).alias("x")).select(id, *keep, "x.*")


def border_cells(cells: DataFrame, pos: str, height: int, width: int, band: float = 0.05) -> DataFrame:
    """Cells in a band along the edges, a share of the map's shorter side wide and one cell at least."""
    b = max(1, round(band * min(height, width)))
    row, col = F.floor(F.col(pos) / width), F.col(pos) % width
    return cells.where((row < b) | (row >= height - b) | (col < b) | (col >= width - b))


def foreground(cells: DataFrame, normals: DataFrame, channels: tuple[str, ...], pos: str, height: int, width: int, band: float = 0.05, **fit) -> DataFrame:
    """``cells`` with fore: whether a cell lies outside the background fitted on the borders of ``normals``."""
    mean, inverse, cut = background(border_cells(normals, pos, height, width, band), channels, **fit)
    return cells.withColumn("fore", distance(channels, mean, inverse) > cut)


def assumption_checks(df: DataFrame, label: str, split: str, ring: str, truth: str, border: str, margins: Sequence[float]) -> DataFrame:
    """For each margin: the region's median share of a map in validation and test; of the anomalous maps with marked cells, the
    median share of these inside the region, how many maps have 99.9 % of them there, and their number. With every row, median
    and maximum of ``border``, the share of border cells taken for an object on normal maps. Nothing is chosen by these."""
    marked = within(F.col(ring), F.transform(truth, lambda t: (~t).cast("int")), 0)  # rings of the marked cells
    each = []
    for k, m in enumerate(margins):
        inside = F.size(within(marked, marked, k))
        part = F.size(within(F.col(ring), F.col(ring), k)) / F.size(ring)
        each.append(F.struct(F.lit(float(m)).alias("margin"), part.alias("part"), F.when(F.size(marked) > 0, inside / F.size(marked)).alias("covered")))
    own = df.select(label, split, border, F.explode(F.array(*each)).alias("x")).select(F.col(label).alias("_y"), F.col(split).alias("_s"), F.col(border).alias("_b"), "x.*")
    hit = F.when(F.col("_y") == 1, F.col("covered"))
    edge = F.when(F.col("_y") == 0, F.col("_b"))
    return own.groupBy("margin").agg(
        *(F.median(F.when(F.col("_s") == s, F.col("part"))).alias(f"region_{s}") for s in ("validation", "test")),
        F.median(hit).alias("inside_median"),
        F.avg((hit >= 0.999).cast("double")).alias("fully_inside"),
        F.count(hit).alias("n_marked"),
        F.median(edge).alias("border_median"),
        F.max(edge).alias("border_max"),
    )
