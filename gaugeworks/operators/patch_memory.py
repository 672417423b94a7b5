"""A memory of patches: neighbourhoods of cells, a bounded bank chosen by distributed k-centre, distances to it.

The greedy choice (always the row farthest from those chosen) runs within parts of bounded size and again over what the parts
chose, until one part is left. A choice from one part leaves no row of it farther from the bank than twice the least radius
that any bank of its size has over the whole, so after t rounds none lies farther than 2 t times that. Every row is looked at,
and no task and no driver holds more than a part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import seeded
from gaugeworks.session import cut

#: Rows of a part.
PART = 20_000


def neighbourhoods(values: Column, height: int, width: int, size: int = 3) -> Column:
    """For each cell of a row-major map the ``size`` x ``size`` cells around it, edges held."""
    r = size // 2
    row, col = lambda p: F.floor(p / width).cast("int"), lambda p: p % width
    held = lambda x, n: F.greatest(F.lit(0), F.least(x, F.lit(n - 1)))

    def around(p: Column) -> Column:
        return F.array(*(F.get(values, held(row(p) + i, height) * width + held(col(p) + j, width)) for i in range(-r, r + 1) for j in range(-r, r + 1)))

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), around)


def patches(maps: DataFrame, id: str, values: str, height: int, width: int, size: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """(id, patch, v): a row for each cell and its neighbourhood."""
    own = maps.select(id, *keep, F.posexplode(neighbourhoods(F.col(values), height, width, size)).alias("patch", "v"))
    return own.where("v IS NOT NULL")


def greedy(x: np.ndarray, n: int) -> list[int]:
    """The first row, then ever the row farthest from those chosen (the first of equals), while any lies apart."""
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)):
        k = int(far.argmax())
        if far[k] <= 0:
            break
        chosen.append(k)
        far = np.minimum(far, ((x - x[k]) ** 2).sum(axis=1))
    return chosen


def k_centre(df: DataFrame, key: Sequence[str], vector: str, n: int, part: int = PART, seed: int | str = 0) -> DataFrame:
    """At most ``n`` rows (key, vector, pick) of different vectors that cover ``df``; pick 0 is the first in seeded order of the
    last part."""
    part = max(part, 4 * n)
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in key))
    own = df.select(*key, F.col(vector).cast("array<double>").alias(vector), seeded(seed, name).alias("_s")).where(F.col(vector).isNotNull())
    schema = f"{', '.join(f'{k} {df.schema[k].dataType.simpleString()}' for k in key)}, {vector} array<double>, _s string, pick int"

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_s").reset_index(drop=True)
        at = greedy(np.array(t[vector].tolist(), np.float64), n)
        return t.iloc[at].drop(columns="_p").assign(pick=np.arange(len(at), dtype=np.int32))[[*key, vector, "_s", "pick"]]

    while True:
        parts = max(1, math.ceil(own.count() / part))
        dealt = F.pmod(F.conv(F.substring("_s", 1, 8), 16, 10).cast("long"), F.lit(parts))
        chosen = cut(own.withColumn("_p", dealt).groupBy("_p").applyInPandas(choose, schema))
        if parts == 1:
            return chosen.drop("_s")
        own = chosen.drop("pick")


def nearest(rows: DataFrame, bank: DataFrame, vector: str) -> DataFrame:
    """``rows`` with distance and pick of the nearest of the bank's rows, which are bounded by the choice of their number."""
    held = bank.orderBy("pick").select("pick", vector).collect()
    names, memory = np.array([r.pick for r in held]), np.array([r[vector] for r in held], np.float64)

    @F.pandas_udf("struct<distance:double,pick:int>")
    def near(v: pd.Series) -> pd.DataFrame:
        x = np.array(v.tolist(), np.float64)
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for k, m in enumerate(memory):
            d = ((x - m) ** 2).sum(axis=1)
            at = np.where(d < best, k, at)
            best = np.minimum(best, d)
        return pd.DataFrame({"distance": np.sqrt(best), "pick": names[at].astype(np.int32)})

    return rows.withColumn("_n", near(vector)).select(*rows.columns, "_n.*")


def scores(near: DataFrame, id: str) -> DataFrame:
    """(id, score, patch): the distance of each map's farthest patch, the first of equals."""
    top = near.groupBy(id).agg(F.max(F.struct("distance", (-F.col("patch")).alias("p"))).alias("_t"))
    return top.select(id, F.col("_t.distance").alias("score"), (-F.col("_t.p")).alias("patch"))
