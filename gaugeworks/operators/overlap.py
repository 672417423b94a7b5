"""Overlap curves from mergeable states with a bounded sample of negative cells, and their bootstrap as matrix products.

A state is a table: region cells folded by value (a cell adds 1 / its region's area), a seeded sample of the negative cells,
and the counts of both. The sample is the ``size`` negatives of least hash of (seed, map, cell), so the sample of a union
is the least of the union of the samples: states merge in any order and for any partitioning alike, and with no more than
``size`` negatives the curve is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.ranking import areas_to_limits, running

#: Negative cells that a state holds at most.
SAMPLE = 2_000_000
_SPAN = 1 << 60


def priority(seed: int | str, id: Column, pos: Column) -> Column:
    """A seeded number below 2**60 for each cell, alike in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), id.cast("string"), pos.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def least(df: DataFrame, order: str, k: int) -> DataFrame:
    """The ``k`` rows of least ``order``, a number spread evenly below 2**60; equal ones go by value. Only rows below a generous
    bound are looked at, and only those of the last of 4,096 ranges are ranked."""
    n = df.count()
    if n <= k:
        return df
    cut = min(_SPAN, int(_SPAN * (k + 6.0 * math.sqrt(k) + 20.0) / n))
    few = df.where(F.col(order) < cut)
    if few.count() < k:
        few, cut = df, _SPAN
    part = F.floor(F.col(order) / F.lit(cut / 4096.0))
    below, edge = 0, None
    for r in few.groupBy(part.alias("p")).count().orderBy("p").collect():  # 4,096 rows at most
        edge = r.p
        if below + r["count"] >= k:
            break
        below += r["count"]
    rank = F.row_number().over(Window.orderBy(order, "value"))
    last = few.where(part == edge).withColumn("_r", rank).where(F.col("_r") <= k - below).drop("_r")
    return few.where(part < edge).unionAll(last)


def state(cells: DataFrame, found: DataFrame, id: str, value: str = "value", size: int = SAMPLE, seed: int | str = 0) -> DataFrame:
    """The state of some maps: ``cells`` (id, pos, value), and their regions (id, region, area, cells)."""
    parts = found.select(id, F.explode("cells").alias("pos"), (F.lit(1.0) / F.col("area")).alias("part"))
    own = cells.select(id, "pos", F.col(value).cast("double").alias("value")).join(parts, [id, "pos"], "left")
    inside = own.where("part IS NOT NULL").groupBy("value").agg(F.sum("part").alias("part"))
    outside = own.where("part IS NULL").select(priority(seed, F.col(id), F.col("pos")).alias("priority"), "value")
    return _table(inside, outside, found.count(), outside.count(), size)


def _table(inside: DataFrame, outside: DataFrame, regions: int, negatives: int, size: int) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    rows = inside.select(F.lit("region").alias("kind"), "value", "part", none("long").alias("priority"), none("long").alias("n"))
    rows = rows.unionAll(least(outside, "priority", size).select(F.lit("negative"), "value", none("double"), "priority", none("long")))
    counts = inside.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit("regions").alias("kind"), F.lit(regions).cast("long").alias("n")), F.struct(F.lit("negatives").alias("kind"), F.lit(negatives).cast("long").alias("n")))).alias("x"))
    return rows.unionAll(counts.select("x.kind", none("double"), none("double"), none("long"), "x.n"))


def merged(states: Sequence[DataFrame], size: int = SAMPLE) -> DataFrame:
    """The state of all maps of ``states``, which share no map and one seed."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionAll(s)
    counts = {r.kind: r.n for r in rows.where("n IS NOT NULL").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    inside = rows.where("kind = 'region'").groupBy("value").agg(F.sum("part").alias("part"))
    return _table(inside, rows.where("kind = 'negative'").select("priority", "value"), counts["regions"], counts["negatives"], size)


def areas(held: DataFrame, limits: Sequence[float]) -> DataFrame:
    """fpr_limit, au_pro, n_regions, n_negatives, sampled and fpr_error: the standard error of the sampled FPR at the limit, 0
    where all negatives are held. No row without regions or negatives."""
    counts = {r.kind: r.n for r in held.where("n IS NOT NULL").collect()}
    sampled = held.where("kind = 'negative'").count()
    if not counts["regions"] or not sampled:
        raise ValueError("an overlap curve needs regions and negative cells")
    own = held.where("n IS NULL").groupBy(F.col("value").alias("threshold")).agg(F.sum(F.coalesce("part", F.lit(0.0))).alias("pro"), F.count_if(F.col("kind") == "negative").alias("neg"))
    points = running(own, "threshold", ["pro", "neg"], descending=True)
    points = points.groupBy((F.col("cum_neg").cast("double") / F.lit(float(sampled))).alias("fpr")).agg((F.max("cum_pro") / F.lit(float(counts["regions"]))).alias("pro"))
    out = areas_to_limits(points, "fpr", "pro", limits).withColumnRenamed("area", "au_pro")
    left = 1.0 - sampled / counts["negatives"]
    error = F.sqrt(F.col("fpr_limit") * (1 - F.col("fpr_limit")) / F.lit(float(sampled)) * F.lit(left))
    return out.select("fpr_limit", "au_pro", F.lit(counts["regions"]).cast("long").alias("n_regions"), F.lit(counts["negatives"]).cast("long").alias("n_negatives"), F.lit(sampled).cast("long").alias("sampled"), error.alias("fpr_error"))


def tabulated(cells: DataFrame, found: DataFrame, id: str, thresholds: Sequence[float], value: str = "value") -> DataFrame:
    """(id, step, neg, part): negative cells and regions' shares of each map whose value reaches ``step`` of the ascending
    thresholds and not the next; regions and cells in all are the sums over the steps from 0."""
    grid = np.array(sorted(thresholds), float)

    @F.pandas_udf("int")
    def step(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(grid, v.to_numpy(), side="right").astype(np.int32))

    parts = found.select(id, F.explode("cells").alias("pos"), (F.lit(1.0) / F.col("area")).alias("part"))
    own = cells.select(id, "pos", F.col(value).cast("double").alias("v")).join(parts, [id, "pos"], "left")
    return own.groupBy(id, step("v").alias("step")).agg(F.count_if(F.col("part").isNull()).alias("neg"), F.sum(F.coalesce("part", F.lit(0.0))).alias("part"))


def bootstrap(table: DataFrame, weights: DataFrame, id: str, n_steps: int, n_resamples: int, limits: Sequence[float], block: int = 256) -> DataFrame:
    """(resample, fpr_limit, au_pro): overlap areas of all resamples from one tabulation of ``n_steps`` thresholds.

    Maps are dealt into blocks of about ``block``; in each, the weights (resamples x maps) meet the table (maps x thresholds) in
    one matrix product, and the products of the blocks are summed. A resample only changes weights."""
    n_blocks = max(1, math.ceil(table.select(id).distinct().count() / block))
    to = F.pmod(F.xxhash64(id), F.lit(n_blocks)).alias("block")
    left, right = table.select(to, id, "step", "neg", "part"), weights.select(to, id, "resample", "weight")

    def product(t: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([t[id].to_numpy(), w[id].to_numpy()]))
        held = np.zeros((2, len(names), n_steps + 1))
        np.add.at(held[0], (np.searchsorted(names, t[id]), t["step"]), t["neg"])
        np.add.at(held[1], (np.searchsorted(names, t[id]), t["step"]), t["part"])
        times = np.zeros((n_resamples, len(names)))
        np.add.at(times, (w["resample"].to_numpy(), np.searchsorted(names, w[id])), w["weight"])
        reached = held[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # at step s: all that reach it
        both = times @ reached
        r, s = np.divmod(np.arange(n_resamples * (n_steps + 1)), n_steps + 1)
        return pd.DataFrame({"resample": r.astype(np.int32), "step": s.astype(np.int32), "neg": both[0].ravel(), "part": both[1].ravel()})

    parts = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(product, "resample int, step int, neg double, part double")
    summed = parts.groupBy("resample", "step").agg(F.sum("neg").alias("neg"), F.sum("part").alias("part"))
    # step 0 holds everything: all negatives, and as every region's cells share 1, the number of regions
    whole = summed.where("step = 0").select("resample", F.col("neg").alias("all_neg"), F.col("part").alias("all_part"))
    curve = summed.where("step > 0").join(whole, "resample").select("resample", F.try_divide("neg", "all_neg").alias("fpr"), F.try_divide("part", "all_part").alias("pro"))
    points = curve.where("fpr IS NOT NULL AND pro IS NOT NULL").groupBy("resample", "fpr").agg(F.max("pro").alias("pro"))
    return areas_to_limits(points, "fpr", "pro", limits, ("resample",)).withColumnRenamed("area", "au_pro")
