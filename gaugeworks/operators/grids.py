"""Experiment grids with inherited settings, resumable from a registry, and the decision over their paired results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inherited(parent: Column, own: Column) -> Column:
    """``parent``'s settings (a map), overridden by ``own``."""
    return F.map_concat(F.map_filter(parent, lambda k, _: ~F.map_contains_key(own, k)), own)


def digest(settings: Column, length: int = 12) -> Column:
    """A short digest of settings that does not depend on their order."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return F.left(F.sha2(text, 256), F.lit(length))


def held(settings: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(settings.items()) for x in pair))


def sweep(axes: DataFrame, axis: str, value: str, categories: DataFrame, category: str, base: Mapping[str, str], seeds: Sequence[int], allowed: str = "true") -> DataFrame:
    """The runs of a sweep around ``base``, one setting at a time: (group, category, seed, variant, settings, digest).

    ``axes`` lists the values to try of each setting. The base itself runs with every seed (group "reference"), each other value
    with the first one ("sweep"). ``allowed`` is a condition on settings; what it does not allow is not planned. The
    digest covers all settings that a run inherits, its category and its seed."""
    base_map = held(base)
    other = axes.select(F.col(axis).alias("_a"), F.col(value).cast("string").alias("_v")).distinct().where(~F.col("_v").eqNullSafe(F.element_at(base_map, F.col("_a"))))
    swept = other.select(F.lit("sweep").alias("group"), F.concat_ws("=", "_a", "_v").alias("variant"), inherited(base_map, F.create_map("_a", "_v")).alias("settings"), F.lit(seeds[0]).alias("seed"))
    one = axes.sparkSession.range(1).select(F.lit("reference").alias("group"), F.lit("base").alias("variant"), base_map.alias("settings"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    every = one.unionByName(swept).where(F.expr(allowed))
    runs = categories.select(F.col(category).cast("string").alias("category")).distinct().crossJoin(F.broadcast(every))  # a grid; settings are a parameter
    whole = F.map_concat("settings", F.create_map(F.lit("category"), F.col("category"), F.lit("seed"), F.col("seed").cast("string")))
    return runs.select("group", "category", "seed", "variant", "settings", digest(whole).alias("digest"))


def unfinished(runs: DataFrame, completed: DataFrame) -> DataFrame:
    """The runs whose digest the registry does not hold."""
    return runs.join(completed.select("digest").distinct(), "digest", "left_anti")


def decided(paired: DataFrame, variant: str, overlap: str, difference: str, significant: str, cost: str, budget: float, least: int = 2, loss: float = 0.01) -> DataFrame:
    """The pre-registered rule for each variant over its categories' paired results against the base.

    "adopted": the overlap improves on ``least`` categories or more and falls by no more than ``loss`` on any, the difference of
    AUROCs is significantly positive on ``least`` or more and significantly negative on none, and the largest cost is below
    ``budget``; "accuracy only" if the cost alone fails; else "not adopted"."""
    gain, sure = F.col(difference), F.col(significant)
    own = paired.groupBy(variant).agg(
        F.count("*").alias("categories"),
        F.count_if(F.col(overlap) > 0).alias("improved"),
        F.min(overlap).alias("worst"),
        F.count_if(sure & (gain > 0)).alias("better"),
        F.count_if(sure & (gain < 0)).alias("worse"),
        F.max(cost).alias("cost"),
    )
    accurate = (F.col("improved") >= least) & (F.col("worst") >= -loss) & (F.col("better") >= least) & (F.col("worse") == 0)
    verdict = F.when(~F.coalesce(accurate, F.lit(False)), "not adopted").when(F.coalesce(F.col("cost") < budget, F.lit(False)), "adopted").otherwise("accuracy only")
    return own.withColumn("verdict", verdict)
