"""Composite analyses: conditions, recalibration, regions by size, gates and resolution choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.columns import share

#: Long sides that are weighed, and the least diameter in cells a region should keep.
CANDIDATES, LEAST_DIAMETER = (320, 448, 640, 960), 4.0


def by_condition(df: DataFrame, label: str, score: str, condition: str, threshold: Column) -> DataFrame:
    """False-alarm rate and recall over all rows and for each condition, by one grouping-sets pass."""
    y, hit = F.col(label) == 1, F.col(score) > threshold
    own = df.select(F.col(condition).alias("_c"), y.alias("_y"), hit.alias("_h"))
    out = own.groupingSets([[], ["_c"]], "_c").agg(F.count("*").alias("n"), F.avg(F.when(~F.col("_y"), F.col("_h").cast("double"))).alias("fpr"), F.avg(F.when(F.col("_y"), F.col("_h").cast("double"))).alias("recall"), F.grouping("_c").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("_c")).alias(condition), "n", "fpr", "recall")


def nested_mean(df: DataFrame, value: str, inner: Sequence[str], outer: Sequence[str] = ()) -> DataFrame:
    """Mean of the inner groups' means, so that large groups do not weigh more."""
    each = df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m"))
    return each.groupBy(*outer).agg(F.avg("_m").alias("macro"), F.count("*").alias("groups"))


def seed_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (NULL for one seed) and number of the finite values."""
    v = F.when(~F.isnan(F.col(value)) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))


def group_runs(runs: DataFrame, seed: str, spec: str) -> DataFrame:
    """Runs grouped by the hash of their settings (a map) without the seed; keys in sorted order."""
    fixed = F.array_sort(F.map_entries(F.map_filter(spec, lambda k, _: k != seed)))
    text = F.array_join(F.transform(fixed, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return runs.withColumn("_h", F.left(F.sha2(text, 256), F.lit(12))).groupBy(F.col("_h").alias("group")).agg(F.array_sort(F.collect_set(F.element_at(spec, seed))).alias("seeds"), F.count("*").alias("n"))


def differing_keys(runs: DataFrame, spec: str) -> DataFrame:
    """Settings that take more than one value."""
    return runs.select(F.explode(spec).alias("key", "value")).groupBy("key").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """An upsert's result: of rows with equal keys the newest stays."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def undone(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of a work list that are not done yet."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def severity_grid(names: DataFrame, name: str, severities: Sequence[int]) -> DataFrame:
    """Every row of ``names`` at every severity."""
    return names.select(name, F.explode(F.array(*map(F.lit, severities))).alias("severity"))


def resolution_impact(regions: DataFrame, width: int, height: int, candidates: Sequence[int] = CANDIDATES, least: float = LEAST_DIAMETER) -> DataFrame:
    """For each candidate long side: median scaled diameter, share of regions under ``least`` cells, a verdict."""
    diameter = 2.0 * F.sqrt(F.col("area") / F.lit(3.141592653589793))
    own = regions.select(diameter.alias("d"), F.explode(F.array(*map(F.lit, candidates))).alias("long_side"))
    scaled = F.col("d") * F.col("long_side") / F.lit(float(max(width, height)))
    out = own.groupBy("long_side").agg(F.median(scaled).alias("median_diameter"), F.avg((scaled < least).cast("double")).alias("lost"))
    verdict = F.when(F.col("lost") > 0.25, "reject").when(F.col("lost") > 0.05, "marginal").otherwise("accept")
    return out.withColumn("verdict", verdict)


def recommend(verdicts: DataFrame) -> DataFrame:
    """The smallest accepted size, else the largest with tiling."""
    ok = F.min(F.when(F.col("verdict") == "accept", F.col("long_side")))
    return verdicts.agg(F.coalesce(ok, F.max("long_side")).alias("long_side"), ok.isNull().alias("tiled"))


def threshold_transfer(counts: DataFrame, rule: str, half: str, category: str, score: str) -> DataFrame:
    """Each category's best rule on one half, with its score on the other; ties by the rule's name."""
    best = counts.groupBy(category, half).agg(F.max(F.struct(F.col(score).alias("s"), F.col(rule).alias("r"))).alias("b")).select(category, half, F.col("b.r").alias(rule), F.col("b.s").alias("chosen_on"))
    other = counts.select(category, (1 - F.col(half)).alias(half), rule, F.col(score).alias("scored_on"))
    return best.join(other, [category, half, rule])


def region_size_study(regions: DataFrame, cells: DataFrame, id: str, negative_rate: float, edges: Sequence[int], overlap: float = 0.3) -> DataFrame:
    """Mean overlap of regions by area at the threshold that ``negative_rate`` of normal cells exceed."""
    cut = cells.where("NOT truth").agg(F.percentile("value", F.lit(1.0 - negative_rate)).alias("t"))
    own = regions.select(id, "region", "area", F.explode("cells").alias("pos")).join(cells.select(id, "pos", "value"), [id, "pos"])
    each = own.crossJoin(F.broadcast(cut)).groupBy(id, "region", "area").agg(F.avg((F.col("value") > F.col("t")).cast("double")).alias("share"))
    size = F.lit(0)
    for e in edges:
        size = size + (F.col("area") >= e).cast("int")
    return each.groupBy(size.alias("size_bin")).agg(F.count("*").alias("n"), F.avg("share").alias("mean_overlap"), F.avg((F.col("share") >= overlap).cast("double")).alias("found"))


def bootstrap_areas(points: DataFrame, weights: DataFrame, id: str) -> DataFrame:
    """Weighted share of cells above each threshold in each resample: tabulated once, only weights change."""
    own = points.join(weights, id)
    return own.groupBy("resample", "threshold").agg(share(F.sum(F.col("weight") * F.col("above")), F.sum(F.col("weight") * F.col("cells"))).alias("share"))


def proxy_gate(df: DataFrame, label: str, score: str, threshold: Column) -> DataFrame:
    """Image F1 at a threshold, the F1 of rejecting everything, and whether the gate passes."""
    y, hit = F.col(label) == 1, F.col(score) > threshold
    own = df.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(y).alias("p"), F.count("*").alias("n"))
    f1 = F.coalesce(share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    reject = F.coalesce(share(2 * F.col("p"), F.col("p") + F.col("n")), F.lit(0.0))
    return own.select(f1.alias("class_f1"), reject.alias("reject_all_f1"), (f1 > reject).alias("passes"))


def guard_limits(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Envelopes of the statistics and the bound 2 / (n + 1) on false refusals of each."""
    ends = [f(v).alias(f"{n}_{v}") for v in values for f, n in ((F.min, "low"), (F.max, "high"))]
    return df.agg(*ends, (F.lit(2.0) / (F.count("*") + 1)).alias("false_flag_bound"))


def guard_check(df: DataFrame, limits: DataFrame, values: Sequence[str]) -> DataFrame:
    """``df`` with the reasons why a row is refused, and ok without any."""
    own = df.crossJoin(F.broadcast(limits))  # one row
    reasons = [F.when((F.col(v) < F.col(f"low_{v}")) | (F.col(v) > F.col(f"high_{v}")), F.lit(v)) for v in values]
    own = own.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return own.withColumn("ok", F.size("reasons") == 0).select(*df.columns, "reasons", "ok")
