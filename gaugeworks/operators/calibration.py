"""Studies of calibration: how operating points vary with rule, target, size and source of the normal scores.

All draws are made at once as rows, by hash rank; the thresholds of all draws, rules and targets are one table,
and the test rows are folded by score and met once (:func:`ranking.at_cuts`), never once for each threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import ranking, splits, statistics, thresholds


def mad_by(df: DataFrame, score: str, n_sigma: float, by: Sequence[str]) -> DataFrame:
    """Median and scaled median absolute deviation of each group."""
    middle = df.groupBy(*by).agg(F.median(score).alias("_m"))
    off = df.join(middle, list(by)).groupBy(*by).agg(F.first("_m").alias("_m"), F.median(F.abs(F.col(score) - F.col("_m"))).alias("_d"))
    return off.select(*by, (F.col("_m") + F.lit(n_sigma * 1.4826) * F.col("_d")).alias("threshold"))


def calibration_study(pool: DataFrame, test: DataFrame, id: str, label: str, score: str, sizes: Sequence[int], targets: Sequence[float], draws: int, seed: int | str = 0) -> DataFrame:
    """(size, draw, rule, requested_fpr, threshold, effective_fpr, target_met, fpr, recall) of every draw of every
    size, and of the whole pool once, under the rank rule for each target and the three-sigma and MAD rules."""
    n = pool.count()
    parts = [pool.select(score, F.lit(n).alias("size"), F.lit(0).alias("draw"))]
    for size in sizes:
        if size < n:
            parts.append(splits.draws(pool.select(id, score), id, draws, size, f"{seed}:{size}").select(score, F.lit(size).alias("size"), "draw"))
    drawn = parts[0]
    for p in parts[1:]:
        drawn = drawn.unionAll(p)
    drawn = drawn.persist()  # every rule reads it
    by = ("size", "draw")
    cuts = []
    for target in targets:
        t = thresholds.ranked_threshold(drawn, score, target, by, least_n=1)
        cuts.append(t.select(*by, F.lit("rank").alias("rule"), F.lit(float(target)).alias("requested_fpr"), "threshold", F.col("effective").alias("effective_fpr"), F.col("met").alias("target_met")))
    none = (F.lit(None).cast("double").alias("requested_fpr"), "threshold", F.lit(None).cast("double").alias("effective_fpr"), F.lit(None).cast("boolean").alias("target_met"))
    cuts.append(thresholds.sigma_threshold(drawn, score, 3.0, by=by).select(*by, F.lit("sigma3").alias("rule"), *none))
    cuts.append(mad_by(drawn, score, 3.0, by).select(*by, F.lit("mad3").alias("rule"), *none))
    every = cuts[0]
    for c in cuts[1:]:
        every = every.unionAll(c)
    return ranking.at_cuts(test, label, score, every, "threshold")


def summarize_calibration(points: DataFrame) -> DataFrame:
    """Median and 5 to 95 % range of FPR and recall for each rule, target and size; no target is a group of its own."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    range_of = lambda c: [p(c, 0.5).alias(f"{c}_median"), p(c, 0.05).alias(f"{c}_p05"), p(c, 0.95).alias(f"{c}_p95")]
    return points.groupBy("rule", "requested_fpr", "size").agg(
        F.count("*").alias("draws"), F.avg(F.col("target_met").cast("double")).alias("target_met_share"), F.median("effective_fpr").alias("effective_fpr"), *range_of("fpr"), *range_of("recall")
    )


def calibration_source_study(pool: DataFrame, test: DataFrame, id: str, label: str, score: str, targets: Sequence[float], draws: int, seed: int | str = 0, least_n: int = 10) -> DataFrame:
    """Does the source of the calibration scores explain an excess of false alarms?

    Each draw halves the test normals; half A, and as many rows of the pool, set a rank threshold each, and the other
    half is judged by both. The FPR on that half is had from counts: all test normals above the threshold less those of A."""
    normals = test.where(F.col(label) == 0)
    size = normals.count()
    n = size // 2
    half = splits.draws(normals.select(id, score), id, draws, n, f"{seed}:test").select("draw", score, F.lit("test half").alias("source"))
    own = half.unionAll(splits.draws(pool.select(id, score), id, draws, n, f"{seed}:pool").select("draw", score, F.lit("validation").alias("source"))).persist()
    by = ("source", "draw")
    cuts = None
    for target in targets:
        t = thresholds.ranked_threshold(own, score, target, by, least_n=1).where("met").select(*by, F.lit(float(target)).alias("requested_fpr"), "threshold", F.col("k").alias("rank_k"))
        cuts = t if cuts is None else cuts.unionAll(t)
    cuts = ranking.at_cuts(test, label, score, cuts, "threshold").persist()
    # what A holds above each threshold of its draw: at most draws x targets x 2 thresholds meet the draw's n rows
    held = half.select("draw", F.col(score).alias("_a")).join(cuts.select(*by, "requested_fpr", "threshold"), "draw")
    held = held.groupBy(*by, "requested_fpr").agg(F.count_if(F.col("_a") > F.col("threshold")).alias("_above"))
    each = cuts.join(held, [*by, "requested_fpr"]).withColumn("fpr", (F.round(F.col("fpr") * size) - F.col("_above")) / F.lit(float(size - n)))
    p = lambda q: F.percentile("fpr", F.lit(q))
    out = each.groupBy("source", "requested_fpr").agg(
        F.max("rank_k").alias("rank_k"), F.avg("fpr").alias("fpr_mean"), (F.stddev_samp("fpr") / F.sqrt(F.count("*"))).alias("fpr_mc_se"),
        p(0.05).alias("fpr_p05"), p(0.95).alias("fpr_p95"), F.avg("recall").alias("recall_mean"), F.count("*").alias("draws"),
    )
    if n < least_n or pool.count() < n:
        out = out.limit(0)
    return out.select("source", "requested_fpr", F.lit(n).cast("long").alias("n_calibration"), "rank_k", (F.col("rank_k") / F.lit(n + 1.0)).alias("bound"), "fpr_mean", "fpr_mc_se", "fpr_p05", "fpr_p95", "recall_mean", "draws")


def long_scores(runs: DataFrame, rules: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row for each rule with the score that it makes of a run's map."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), c.alias("score")) for n, c in rules.items())))
    return runs.select(*keep, each.alias("_x")).select(*keep, "_x.*")


def aggregation_study(runs: DataFrame, rules: Mapping[str, Column], id: str, seed: str, label: str, split: str, target: float) -> DataFrame:
    """Rules for one score a map, compared over fitting seeds: means over seeds of AUROC, average precision, and of FPR and
    recall at each seed's own rank threshold from validation normals; deviation of the AUROC over seeds."""
    own = long_scores(runs, rules, (id, seed, label, split)).persist()
    by, test = ("rule", seed), own.where(F.col(split) == "test")
    auc = ranking.roc_auc(test, label, "score", by).select(*by, "auroc")
    ap = ranking.average_precision(test, label, "score", by)
    at = thresholds.ranked_threshold(own.where((F.col(split) == "validation") & (F.col(label) == 0)), "score", target, by, least_n=1).select(*by, "threshold", "met")
    point = ranking.confusion(test.join(F.broadcast(at), list(by)), label, "score", F.col("threshold"), by).select(*by, "recall", "fpr")  # a row for each rule and seed
    each = auc.join(ap, list(by)).join(point, list(by))
    return each.groupBy("rule").agg(F.avg("auroc").alias("auroc_mean"), F.stddev_samp("auroc").alias("auroc_std"), F.avg("average_precision").alias("ap_mean"), F.avg("recall").alias("recall_mean"), F.avg("fpr").alias("fpr_mean"), F.count("*").alias("n_seeds"))


def aggregation_differences(runs: DataFrame, rules: Mapping[str, Column], reference: str, id: str, seed: str, label: str, n_resamples: int, draw_seed: int | str = 0) -> DataFrame:
    """Difference of the seed-averaged AUROC of each rule from the reference, with its 95 % bootstrap interval: images are
    drawn within their class, the same ones for all seeds and rules; only weights change, scores are never copied to driver."""
    own = long_scores(runs, rules, (id, seed, label))
    images = runs.select(id, label).distinct()
    weights = statistics.resample_weights(images, id, n_resamples, draw_seed, (label,)).drop(label)
    plain = images.select(id, F.lit(-1).alias("resample"), F.lit(1).cast("long").alias("weight"))
    rows = own.join(weights.select(id, "resample", "weight").unionAll(plain), id)
    each = statistics.weighted_auroc(rows, label, "score", "weight", ("resample", "rule", seed)).groupBy("resample", "rule").agg(F.avg("auroc").alias("a"))
    base = each.where(F.col("rule") == reference).select("resample", F.col("a").alias("b"))
    gap = each.where(F.col("rule") != reference).join(base, "resample").withColumn("d", F.col("a") - F.col("b"))
    inside = F.when(F.col("resample") >= 0, F.col("d"))
    return gap.groupBy("rule").agg(F.max(F.when(F.col("resample") < 0, F.col("d"))).alias("difference"), F.percentile(inside, F.lit(0.025)).alias("low"), F.percentile(inside, F.lit(0.975)).alias("high"))


def method_comparisons(groups: DataFrame, category: str, method: str, id: str, label: str, score: str, reference: str, n_resamples: int, seed: int | str = 0) -> DataFrame:
    """Every method against the reference on each category: AUROCs, their paired bootstrap difference, p and Holm's p
    over the family. Images that only one of the two has scored stop the query."""
    ref = groups.where(F.col(method) == reference).select(category, id, label, F.col(score).alias("_ref"))
    others = groups.where(F.col(method) != reference).select(category, id, method, F.col(score).alias("_own"))
    pairs = others.select(category, method).distinct().join(ref, category).join(others, [category, method, id], "left")
    stop = F.raise_error(F.lit("methods scored different images")).cast("double")
    pairs = pairs.withColumn("_own", F.coalesce("_own", stop))
    out = statistics.paired_bootstraps(pairs, id, label, "_own", "_ref", n_resamples, seed=seed, by=(category, method), draw_by=(category,))
    return statistics.holm(out.withColumn("_key", F.concat_ws("|", category, method)), "p_value", "_key").drop("_key")


def guards_by_condition(checked: DataFrame, condition: str, label: str, ok: str = "ok") -> DataFrame:
    """Share of refused rows for each condition and label."""
    return checked.groupBy(condition, label).agg(F.count("*").alias("n"), F.avg((~F.col(ok)).cast("double")).alias("refused"))
