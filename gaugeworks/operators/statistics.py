"""Paired comparisons, resampling and exact tails.

Resampling is reweighting: a draw only changes the weights of rows (or of whole clusters), so the
table is folded once and joined with weights. Draws come from hashes of (seed, resample, slot),
alike in every engine. Tails that need special functions are scalars worked out on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.columns import share
from gaugeworks.operators.ranking import running
from gaugeworks.operators.splits import ranked


def hash_unit(*parts: Column | str) -> Column:
    """A draw in [0, 1) from the joined ``parts``."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long").cast("double") / 4294967296.0


def resample_weights(df: DataFrame, id: str, n_resamples: int, seed: int | str, strata: Sequence[str] = ()) -> DataFrame:
    """(strata, id, resample, weight): how often each row is drawn in each resample of its stratum's size."""
    rank = ranked(df.select(*strata, id), id, seed, tuple(strata))
    n = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    slots = (rank.join(F.broadcast(n), list(strata)) if strata else rank.crossJoin(F.broadcast(n))).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    drawn = slots.withColumn("_pick", (F.floor(hash_unit(str(seed), F.col("resample"), *(F.col(s) for s in strata), F.col("rank")) * F.col("_n")) + 1).cast("long"))
    drawn = drawn.groupBy(*strata, "resample", F.col("_pick").alias("rank")).agg(F.count("*").alias("weight"))
    return drawn.join(rank, [*strata, "rank"]).select(*strata, id, "resample", "weight")


def bootstrap_mean(df: DataFrame, id: str, value: str, n_resamples: int, confidence: float = 0.95, seed: int | str = 0) -> DataFrame:
    """estimate, low and high of the mean by the percentile bootstrap."""
    w = resample_weights(df, id, n_resamples, seed).join(df.select(id, value), id)
    each = w.groupBy("resample").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("_m"))
    ends = each.agg(F.percentile("_m", F.lit((1 - confidence) / 2)).alias("low"), F.percentile("_m", F.lit((1 + confidence) / 2)).alias("high"))
    return df.agg(F.avg(value).alias("estimate")).crossJoin(F.broadcast(ends))


def weighted_auroc(rows: DataFrame, label: str, score: str, weight: str, by: Sequence[str]) -> DataFrame:
    """AUROC of weighted rows in each group of ``by``."""
    own = rows.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.sum(F.when(F.col(label) == 1, F.col(weight)).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(F.col(weight))).alias("neg"))
    own = running(own, "_s", ["neg"], by)
    return own.groupBy(*by).agg(share(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")).alias("auroc"))


def two_sided(delta: str) -> Column:
    """min(1, 2 (min(#<=0, #>=0) + 1) / (B + 1)) over resampled differences."""
    low, high = F.count_if(F.col(delta) <= 0), F.count_if(F.col(delta) >= 0)
    return F.least(F.lit(1.0), 2.0 * (F.least(low, high) + 1) / (F.count("*") + 1))


def paired_bootstraps(df: DataFrame, id: str, label: str, score_a: str, score_b: str, n_resamples: int, confidence: float = 0.95, seed: int | str = 0, by: Sequence[str] = (), draw_by: Sequence[str] = (), cluster: str | None = None) -> DataFrame:
    """For each group of ``by``: both AUROCs, their difference with interval and two-sided p, in one plan for all groups. Rows are
    drawn within their class and ``draw_by`` (some of ``by``), or whole clusters are; groups that share these share the draws."""
    own = df.withColumn("_g", F.lit(0))
    keys = ["_g", *by]
    if cluster:
        w = resample_weights(own.select(*draw_by, cluster).distinct(), cluster, n_resamples, seed, tuple(draw_by)).join(own, [*draw_by, cluster])
    else:
        w = resample_weights(own.select(*draw_by, label, id).distinct(), id, n_resamples, seed, (*draw_by, label)).join(own, [*draw_by, label, id])
    rows = w.unionByName(own.withColumn("resample", F.lit(-1)).withColumn("weight", F.lit(1).cast("long")))
    arms = F.array(F.struct(F.lit("a").alias("arm"), F.col(score_a).cast("double").alias("s")), F.struct(F.lit("b").alias("arm"), F.col(score_b).cast("double").alias("s")))
    both = rows.select("resample", *keys, label, "weight", F.explode(arms).alias("x")).select("resample", *keys, label, "weight", "x.arm", "x.s")
    arm = lambda k: F.max(F.when(F.col("arm") == k, F.col("auroc")))
    each = weighted_auroc(both, label, "s", "weight", ("resample", *keys, "arm")).groupBy("resample", *keys).agg(arm("a").alias("auroc_a"), arm("b").alias("auroc_b"))
    each = each.withColumn("d", F.col("auroc_a") - F.col("auroc_b"))
    plain = each.where("resample < 0").select(*keys, "auroc_a", "auroc_b", F.col("d").alias("difference"))
    drawn = each.where("resample >= 0 AND d IS NOT NULL").groupBy(*keys).agg(F.percentile("d", F.lit((1 - confidence) / 2)).alias("low"), F.percentile("d", F.lit((1 + confidence) / 2)).alias("high"), two_sided("d").alias("p_value"), F.count("*").alias("n_resamples"))
    return plain.join(drawn, keys).drop("_g")


def paired_bootstrap(df: DataFrame, id: str, label: str, score_a: str, score_b: str, n_resamples: int, confidence: float = 0.95, seed: int | str = 0, cluster: str | None = None) -> DataFrame:
    """:func:`paired_bootstraps` of a whole table: one row."""
    return paired_bootstraps(df, id, label, score_a, score_b, n_resamples, confidence, seed, cluster=cluster)


def holm(df: DataFrame, p: str, key: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with Holm's adjusted p-values and decisions within each family ``by``."""
    w = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    own = df.withColumn("_step", (m - F.row_number().over(w) + 1) * F.col(p))
    adjusted = F.least(F.lit(1.0), F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.withColumn("p_holm", adjusted).withColumn("rejected", F.col("p_holm") <= alpha).drop("_step")


def bonferroni(p: Column, family: Column | int) -> Column:
    return F.least(F.lit(1.0), p * family)


def mid_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their number and mid-rank."""
    own = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    return running(own, value, ["ties"], by).withColumn("mid_rank", F.col("cum_ties") - (F.col("ties") - 1) / 2.0)


def normal_shift(a: DataFrame, b: DataFrame, score: str) -> DataFrame:
    """Medians of two samples, AUROC of b over a, and the tie-corrected two-sided normal Mann-Whitney p."""
    both = a.select(F.col(score).cast("double").alias("s"), F.lit(0).alias("y")).unionAll(b.select(F.col(score).cast("double"), F.lit(1)))
    own = both.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    own = running(own, "s", ["neg"]).withColumn("t", F.col("pos") + F.col("neg"))
    sums = own.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)).alias("u"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"), F.sum((F.pow("t", F.lit(3)) - F.col("t"))).alias("ties"))
    n = F.col("p") + F.col("n")
    sd = F.sqrt(F.col("p") * F.col("n") / 12.0 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    gap = F.greatest(F.abs(F.col("u") - F.col("p") * F.col("n") / 2.0) - 0.5, F.lit(0.0))
    z = F.coalesce(F.try_divide(gap, sd), F.lit(0.0))
    med = both.agg(F.median(F.when(F.col("y") == 0, F.col("s"))).alias("median_a"), F.median(F.when(F.col("y") == 1, F.col("s"))).alias("median_b"))
    tail = F.pandas_udf(lambda x: x.map(normal_two_sided), "double")  # of one row
    out = sums.select(share(F.col("u"), F.col("p") * F.col("n")).alias("auroc"), z.alias("z"), F.col("n").cast("long").alias("n_a"), F.col("p").cast("long").alias("n_b"))
    return out.withColumn("p_value", tail("z")).crossJoin(F.broadcast(med))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def wilcoxon(df: DataFrame, a: str, b: str, least_n: int = 6) -> dict[str, float]:
    """Signed-rank test of paired values, zeros dropped: exact for up to 25 untied pairs, else normal with tie correction."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ranks = mid_ranks(d, "m")
    s = d.groupBy("m").agg(F.count_if(F.col("d") > 0).alias("up")).join(ranks, "m").agg(F.sum(F.col("up") * F.col("mid_rank")).alias("w"), F.sum("ties").alias("n"), F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"), F.max("ties").alias("most")).first()
    n = int(s.n or 0)
    if n < least_n:
        return {"n": n, "statistic": float("nan"), "p_value": 1.0}
    w = min(float(s.w), n * (n + 1) / 2 - float(s.w))
    if n <= 25 and s.most == 1:
        ways = [1]
        for r in range(1, n + 1):
            ways = [(ways[k] if k < len(ways) else 0) + (ways[k - r] if 0 <= k - r < len(ways) else 0) for k in range(len(ways) + r)]
        p = min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    else:
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float(s.t) / 48)
        p = normal_two_sided((n * (n + 1) / 4 - w) / sd) if sd else 1.0
    return {"n": n, "statistic": w, "p_value": p}


def _stirling_error(n: float) -> float:
    """log n! less Stirling's formula."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n**2) / n**2) / n**2) / n**2) / n


def _deviance(x: float, m: float) -> float:
    """x log(x / m) + m - x, also where x is near m."""
    if abs(x - m) >= 0.1 * (x + m):
        return x * math.log(x / m) + m - x
    v = (x - m) / (x + m)
    s, term, j = (x - m) * v, 2 * x * v, 1
    while True:
        term *= v * v
        new = s + term / (2 * j + 1)
        if new == s:
            return s
        s, j = new, j + 1


def _log_binomial(k: int, n: int, p: float) -> float:
    """log P[X = k] for 0 < p < 1, by deviances from the mean, so that it stays exact for large n."""
    if k == 0:
        return n * math.log1p(-p)
    if k == n:
        return n * math.log(p)
    core = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return core + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P[X <= k]: terms outward from ``k`` on its side of the mode, each from the one before, until what is left cannot be seen."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    odds, below = p / (1 - p), k <= (n + 1) * p
    i = k if below else k + 1
    term, s = 1.0, 0.0
    while term:
        s += term
        ratio = i / ((n - i + 1) * odds) if below else (n - i) / (i + 1) * odds
        if ratio < 1 and term * ratio <= 1e-17 * s * (1 - ratio):
            break
        term, i = term * ratio, i - 1 if below else i + 1
    s = min(1.0, s * math.exp(_log_binomial(k if below else k + 1, n, p)))
    return s if below else 1.0 - s


def binomial_upper_bound(failures: int, trials: int, confidence: float = 0.95) -> float:
    """One-sided exact upper bound of a rate: NaN without trials, 1 when all fail."""
    if trials == 0:
        return float("nan")
    if failures >= trials:
        return 1.0
    low, high = failures / trials, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(failures, trials, mid) > 1 - confidence else (low, mid)
    return (low + high) / 2


def sign_test(wins: int, n: int) -> float:
    """Exact one-sided p of ``wins`` or more among ``n`` untied pairs; of many pairs, to double precision."""
    if n > 1000:
        return binomial_tail(n - wins, n, 0.5)
    return sum(math.comb(n, i) for i in range(wins, n + 1)) / 2**n


def exceedance_p(fp: int, n_test: int, n_calibration: int, k: int) -> float:
    """P of ``fp`` or more test scores above the k-th largest calibration score, under exchangeability."""
    marked, total = fp + k - 1, n_calibration + n_test
    if fp <= 0:
        return 1.0
    top = min(marked, n_test)
    if marked >= total:
        return 1.0
    p = marked / total  # a hypergeometric term is one of two binomials over one of their sum
    whole = _log_binomial(marked, total, p)
    return min(1.0, math.fsum(math.exp(_log_binomial(i, n_test, p) + _log_binomial(marked - i, n_calibration, p) - whole) for i in range(max(fp, marked - n_calibration), top + 1)))


def one_row(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def bootstrap(df: DataFrame, id: str, n_resamples: int, statistic: Callable[[DataFrame], DataFrame], seed: int | str = 0) -> DataFrame:
    """``statistic`` of the weighted rows of all resamples at once; it groups by resample and uses weight."""
    return statistic(resample_weights(df, id, n_resamples, seed).join(df, id))
