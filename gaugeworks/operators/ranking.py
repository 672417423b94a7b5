"""Exact ranking metrics: rows are first folded by score, so ties need no window over all rows.

Running sums over scores are taken in buckets between approximate quantiles: a window runs within
a bucket, the buckets' totals are added on. The number of buckets follows the number of distinct
scores, so a bucket holds about ``BUCKET_ROWS`` whatever the size. The result is exact
wherever the bounds lie, and no step puts all scores into one task. A folded table is kept while it is
read again (``persist``, spilling to disk), so the rows below it are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.columns import binary, finite, share

#: Rows of a bucket, about.
BUCKET_ROWS = 250_000


def folded(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """pos and neg counts by score (and ``by``); invalid labels and scores stop the query."""
    own = df.select(*by, binary(F.col(label)).alias("_y"), finite(F.col(score)).alias("score"))
    return own.groupBy(*by, "score").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))


def bucketed(df: DataFrame, order: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df``, kept, with _bucket, ascending with ``order``."""
    df = df.persist()
    buckets = -(-df.count() // rows)
    inner = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.2 / buckets))) if buckets > 1 else []
    if not inner:
        return df.withColumn("_bucket", F.lit(0))
    return df.withColumn("_bucket", F.size(F.filter(F.array(*map(F.lit, inner)), lambda b: b < F.col(order))))


def running(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with cum_<c> for each of ``sums``: the inclusive running sum along ``order``."""
    own = bucketed(df, order, rows)
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*by, "_bucket").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    totals = totals.select(*by, "_bucket", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    out = own.join(totals, [*by, "_bucket"])
    return out.select(*df.columns, *((F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in sums))


def with_previous(df: DataFrame, order: str, value: str, by: Sequence[str] = (), rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with _x0 and _y0: ``order`` and ``value`` of the row before along (order, value), NULL for the first.
    The last row of a bucket is handed to the next one."""
    own = bucketed(df, order, rows)
    point = F.struct(F.col(order).alias("x"), F.col(value).alias("y"))
    ends = own.groupBy(*by, "_bucket").agg(F.max(point).alias("_e"))
    ends = ends.select(*by, "_bucket", F.lag("_e").over(Window.partitionBy(*by).orderBy("_bucket")).alias("_c"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order, value)
    out = own.join(ends, [*by, "_bucket"]).withColumn("_p", F.coalesce(F.lag(point).over(inside), "_c"))
    return out.select(*df.columns, F.col("_p.x").alias("_x0"), F.col("_p.y").alias("_y0"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """auroc with mid-ranks for ties, n_pos, n_neg; NULL where a class is empty."""
    own = running(folded(df, label, score, by), "score", ["neg"], by)
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    p, n = F.sum("pos"), F.sum("neg")
    return own.groupBy(*by).agg(share(won, p * n).alias("auroc"), p.alias("n_pos"), n.alias("n_neg"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision at the ends of tie groups; 0 without positives."""
    own = running(folded(df, label, score, by), "score", ["pos", "neg"], by, descending=True)
    step = F.sum(F.col("pos") * share(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")))
    return own.groupBy(*by).agg(F.coalesce(share(step, F.sum("pos")), F.lit(0.0)).alias("average_precision"))


def curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points: one row for each distinct score, counting score >= it as flagged."""
    own = running(folded(df, label, score, by), "score", ["pos", "neg"], by, descending=True)
    total = own.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    own = own.join(F.broadcast(total), list(by)) if by else own.crossJoin(F.broadcast(total))  # one row for each group
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return own.select(*by, "score", share(tp, F.col("_p")).alias("tpr"), share(fp, F.col("_n")).alias("fpr"), share(tp, tp + fp).alias("precision"))


def f1_max(df: DataFrame, label: str, score: str) -> DataFrame:
    """Best F1 over tie-group ends (the highest score wins ties) and its threshold: midway to the
    next lower score, or the lowest score less one."""
    own = running(folded(df, label, score), "score", ["pos", "neg"], descending=True).persist()
    total = own.agg(F.sum("pos").alias("_p"))
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    rated = own.crossJoin(F.broadcast(total)).withColumn("f1", share(2 * tp, tp + fp + F.col("_p")))
    best = rated.agg(F.max(F.struct("f1", "score")).alias("x")).select("x.f1", F.col("x.score").alias("at"))
    lower = own.crossJoin(F.broadcast(best)).agg(F.max(F.when(F.col("score") < F.col("at"), F.col("score"))).alias("below"))
    return best.crossJoin(F.broadcast(lower)).select("f1", F.coalesce((F.col("at") + F.col("below")) / 2.0, F.col("at") - 1.0).alias("threshold"))


def confusion(df: DataFrame, label: str, score: str, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """Counts at a threshold with precision, recall, F1 (0 where undefined) and FPR (NULL without negatives)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y, hit = F.col(label) == 1, F.col(score) > t
    own = df.groupBy(*by).agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn")
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return own.select("*", zero(share(tp, tp + fp)).alias("precision"), zero(share(tp, tp + fn)).alias("recall"), zero(share(2 * tp, 2 * tp + fp + fn)).alias("f1"), share(fp, fp + tn).alias("fpr"))


def escape_rate(df: DataFrame, label: str, score: str, kind: str, threshold: Column | float) -> DataFrame:
    """Share of positives of each kind that are not flagged."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.where(F.col(label) == 1).groupBy(kind).agg(F.avg((F.col(score) <= t).cast("double")).alias("escape_rate"), F.count("*").alias("n"))


def trapezoid(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under y(x) by trapezoids, x ascending."""
    own = with_previous(df.select(*by, x, y), x, y, by)
    return own.groupBy(*by).agg(F.coalesce(F.sum((F.col(x) - F.col("_x0")) * (F.col(y) + F.col("_y0")) / 2.0), F.lit(0.0)).alias("area"))


def areas_to_limits(points: DataFrame, fpr: str, value: str, limits: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(fpr_limit, area): normalised areas under value(fpr) up to each limit, from one sweep: from (0, 0),
    interpolated at the limit, held flat beyond the last point."""
    own = with_previous(points.select(*by, fpr, value), fpr, value, by)
    x0, y0, x, y = F.coalesce("_x0", F.lit(0.0)), F.coalesce("_y0", F.lit(0.0)), F.col(fpr), F.col(value)
    slope = F.coalesce(F.try_divide(y - y0, x - x0), F.lit(0.0))

    def area(limit: float) -> Column:
        m = F.lit(float(limit))
        y1 = F.when(x > m, y0 + slope * (m - x0)).otherwise(y)
        return F.sum(F.when(x0 < m, (F.least(x, m) - x0) * (y0 + y1) / 2.0).otherwise(0.0))

    last = F.max(F.struct(x.alias("x"), y.alias("y")))
    out = own.groupBy(*by).agg(*(((area(m) + F.greatest(F.lit(0.0), F.lit(float(m)) - last["x"]) * last["y"]) / F.lit(float(m))).alias(f"_{k}") for k, m in enumerate(limits)))
    each = F.array(*(F.struct(F.lit(float(m)).alias("fpr_limit"), F.col(f"_{k}").alias("area")) for k, m in enumerate(limits)))
    return out.select(*by, F.explode(each).alias("_a")).select(*by, "_a.*")


def area_to_limit(points: DataFrame, fpr: str, value: str, limit: float, by: Sequence[str] = ()) -> DataFrame:
    """:func:`areas_to_limits` for one limit."""
    return areas_to_limits(points, fpr, value, (limit,), by).drop("fpr_limit")


def at_cuts(test: DataFrame, label: str, score: str, cuts: DataFrame, cut: str) -> DataFrame:
    """``cuts`` with fpr and recall of ``test`` at each one's threshold (score > cut is flagged), however many
    there are: test rows are folded by score, cuts join them as empty scores, and one running sum serves all."""
    empty = cuts.select(F.col(cut).cast("double").alias("score"), F.lit(0).alias("pos"), F.lit(0).alias("neg")).where("score IS NOT NULL")
    own = folded(test, label, score).select("score", "pos", "neg").unionAll(empty).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    own = running(own, "score", ["pos", "neg"], descending=True).persist()
    total = own.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = own.crossJoin(F.broadcast(total)).select(  # one row
        F.col("score").alias("_s"), share(F.col("cum_neg") - F.col("neg"), F.col("_n")).alias("fpr"), share(F.col("cum_pos") - F.col("pos"), F.col("_p")).alias("recall")
    )
    return cuts.join(above, F.col(cut).cast("double") == F.col("_s"), "left").drop("_s")
