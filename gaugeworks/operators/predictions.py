"""Operators on tables of samples and predictions: selections, replaced columns, masks, digests and estimators.

Spark rows have no order, so positions are ranks along a named column; replaced scores are joined by id and
checked for completeness by an aggregate, never by collecting ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subset(df: DataFrame, order: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """The rows at 0-based ``positions`` along ``order``, each as often as it is asked for.

    Ranks are taken in ranges of the order column: a window within each, and the ranges' counts are added."""
    from gaugeworks.operators.ranking import running

    counted = df.groupBy(order).agg(F.count("*").alias("_c"))
    before = running(counted, order, ["_c"]).select(order, (F.col("cum__c") - F.col("_c")).alias("_before"))
    inside = Window.partitionBy(order).orderBy(*[c for c in df.columns if c != order])
    own = df.join(before, order).withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1)
    return own.join(positions.select(F.col(position).cast("long").alias("_at")), "_at").select(*df.columns)


def rename_split(df: DataFrame, split: str, into: str = "split") -> DataFrame:
    return df.withColumn(into, F.lit(split))


def defect_types(df: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """The sorted distinct kinds, bounded by their number."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(kind)).alias("defect_types"))


def with_scores(predictions: DataFrame, scores: DataFrame, id: str, score: str = "score") -> DataFrame:
    """``predictions`` with another score; an id without one, or one without an id, stops the query."""
    new = scores.select(F.col(id).alias("_id"), F.col(score).cast("double").alias("_new"))
    own = predictions.withColumn("_here", F.lit(True)).join(new, F.col(id) == F.col("_id"), "full")
    stop = F.raise_error(F.lit("ids of predictions and scores differ")).cast("double")
    value = F.when(F.col("_here").isNull() | F.col("_id").isNull(), stop).otherwise(F.col("_new"))
    return own.select(*(value.alias(score) if c == score else F.col(c) for c in predictions.columns))


def masks(override: Column, path: Column, stored: Column, cells: Column) -> Column:
    """The mask of a prediction: an override, nothing where no path names one, else the stored one."""
    return F.coalesce(override, F.when(path.isNull(), F.array_repeat(F.lit(False), cells)), stored)


def prediction_digest(df: DataFrame, id: str, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Digest of the set of (id, label, score to ten places): sums of row hashes, so no list is gathered."""
    row = F.sha2(F.concat_ws("|", F.col(id).cast("string"), F.col(label).cast("string"), F.format_string("%.10f", F.col(score).cast("double"))), 256)
    part = lambda k: F.conv(F.substring(row, k, 8), 16, 10).cast("long")
    own = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(part(1)).alias("_a"), F.sum(part(9)).alias("_b"))
    return own.select(*by, "n", F.left(F.sha2(F.concat_ws(":", "n", "_a", "_b"), 256), F.lit(16)).alias("digest"))


def check_listing(df: DataFrame, id: str, by: tuple[str, ...], recorded: DataFrame) -> DataFrame:
    """Groups whose listing is not the recorded one (columns ``by``, digest): changed, missing or new."""
    from gaugeworks.operators.splits import listing_digest

    own = listing_digest(df, id, by).select(*by, F.col("digest").alias("found"))
    held = recorded.select(*by, F.col("digest").alias("recorded"))
    return own.join(held, list(by), "full").where(~F.col("found").eqNullSafe(F.col("recorded")))


class Scorer:
    """An estimator's contract: ``fit`` on a normal-only split that may be trained on, then ``transform``.

    Subclasses give ``_fit(df)`` and ``_score(df)``, a column of scores added. Fitted state stays a small table
    or a few numbers, so a fitted scorer can score any table, stream or batch."""

    ALLOWED = ("train", "validation")

    def __init__(self, values: str, into: str = "score", **hparams):
        self.values, self.into, self.hparams, self.state = values, into, hparams, None

    def fit(self, df: DataFrame, split: str, label: str = "label") -> Scorer:
        if split not in self.ALLOWED:
            raise ValueError(f"a scorer is fitted on {' or '.join(self.ALLOWED)}, not on {split}")
        if self.state is not None:
            raise ValueError("already fitted")
        bad = F.raise_error(F.lit("an anomalous row in a split to fit on")).cast("int")
        self.state = self._fit(df.withColumn(label, F.when(F.col(label) == 1, bad).otherwise(F.col(label))).where(F.col(label) == 0))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise ValueError("not fitted")
        return self._score(df)

    def _fit(self, df: DataFrame):
        raise NotImplementedError

    def _score(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class MeanIntensity(Scorer):
    """Distance of a map's mean from the normal mean, in deviations."""

    def _fit(self, df):
        from gaugeworks.functions.columns import mean_of

        x = df.select(mean_of(F.col(self.values)).alias("x"))
        return x.agg(F.avg("x").alias("_mu"), F.greatest(F.stddev_samp("x"), F.lit(1e-6)).alias("_sd"))

    def _score(self, df):
        from gaugeworks.functions.columns import mean_of

        own = df.crossJoin(F.broadcast(self.state))  # one row
        return own.withColumn(self.into, F.abs(mean_of(F.col(self.values)) - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")


class Histogram(Scorer):
    """Chi-square distance of a map's histogram (``bins`` on [low, high], ends included) from the mean normal one."""

    def _shares(self, df: DataFrame) -> DataFrame:
        bins, low, high = (self.hparams.get(k, v) for k, v in (("bins", 64), ("low", -3.0), ("high", 3.0)))
        place = lambda x: F.least(F.greatest(F.floor((x - low) * (bins / (high - low))), F.lit(0)), F.lit(bins - 1)).cast("int")
        count = F.aggregate(F.transform(self.values, place), F.array_repeat(F.lit(0.0), bins), lambda s, k: F.transform(s, lambda x, i: F.when(i == k, x + 1).otherwise(x)))
        return df.withColumn("_p", F.transform(count, lambda x: x / F.size(self.values)))

    def _fit(self, df):
        mean = self._shares(df).select(F.posexplode("_p").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x"))
        return mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("_q"))  # ``bins`` numbers

    def _score(self, df):
        term = F.zip_with("_p", "_q", lambda p, q: F.when(p + q > 0, 0.5 * (p - q) * (p - q) / (p + q)).otherwise(0.0))
        return self._shares(df).crossJoin(F.broadcast(self.state)).withColumn(self.into, F.aggregate(term, F.lit(0.0), lambda s, x: s + x)).drop("_p", "_q")


class Random(Scorer):
    """A seeded uniform score of the id, the control."""

    def _fit(self, df):
        return self.hparams.get("seed", 0)

    def _score(self, df):
        from gaugeworks.functions.columns import uniform

        return df.withColumn(self.into, uniform(self.state, F.col(self.hparams["id"])))


class PixelPCA(Scorer):
    """Mean absolute residual of the reconstruction from the leading components."""

    def _fit(self, df):
        from gaugeworks.operators.neighbours import pca_fit

        mean, components, _ = pca_fit(df, self.values, self.hparams.get("components", 8))
        return mean, components

    def _score(self, df):
        from gaugeworks.operators.neighbours import pca_residual

        return pca_residual(df, self.values, *self.state, into=self.into)


#: Scorers by name.
SCORERS: dict[str, Callable[..., Scorer]] = {"mean_intensity": MeanIntensity, "histogram": Histogram, "random": Random, "pixel_pca": PixelPCA}


def register(name: str, make: Callable[..., Scorer]) -> None:
    """Add a scorer of one's own; a taken name is refused."""
    if name in SCORERS:
        raise ValueError(f"{name} is taken")
    SCORERS[name] = make


def build(name: str, *args, **options) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"{name} is none of {', '.join(sorted(SCORERS))}")
    return SCORERS[name](*args, **options)
