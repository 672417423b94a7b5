"""Image-level scores from vectors of several layers: a Gaussian for each layer, and neighbours of the joined unit vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import neighbours


def joined_units(layers: Sequence[str]) -> Column:
    """The layers' vectors, each scaled to length 1, one after the other; NULL where one is null or zero."""
    unit = lambda c: F.flatten(F.transform(F.array(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))), lambda n: F.transform(c, lambda x: F.try_divide(x, n))))
    out = F.concat(*(unit(F.col(c)) for c in layers))
    return F.when(~F.exists(out, lambda x: x.isNull()), out)


def gaussian_scores(df: DataFrame, train: DataFrame, id: str, layers: Sequence[str]) -> DataFrame:
    """(id, score): the sum over layers of the Mahalanobis distance under a shrunk Gaussian of the training rows."""
    own = df.select(id, *layers)
    for k, c in enumerate(layers):
        mean, cov, _ = neighbours.ledoit_wolf(train, c)
        own = neighbours.mahalanobis(own, c, mean, cov, f"_d{k}")
    total = F.lit(0.0)
    for k in range(len(layers)):
        total = total + F.col(f"_d{k}")
    return own.select(id, total.alias("score"))


def neighbour_scores(df: DataFrame, train: DataFrame, id: str, layers: Sequence[str], k: int = 5, exclude_self: bool = False) -> DataFrame:
    """(id, score): the mean distance to the ``k`` nearest training rows, or all if there are fewer."""
    near = neighbours.knn_join(df.select(id, joined_units(layers).alias("_u")), train.select(id, joined_units(layers).alias("_u")), k, id, "_u", exclude_self=exclude_self)
    return near.groupBy(id).agg(F.avg("distance").alias("score"))


def standardised(scores: DataFrame, reference: DataFrame, score: str = "score") -> DataFrame:
    """``scores`` less the mean of the reference's, over their population deviation."""
    at = reference.agg(F.avg(score).alias("_mu"), F.greatest(F.stddev_pop(score), F.lit(1e-12)).alias("_sd"))
    return scores.crossJoin(F.broadcast(at)).withColumn(score, (F.col(score) - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")  # one row
